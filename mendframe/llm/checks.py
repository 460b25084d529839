r"""SQL of the operators' queries, where SQL can express them.

Without SQL, and why: op1 (XXH64 and components), op2 (exchange clustering), op3 (random
vectors), op6 (edit distance inside a text), op10 and op11 (CRC-32; runs of any period),
op12 (every window of bytes). Their tests compare them with brute force, held-out texts or an exact round trip.
"""

from __future__ import annotations

from mendframe.llm import quality

_WORD = r"[^\x20\x09-\x0D]+"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{_WORD}')"

WARC = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
    SELECT *, CAST(CAST(unhex(hex) AS BIT) AS VARCHAR) AS bits, min(page_id) OVER (PARTITION BY payload) AS first FROM p
)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
        + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
        + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
        + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

MIXING = f"""
WITH d AS (
    SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
        CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0'), 1, 15)) AS BIGINT) AS draw
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), l AS (
    SELECT *, 3 * source_size / weight AS ratio,
        ((SELECT sum(source_size) FROM w) - coalesce(sum(3 * source_size) OVER before, 0))
            / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0)) AS level
    FROM w WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, source_size,
        least(3.0 * source_size, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * weight,
            3.0 * source_size))::DOUBLE AS target
    FROM l
), r AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS whole FROM t
), o AS (
    SELECT d.*, r.source_size, r.target, r.whole,
        sum(size) OVER (PARTITION BY d.source ORDER BY draw, size) AS upto,
        CAST(round(r.target) AS BIGINT) - r.whole * r.source_size AS rest
    FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
    CAST(size * least(3, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""


def _quality() -> str:
    trials = ", ".join(
        f"('{rule}', {step}, {cutoff}::DOUBLE, {part} / greatest({whole}, 1)::DOUBLE > {cutoff}::DOUBLE)"
        for rule, (part, whole, cutoffs) in quality.RULES.items() for step, cutoff in enumerate(cutoffs)
    )
    rules = len(quality.RULES)
    risk = quality.RISK / rules
    exceeded = " + ".join(
        f"coalesce(({part} / greatest({whole}, 1)::DOUBLE > (SELECT cutoff FROM chosen c WHERE c.stratum = f.stratum AND c.rule = '{rule}'))::INT, 0)"
        for rule, (part, whole, _) in quality.RULES.items()
    )
    return f"""
WITH w AS (
    SELECT *, coalesce(lang, '') AS stratum, {_WORDS} AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls
    FROM documents
), g AS (
    SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), cov AS (
    SELECT doc_id, CAST(sum(least(3, coalesce(following - i, 3))) AS BIGINT) AS n_repeat_words FROM rep GROUP BY doc_id
), f AS (
    SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(len(ws) - len(list_distinct(ws)) AS BIGINT) AS n_same_words,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(ws) < {quality.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {quality.MAX_REPEAT_PERCENT} * len(ws) AS base_failed
    FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id
), held AS (
    SELECT stratum, quality, unnest([{trials}]) AS trial
    FROM f JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)
    WHERE NOT base_failed
), counted AS (
    SELECT stratum, trial[1] AS rule, trial[2] AS step, trial[3] AS cutoff, count(*) FILTER (quality = 1) AS n,
        count(*) FILTER (trial[4] AND quality = 1) AS x, count(*) FILTER (trial[4] AND quality <> 1) AS caught
    FROM (SELECT stratum, quality, trial FROM held) GROUP BY ALL
), tested AS (
    SELECT *, CASE WHEN x >= n * {risk} THEN 1.0 ELSE list_sum(list_transform(range(x + 1), lambda k: exp(
        lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({risk}) + (n - k) * ln(1 - {risk})))) END
        <= {quality.CONFIDENCE_LOSS} / {rules} / (SELECT count(DISTINCT stratum) FROM f) AS safe
    FROM counted
), opened AS (
    SELECT *, bool_and(safe) OVER (PARTITION BY stratum, rule ORDER BY step) AS open FROM tested
), chosen AS (
    SELECT stratum, rule, arg_max(cutoff, (caught - x) * 1000 - step) AS cutoff FROM opened
    WHERE open AND caught > x GROUP BY stratum, rule
), v AS (
    SELECT f.*, {exceeded} AS n_rules FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CAST(n_rules AS INT) AS n_rules,
    NOT base_failed AND n_rules = 0 AS kept
FROM v
"""


URL_FILTERS = r"""
WITH p AS (
    SELECT page_id, url, 1704067200 + (page_id * 7919 * 3600 + 1800) % (360 * 86400) AS fetched_at,
        nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:@]*)', 1)), '.'), '') AS host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path
    FROM pages
), sites AS (
    SELECT DISTINCT host, regexp_extract(path, '^/([^/]+)', 1) AS segment FROM p WHERE host IS NOT NULL
), drawn AS (
    SELECT *, CAST(('0x' || substr(md5(host), 1, 8)) AS BIGINT) AS draw FROM sites
), ev AS (
    SELECT 'abuse' AS list, 'block' AS policy, 'domain' AS kind,
        array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS key, draw % 150 + unnest([0, 60, 120]) AS day,
        unnest(['add', 'remove', 'add']) AS action FROM drawn WHERE draw % 4 = 0
    UNION ALL SELECT 'spam', 'block', 'host', host, draw % 150 + unnest([10, 200]), unnest(['add', 'remove'])
        FROM drawn WHERE draw % 4 = 1
    UNION ALL SELECT 'spam', 'block', 'host', host, draw % 150, 'add' FROM drawn WHERE draw % 4 = 2 AND segment <> ''
    UNION ALL SELECT 'licensed', 'allow', 'path', host || '/' || segment, draw % 150 + unnest([30, 90]), unnest(['add', 'remove'])
        FROM drawn WHERE draw % 4 = 2 AND segment <> ''
), st AS (
    SELECT list, policy, kind, key, 1704067200 + day * 86400 AS since, max(action = 'add') AS on_list FROM ev GROUP BY ALL
), iv AS (
    SELECT * FROM (SELECT *, coalesce(lead(since) OVER (PARTITION BY list, policy, kind, key ORDER BY since), 1::BIGINT << 62) AS until FROM st)
    WHERE on_list
), m AS (
    SELECT p.page_id, iv.*, row_number() OVER (PARTITION BY p.page_id ORDER BY
        list_position(['path', 'host', 'domain'], kind), length(key) DESC, policy <> 'block', list, policy, since) AS rank,
        count(*) OVER (PARTITION BY p.page_id) AS n
    FROM p JOIN iv ON p.fetched_at >= since AND p.fetched_at < until AND CASE kind
        WHEN 'host' THEN host = key
        WHEN 'domain' THEN host = key OR suffix(host, '.' || key)
        ELSE starts_with(host || path || '/', key || '/') END
)
SELECT p.page_id, url, host, CAST(fetched_at AS BIGINT) AS fetched_at, coalesce(n, 0) AS n_active,
    coalesce(policy = 'block', false) AS blocked, list, kind, key, CAST(since AS BIGINT) AS valid_from
FROM p LEFT JOIN (SELECT * FROM m WHERE rank = 1) b ON p.page_id = b.page_id
"""

CHAT = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(24 + length(regexp_replace(role, '<(\\*)\|', '<\1x|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1x|', 'g')))
        AS BIGINT) AS formatted_chars,
    CAST(0 AS BIGINT) AS expanded_tokens, CAST(0 AS BIGINT) AS n_attachments
FROM c GROUP BY conv_id
"""

DIVERGENCE = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower
    FROM documents
), w AS (
    SELECT id, lang, source, unnest(regexp_extract_all(lower, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
    SELECT lang, term, count(*) AS all_n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), v AS (
    SELECT lang, count(*) AS kept, sum(all_n) AS lang_total FROM k GROUP BY lang
), g AS (
    SELECT DISTINCT lang, source FROM d
), c AS (
    SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term
), t AS (
    SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source
), p AS (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
        1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (total + 5 * kept) AS p,
        1 + 1000000000::HUGEINT * (all_n + 5) // (lang_total + 5 * kept) AS q
    FROM t JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), m AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), both_parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(m.value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM both_parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

CHECKS: dict[str, str] = {
    "op4_warc_normaliser": WARC,
    "op5_source_mixing": MIXING,
    "op7_quality_rules": _quality(),
    "op8_url_filters": URL_FILTERS,
    "op9_chat_formatting": CHAT,
    "op13_source_divergence": DIVERGENCE,
}
