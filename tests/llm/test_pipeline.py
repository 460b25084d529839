from collections import Counter, defaultdict

import corpus_pipeline
from mendframe.llm import decontamination

from test_simhash import shingles
from test_texts import slow_counts

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows, seen = docs.columns, {}, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        seen.append(spark.createDataFrame(out.collect(), out.schema))
        rows[name] = seen[-1].collect()

    # so few labels prove no cutoff: what passes the base rules stays
    def passes(d):
        n, _, _, _, repeats = slow_counts(d.text)
        return n >= 50 and 100 * repeats <= 50 * n

    start = {d.doc_id: d for d in docs.collect()}
    good = {i for i, d in start.items() if passes(d)}
    assert {d.doc_id for d in rows["quality_rules"]} == good

    kept = {d.doc_id for d in rows["simhash_near_dedup"]}
    sets = {i: shingles(start[i].text) for i in good}
    near = {i: [j for j in good if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in good}
    assert kept <= good and all(near[i] for i in good - kept)
    assert not any(len(sets[i] & sets[j]) > 0.9 * len(sets[i] | sets[j]) for i in kept for j in near[i] if j in kept)

    items = [decontamination.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i in kept if any(x in decontamination.normalised(start[i].text) for x in items)}
    clean = {d.doc_id for d in rows["benchmark_decontamination"]}
    assert held and clean == kept - held

    copies = Counter(d.doc_id for d in rows["source_mixing"])
    assert set(copies) <= clean and max(copies.values()) <= 3

    slots = defaultdict(list)
    for d in rows["feistel_sharding"]:
        slots[d.shard].append(d.slot)
    assert Counter(d.doc_id for d in rows["feistel_sharding"]) == copies
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
