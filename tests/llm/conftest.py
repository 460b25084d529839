import pytest


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, lang, source), with a clashing extra column on demand."""

    def build(rows, extra=False):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), None) for r in rows]
        frame = spark.createDataFrame(full, schema)
        if extra:
            from pyspark.sql import functions as F

            for name in ("fp", "key", "root", "size", "target", "rank", "score", "stratum", "quality", "kept", "shard"):
                frame = frame.withColumn(name, F.lit("x"))
        return frame

    return build
