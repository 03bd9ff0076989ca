import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
# names that operators use inside, as columns of the input
CLASHES = ("score", "node", "size", "shard", "match", "_row", "_key", "_hot", "_at", "target", "position", "toxicity", "kept")


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of (doc_id, text[, source]) as a documents table; ``clash`` adds columns with the operators' own names."""
    from pyspark.sql import functions as F

    def make(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            df = df.withColumns({c: F.lit(7) for c in CLASHES})
        return df
    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
    return [(1, "One two three four five six seven.", "a"), (1, "One two three four five six seven.", "a"),
            (2, None, "a"), (3, "", None), (None, "no id here at all", "b"), (None, None, None),
            (4, " \n\t ", "b"), (5, long, "c"), (6, long, "c"), (7, "é ü 中文 😀 \x00 x", "b"), (8, "...", "")]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
