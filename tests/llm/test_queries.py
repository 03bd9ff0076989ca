"""Queries against their SQL, and the pipeline against its stages, on the smallest tables."""

import pytest

from tests.conftest import SMALL
from tools.check_oracle import duck, normalise
from trajectra.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duck(SMALL)
    con.execute(f"CREATE VIEW twin AS {queries.oracle_sql()[name]}")
    want = con.execute("SELECT * FROM twin").df()
    got = queries.queries()[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert normalise(got) == normalise(want)


@pytest.mark.parametrize("name", sorted(n for n in queries.queries() if int(n[2:].split("_")[0]) <= 10))
def test_one_row_per_row(spark, name):
    table = "pages" if name in ("op1_html_text", "op4_warc") else "documents"
    assert queries.queries()[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_pipeline(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    sizes = [docs.count()]
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        sizes.append(len(ids))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    out = P.run(spark, SMALL).collect()
    assert {r.doc_id for r in out} == ids
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_without_rows(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SMALL).collect() == []
