"""Panel files (S1, S2) and reshaping properties."""

import os
import tempfile

from pyspark.sql import functions as F

from trajectra.operators import panel as P
from trajectra.sources.panel_files import read_panel, write_panel


def test_round_trip(spark):
    d = tempfile.mkdtemp(prefix="trajectra-io-", dir="/tmp")
    src = os.path.join(d, "in.dat")
    with open(src, "w") as fh:
        fh.write("1\t26\t.\t25\n2\t28\t27\t.\n3\t.\t.\t30\n")
    names = ["ID", "Y_0", "Y_1", "Y_2"]
    df = read_panel(spark, src, names, key="ID")
    assert df.where(F.col("Y_1").isNull()).count() == 2
    out = os.path.join(d, "out")
    write_panel(df, out, keep=names)
    back = read_panel(spark, out, names, key="ID")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.startswith("part-"))
    assert "1\t26\t.\t25" in text


def test_visit_numbers_and_pivot_round_trip(spark):
    rows = [(1, 3, 5.0), (1, 1, 4.0), (1, 2, None), (2, 9, 1.0), (2, 9, 2.0)]
    df = spark.createDataFrame(rows, "s long, t long, y double").withColumn("k", F.monotonically_increasing_id())
    v = P.number_visits(df, "s", ["t", "k"], "wave")
    got = sorted((r["s"], r["t"], r["wave"]) for r in v.collect())
    assert got[:3] == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    wide = P.to_wide(v, "s", "wave", ["y"], range(3))
    long = P.to_long(wide, ["s"]).where(F.col("value").isNotNull())
    assert long.count() == v.where(F.col("y").isNotNull()).count()


def test_dense_ids_are_consecutive(spark):
    df = spark.range(0, 1000).select((F.col("id") % 37).alias("k"))
    ids = P.surrogate_id(df, ["k"], "kid")
    m = {r["k"]: r["kid"] for r in ids.select("k", "kid").distinct().collect()}
    assert sorted(m.values()) == list(range(1, 38))
    assert all(m[k] == k + 1 for k in m)


def test_numbering_with_a_hot_key(spark):
    # groups above the bound are range-sorted over all partitions: the numbers must be the same
    hot = spark.range(0, 3000).select(F.lit(1).cast("long").alias("s"), F.col("id").alias("t"))
    none = spark.range(0, 200).select(F.lit(None).cast("long").alias("s"), F.col("id").alias("t"))
    cold = spark.range(0, 40).select((F.col("id") % 4 + 2).alias("s"), F.col("id").alias("t"))
    df = hot.unionByName(cold).unionByName(none)
    want = sorted(map(tuple, P.number_within(df, ["s"], ["t"]).collect()), key=repr)
    got = P.number_within(df, ["s"], ["t"], hot_rows=100)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert got.where((F.col("s") == 1) & (F.col("rn") != F.col("t") + 1)).count() == 0
    blocks = P.position_in_block(hot, ["s"], ["t"], 4)
    assert blocks.where(F.col("block") != F.floor(F.col("t") / 4) + 1).count() == 0


def test_ids_of_null_keys(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), (None,)], "k string")
    assert sorted(map(tuple, P.surrogate_id(df, ["k"], "i").collect()), key=repr) == [("a", 1), ("b", 2), (None, 3), (None, 3)]
    got = {r["k"]: r["order_id"] for r in P.ordered_id(df, "k", ["b"]).collect()}
    assert got == {"b": 1, "a": 2, None: 3}
