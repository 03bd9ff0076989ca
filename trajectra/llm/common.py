"""Helpers shared by the operators: staged tables, skew-safe lookups, running totals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from trajectra.session import ensure_checkpoint_dir, ship_package

WORD = r"[^\x20\x09-\x0D]+"        # words of the quality rules and of the mix
HOT_KEYS = 1000                    # a key is hot above 1/HOT_KEYS of all rows: fewer than HOT_KEYS such keys can exist


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing.
    The files stay until ``drop_staged`` or ``session.drop_stages``, as the lazily evaluated
    result still reads them.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(nullable(df.schema)).parquet(path)
    out._staged_path = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of ``staged`` tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers."""
    ship_package(spark)


def text_key(text: Column) -> Column:
    """128-bit key of a text; a null text counts as an empty one."""
    return F.md5(F.coalesce(text, F.lit("")))


def attach(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, spread: Column) -> DataFrame:
    """Left-join ``facts`` (one row per ``key``, ``count`` = rows that carry it) to ``rows``.

    Keys above ``total / HOT_KEYS`` rows go through a broadcast: fewer than
    HOT_KEYS of them can exist, whatever the data.  Their rows take part in the
    shuffled join under a key of their own made from ``spread``, so no reducer
    gets more than a ``1/HOT_KEYS`` share.  ``rows`` is read once.
    """
    limit = max(1, total // HOT_KEYS)
    values = [c for c in facts.columns if c != key]
    hot = facts.filter(F.col(count) > limit).select(
        F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = facts.filter(F.col(count) <= limit).select(
        F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold"))
    kind = dict(rows.dtypes)[key]
    own = F.concat(F.lit("~"), spread.cast("string")) if kind == "string" else spread.cast(kind)
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    out = out.withColumn("_at", F.when(F.col("_hot_key").isNull(), F.col(key)).otherwise(own))
    out = out.join(cold, F.col("_at") == F.col("_cold_key"), "left")
    for c in values:
        # a hot row's own key may equal a cold key only for non-string kinds: the hot fact wins
        out = out.withColumn(c, F.when(F.col("_hot_key").isNotNull(), F.col(f"_hot.{c}")).otherwise(F.col(f"_cold.{c}")))
    return out.drop("_hot_key", "_hot", "_at", "_cold_key", "_cold")


def number_in_groups(rows: DataFrame, group: str, order: list[str], total: int, slot: str, per_bin: int = 20_000,
                     least: int = 16) -> DataFrame:
    """Gapless numbers from 0 inside each ``group``, without a task per group.

    Rows of a group are dealt by a hash of ``order`` into bins; each bin is
    numbered by itself and shifted by the rows of the bins before it.  ``rows``
    should be a staged table, as it is read twice.
    """
    bins = max(least, -(-total // per_bin))
    binned = rows.withColumn("_bin", F.pmod(F.xxhash64(*order), F.lit(bins)).cast("int"))
    counts = binned.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_bin").alias("_b"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = W.partitionBy(group, "_bin").orderBy(*order)
    out = binned.withColumn("_rn", F.row_number().over(own))
    out = out.join(starts, (F.col(group) == F.col("_g")) & (F.col("_bin") == F.col("_b")), "left")
    return out.withColumn(slot, (F.col("_start") + F.col("_rn") - 1).cast("long")).drop(
        "_bin", "_g", "_b", "_start", "_rn")
