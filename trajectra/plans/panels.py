"""Panels built from the driver's tables, over all visits.

Panel P (orders): subject = o_custkey, wave = visit number by (o_orderdate,
o_orderkey) from 0, y = o_totalprice / 10000.
Panel E (events): subject = user_id, outcome = event_type, wave by (ts, event_id)
within (user_id, event_type), y = value.

The number of waves W is that of the subject with the most visits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectra.operators.panel import largest_group, number_visits, to_long, to_wide


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def waves_p(spark: SparkSession, sf_dir: str) -> int:
    """W of panel P, from one count per subject."""
    return largest_group(table(spark, sf_dir, "orders"), ["o_custkey"])


def waves_e(spark: SparkSession, sf_dir: str) -> int:
    """W of panel E."""
    return largest_group(table(spark, sf_dir, "events"), ["user_id", "event_type"])


def panel_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long panel P: (subject, wave, y, order_date)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    p = number_visits(o, "o_custkey", ["o_orderdate", "o_orderkey"], "wave")
    return p.select(F.col("o_custkey").alias("subject"), "wave",
                    (F.col("o_totalprice") / 10000.0).alias("y"),
                    F.col("o_orderdate").alias("order_date"))


def wide_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide panel P: subject, y_0..y_{W-1}."""
    return to_wide(panel_p(spark, sf_dir), "subject", "wave", ["y"], list(range(waves_p(spark, sf_dir))))


def y_cols(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c.startswith("y_")]


def panel_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long panel E: (subject, outcome, wave, y)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    p = number_visits(e, ["user_id", "event_type"], ["ts", "event_id"], "wave")
    return p.select(F.col("user_id").alias("subject"), F.col("event_type").alias("outcome"),
                    "wave", F.col("value").alias("y"))


# SQL twins of the panels (DuckDB views named as the driver's tables).
PANEL_P_SQL = """
panel_p AS (
  SELECT o_custkey AS subject, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS wave,
         o_totalprice / 10000.0 AS y, o_orderdate AS order_date
  FROM orders)"""


def cells(wide: DataFrame) -> DataFrame:
    """Every cell of a wide panel, missing ones too: (subject, variable, value).  A view needs fixed columns, W is the data's."""
    return to_long(wide, ["subject"])


def cells_sql(value: str = "y", prefix: str = "y_", where: str = "TRUE") -> str:
    """Every cell of wide panel P, with an expression of y in it; subjects by a condition."""
    return f"""
SELECT s.subject, '{prefix}' || w.wave AS variable, CAST(p.v AS DOUBLE) AS value
FROM (SELECT DISTINCT subject FROM panel_p) s
CROSS JOIN (SELECT unnest(range((SELECT max(wave) + 1 FROM panel_p))) AS wave) w
LEFT JOIN (SELECT subject, wave, {value} AS v FROM panel_p) p ON p.subject = s.subject AND p.wave = w.wave
WHERE {where}"""


PANEL_E_SQL = """
panel_e AS (
  SELECT user_id AS subject, event_type AS outcome,
         CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS wave, value AS y
  FROM events)"""
