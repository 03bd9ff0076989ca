"""Panel files: headerless delimited text with a positional schema."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def panel_schema(names: Sequence[str], key: str | None = None) -> T.StructType:
    """Schema by position: the key (if any) is a long, every other column a double."""
    return T.StructType([T.StructField(n, T.LongType() if n == key else T.DoubleType(), True)
                         for n in names])


def read_panel(spark: SparkSession, path: str, names: Sequence[str], sep: str = "\t",
               missing: str = ".", key: str | None = None) -> DataFrame:
    """Scan a headerless panel file with columns named by position.

    The schema is given, so nothing is inferred and no extra pass runs; the
    missing marker becomes NULL.  Files are split by Spark like any text input.
    """
    return (spark.read.schema(panel_schema(names, key))
            .option("sep", sep).option("header", "false").option("nullValue", missing)
            .option("mode", "FAILFAST").csv(path))


def write_panel(df: DataFrame, path: str, keep: Sequence[str] | None = None, sep: str = "\t",
                missing: str = ".", mode: str = "error") -> None:
    """Project to ``keep`` and write headerless text with ``missing`` for NULL.

    Whole numbers are written without a decimal part, as the reference's files are.
    """
    out = df.select(*keep) if keep else df
    cols = []
    for f in out.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))
        cols.append(c.alias(f.name))
    (out.select(*cols).write.mode(mode).option("sep", sep).option("header", "false")
     .option("nullValue", missing).option("emptyValue", missing).csv(path))
