"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Every source has a weight schedule over training time t in [0, 1], a piecewise
linear curve given by knots (t, w).  Its integral is the source's weight; the
running integral, scaled to the source's token target, is its cumulative demand
D(t).  Documents of a source stand in hashed order with running token counts;
the document that starts at running count c is due at the t where D(t) = c.
Repeats go on behind the last document until the target is met.  The mix is
range-sorted by t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trajectra.llm.common import WORD, staged

MAX_REPEATS = 3         # a source's target, and a document's use, stop at this many times its size
BINS = 4096             # hashed bins of a source; a bin's rows are summed by one task
TILTS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))   # start and end of the default schedules, times the weight


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source_size, weight (1, 2, 3 repeating by code point, null last), target.

    The targets share the sum of all sizes by weight; a source whose share is
    above ``max_repeats`` times its size gets just that, and the excess goes to
    the others by weight: with sources in order of cap / weight, the first level
    (total - caps before) / (weights from here) that no later source exceeds.
    The table has one row per source that a schedule names.
    """
    order = W.orderBy(F.col("_null"), F.col("_src"))
    src = sizes.groupBy("_null", "_src").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    src = src.withColumn("_cap", F.col("source_size") * max_repeats)
    by_need = W.orderBy(F.col("_cap") / F.col("weight"), F.col("_null"), F.col("_src"))
    upto = by_need.rowsBetween(W.unboundedPreceding, -1)
    onward = by_need.rowsBetween(0, W.unboundedFollowing)
    whole = by_need.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    src = src.withColumn("_level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(upto), F.lit(0)))
                         / F.sum("weight").over(onward))
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))
    # the level falls or stays where it fits, so the first fitting one is the water level of all later sources
    src = src.withColumn("_water", F.first(fits, ignorenulls=True).over(by_need.rowsBetween(W.unboundedPreceding, 0)))
    target = F.when(F.col("_water").isNull(), F.col("_cap").cast("double")).otherwise(
        F.least(F.col("_water") * F.col("weight"), F.col("_cap").cast("double")))
    return src.select("_null", "_src", "source_size", "weight", target.alias("target"))


def default_schedules(targets: DataFrame) -> DataFrame:
    """Add ``knots``: falling, flat and rising schedules by weight, each with the weight as its integral."""
    curve = [F.array(*[F.struct(F.lit(t).alias("t"), (F.col("weight") * F.lit(w)).alias("w"))
                       for t, w in ((0.0, a), (1.0, b))]) for a, b in TILTS]
    return targets.withColumn("knots", F.when(F.col("weight") == 1, curve[0]).when(F.col("weight") == 2, curve[1])
                              .otherwise(curve[2]))


def _segments() -> Column:
    """Knots -> segments with the demand reached before each, as a share of the whole integral."""
    area = lambda a, b: (b["t"] - a["t"]) * (a["w"] + b["w"]) / 2
    k = F.col("knots")
    pairs = F.transform(F.sequence(F.lit(1), F.size(k) - 1), lambda i: F.struct(
        F.element_at(k, i)["t"].alias("t0"), F.element_at(k, i + 1)["t"].alias("t1"),
        F.element_at(k, i)["w"].alias("w0"), F.element_at(k, i + 1)["w"].alias("w1"),
        area(F.element_at(k, i), F.element_at(k, i + 1)).alias("area"),
        F.aggregate(F.when(i > 1, F.sequence(F.lit(1), i - 1)).otherwise(F.array().cast("array<int>")), F.lit(0.0),
                    lambda acc, j: acc + area(F.element_at(k, j), F.element_at(k, j + 1))).alias("before")))
    return pairs


def position(segments: Column, share: Column) -> Column:
    """The t at which the running integral reaches ``share`` (0 to 1) of the whole."""
    whole = F.aggregate(segments, F.lit(0.0), lambda acc, s: acc + s["area"])
    need = share * whole
    seg = F.element_at(F.filter(segments, lambda s: (s["before"] <= need) & (s["area"] > 0)), -1)
    part = F.greatest(need - seg["before"], F.lit(0.0))
    width = seg["t1"] - seg["t0"]
    slope = (seg["w1"] - seg["w0"]) / width
    root = F.sqrt(F.greatest(seg["w0"] * seg["w0"] + 2 * slope * part, F.lit(0.0)))
    return F.least(seg["t0"] + 2 * part / F.greatest(seg["w0"] + root, F.lit(1e-300)), seg["t1"])


def _mix(docs: DataFrame, max_repeats: int, schedules, keep_rows: bool) -> DataFrame:
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")) if keep_rows else \
        docs.select(F.struct("doc_id", "source", "text").alias("_row"))
    text = F.col("_row.text")
    base = base.select(
        *(["_row"] if keep_rows else []), F.col("_row.doc_id").alias("doc_id"),
        F.col("_row.source").isNull().alias("_null"), F.coalesce(F.col("_row.source"), F.lit("")).alias("_src"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("_tie"), F.coalesce(F.md5(F.col("_row.doc_id").cast("string")), F.lit("")).alias("_hash"))
    base = base.withColumn("_bin", F.coalesce(F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"), F.lit(0)) % BINS)
    sizes = staged(base.drop("_row"), "mix-sizes")
    bins = sizes.groupBy("_null", "_src", "_bin").agg(F.sum("size").alias("_in_bin"))
    earlier = W.partitionBy("_null", "_src").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    starts = bins.select("_null", "_src", "_bin", F.coalesce(F.sum("_in_bin").over(earlier), F.lit(0)).alias("_start"))
    targets = schedules(source_targets(sizes, max_repeats)).select(
        "_null", "_src", "source_size", "target", _segments().alias("_segments"))
    facts = starts.join(targets, ["_null", "_src"])
    own = W.partitionBy("_null", "_src", "_bin").orderBy("_hash", "doc_id", "size", "_tie")
    running = own.rowsBetween(W.unboundedPreceding, -1)
    out = (base if keep_rows else sizes).withColumn("_before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    out = out.join(facts, ["_null", "_src", "_bin"])
    out = out.withColumn("_at", F.col("_start") + F.col("_before"))
    # use r of a document covers [r * source_size + at, ... + size); it is taken if its middle lies within the target
    uses = sum(F.when((F.col("source_size") * r + F.col("_at")) * 2 + F.col("size") <= F.col("target") * 2, 1).otherwise(0)
               for r in range(max_repeats))
    return out.withColumn("repeats", F.when(F.col("size") > 0, uses).otherwise(0).cast("int"))


def _due(use: Column) -> Column:
    """Training position of a document's ``use``-th use."""
    reached = F.col("source_size") * use + F.col("_at")
    return F.when(F.col("repeats") > 0, position(F.col("_segments"), F.least(reached / F.col("target"), F.lit(1.0))))


def mix(docs: DataFrame, max_repeats: int = MAX_REPEATS, schedules=default_schedules) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): size, source_size, target, taken, repeats, position.

    size: words of the text; a null text has none.  taken: size times repeats,
    at most ``max_repeats``.  position: where the row's first use starts in the
    training run (0 to 1), null if it is not used.  Rows are sorted by position
    over all partitions, unused ones last.

    A null source is a source of its own, last in order.  Empty texts have size 0
    and are never used.  Repeated rows follow each other and null doc_ids come
    first in their source, so that reruns agree.  If no text has a word, all
    targets are 0.  An empty table gives an empty result.  Other columns are not
    read.
    """
    out = _mix(docs, max_repeats, schedules, False).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"),
        "repeats", _due(F.lit(0)).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, max_repeats: int = MAX_REPEATS, schedules=default_schedules) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix uses them, range-sorted by the position of each use.

    Rows without words (null or empty texts) are never used.  Null sources and doc_ids,
    repeated rows and empty tables as in ``mix``.  Columns of any name are kept.
    """
    out = _mix(docs, max_repeats, schedules, True).filter("repeats > 0")
    out = out.withColumn("_use", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    out = out.withColumn("_due", _due(F.col("_use")))
    return out.orderBy("_due", "_hash").select("_row.*")
