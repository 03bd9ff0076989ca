"""Table verbs on long and wide panels.

Every function maps DataFrame -> DataFrame (or returns a Column where noted) and
is built from Spark's own expressions, windows and aggregations, so Catalyst
keeps predicate push-down, column pruning and whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajectra.session import stage

WORDS = r"[A-Za-z0-9\u0080-\uFFFF]+"     # words of phrases and texts


# --------------------------------------------------------------------------- W1


def number_visits(df: DataFrame, subject: str | Sequence[str], order: Sequence[str],
                  name: str = "wave") -> DataFrame:
    """0-based visit number within subject, over all visits.

    ``order`` must make the order total (add a tie-break key).  See
    ``number_within`` for subjects with very many visits.
    """
    keys = [subject] if isinstance(subject, str) else list(subject)
    out = number_within(df, keys, [F.col(c).asc_nulls_last() for c in order], "__rn")
    return out.withColumn(name, (F.col("__rn") - 1).cast("int")).drop("__rn")


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key group (0 for an empty table): one map-side combined count."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.agg(F.max("__n")).first()[0] or 0


# --------------------------------------------------------------------------- V1-V4


def to_wide(panel: DataFrame, subject: str, wave: str, values: Sequence[str],
            waves: Sequence[int], name_fmt: str = "{value}_{wave}") -> DataFrame:
    """Long -> wide with one column per (value, wave) (V1).

    Written as one conditional aggregate per output column, with the wave list
    given up front: the schema is fixed, no job runs to find distinct waves, and
    the aggregate is combined map-side (partial aggregation) before the single
    shuffle by subject.  If the input is already hash-partitioned by subject (it is
    after ``number_visits``) there is no shuffle at all.
    """
    aggs = [F.max(F.when(F.col(wave) == w, F.col(v))).alias(name_fmt.format(value=v, wave=w))
            for v in values for w in waves]
    return panel.groupBy(subject).agg(*aggs)


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None,
            name: str = "variable", value: str = "value",
            cast: str | None = "double") -> DataFrame:
    """Wide -> long (V3 all non-id columns, V4 a chosen list).  Narrow: no shuffle."""
    cols = list(values) if values is not None else [c for c in df.columns if c not in ids]
    src = df if cast is None else df.select(*ids, *[F.col(c).cast(cast).alias(c) for c in cols])
    return src.unpivot(list(ids), cols, name, value)


def facts_to_rows(facts: DataFrame, key: str, name: str, value: str,
                  targets: Sequence[str], order: str | None = None) -> DataFrame:
    """Long name/value facts -> one row per key with a fixed column list (V2); of a repeated fact the first by ``order``."""
    one = F.first(value) if order is None else F.min_by(value, order)
    return (facts.where(F.col(name).isin(list(targets)))
            .groupBy(key).pivot(name, list(targets)).agg(one))


# --------------------------------------------------------------------------- P*


def difference(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """A - b as a new column."""
    return df.withColumn(name, F.col(a) - F.col(b))


def add_powers(df: DataFrame, time: str, degree: int = 2, fmt: str = "{time}_p{k}") -> DataFrame:
    """time^k for k = 2..degree."""
    out = df
    for k in range(2, degree + 1):
        out = out.withColumn(fmt.format(time=time, k=k), F.pow(F.col(time), F.lit(k)))
    return out


def pick(df: DataFrame, keep: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """Select (in the given order) then drop."""
    out = df.select(*keep) if keep else df
    return out.drop(*drop) if drop else out


def pick_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """The ``keep`` columns plus all columns whose name starts with ``prefix``."""
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefix) and c not in keep])


def rename(df: DataFrame, mapping: dict[str, str] | None = None,
           by_position: dict[int, str] | None = None) -> DataFrame:
    """P5: rename by name and/or by 0-based position."""
    names = list(df.columns)
    for pos, new in (by_position or {}).items():
        names[pos] = new
    names = [(mapping or {}).get(c, c) for c in names]
    return df.toDF(*names)


def map_columns(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column],
                names: Sequence[str] | None = None, keep_others: bool = True) -> DataFrame:
    """One expression over many columns with generated names."""
    names = list(names) if names is not None else list(cols)
    mapped = [fn(F.col(c)).alias(n) for c, n in zip(cols, names)]
    others = [c for c in df.columns if c not in cols and c not in names] if keep_others else []
    return df.select(*others, *mapped)


def sentinel_to_null(df: DataFrame, cols: Sequence[str], value: float = 999) -> DataFrame:
    """Replace a sentinel by NULL in the listed columns only."""
    return df.select(*[
        F.when(F.col(c) == value, F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in cols else F.col(c) for c in df.columns])


def cast_numeric(df: DataFrame, cols: Sequence[str], to: str = "double") -> DataFrame:
    """Cast text to number; text that is not a number becomes NULL (try_cast)."""
    return df.select(*[F.col(c).try_cast(to).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def unite(df: DataFrame, name: str, cols: Sequence[str], sep: str = "_",
          remove: bool = False) -> DataFrame:
    """Join columns to text, skipping NULLs (``unite(na.rm=TRUE)``)."""
    out = df.withColumn(name, F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]))
    return out.drop(*cols) if remove else out


def constant(df: DataFrame, name: str, value, dtype: str) -> DataFrame:
    """Constant or typed-NULL column."""
    return df.withColumn(name, F.lit(value).cast(dtype))


def round_cols(df: DataFrame, cols: Sequence[str], digits: int) -> DataFrame:
    """Round the listed columns."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# --------------------------------------------------------------------------- F*


def one_wave(df: DataFrame, wave: int = 0, col: str = "wave") -> DataFrame:
    """rows of one wave.  The default is the first visit (wave 0)."""
    return df.where(F.col(col) == wave)


def keep_in(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """membership in a list; a NULL value is dropped like a false test."""
    return df.where(F.col(col).isin(list(values)))


def keep_match(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """regex match."""
    return df.where(F.col(col).rlike(pattern))


def any_pattern(patterns: Sequence[str], literal: bool = True) -> str:
    """One alternation from a list of patterns (quoted when ``literal``)."""
    import re
    return "|".join(re.escape(p) if literal else p for p in patterns)


def keep_match_any(df: DataFrame, col: str, patterns: Sequence[str], literal: bool = True) -> DataFrame:
    """match any of a list of patterns, as one alternation."""
    return df.where(F.col(col).rlike(any_pattern(patterns, literal)))


def keep_match_list(df: DataFrame, col: str, phrases: DataFrame, phrase: str = "phrase", words: str = WORDS) -> DataFrame:
    """F4 for a list of any length: the rows whose text holds at least one of the ``phrases``, as they stand.

    A phrase can only be in a text that has its words, so each phrase is looked up by
    its rarest one (counted over the texts' distinct words): words that begin or end
    inside the phrase's neighbours in the text are told apart by the exact test on what the
    join finds.  Phrases without an inner word are looked up by all texts, in one broadcast block
    per ``BROADCAST_ROWS``.  Null texts hold none; repeated rows stay.
    """
    from trajectra.operators.joins import BROADCAST_ROWS
    rows = stage(df.withColumn("__row", F.monotonically_increasing_id()), "texts")
    tokens = rows.where(F.col(col).isNotNull()).select("__row", F.explode(F.array_distinct(F.regexp_extract_all(col, F.lit(words), F.lit(0)))).alias("__w"))
    listed = phrases.select(F.col(phrase).alias("__p")).where("__p IS NOT NULL AND __p != ''").distinct()
    # the first and last word of a phrase may be parts of longer words in a text
    inner = F.regexp_extract_all("__p", F.lit(words), F.lit(0))
    inner = F.when(F.col("__p").rlike(f"^{words}"), F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 1, F.lit(0)))).otherwise(inner)
    listed = listed.withColumn("__i", inner)
    cut = F.when(F.col("__p").rlike(f"{words}$") & (F.size("__i") > 0), F.slice("__i", F.lit(1), F.size("__i") - 1)).otherwise(F.col("__i"))
    listed = stage(listed.withColumn("__i", cut), "phrases")
    asked = listed.select("__p", F.explode(F.array_distinct("__i")).alias("__w"))
    counts = tokens.join(asked.select("__w").distinct(), "__w", "left_semi").groupBy("__w").agg(F.count(F.lit(1)).alias("__n"))
    rarest = asked.join(counts, "__w", "left").groupBy("__p").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__w").alias("w"))).alias("k"))
    by_word = rarest.where("k.n > 0").select("__p", F.col("k.w").alias("__w"))
    pairs = tokens.join(by_word, "__w").select("__row", "__p")
    found = rows.join(pairs, "__row").where(F.contains(F.col(col), F.col("__p"))).select("__row")
    short = listed.where(F.size("__i") == 0).select("__p")
    n = short.count()
    for k in range(-(-n // BROADCAST_ROWS)):
        block = short.where(F.pmod(F.xxhash64("__p"), F.lit(-(-n // BROADCAST_ROWS))) == k)
        found = found.unionByName(rows.join(F.broadcast(block), F.contains(F.col(col), F.col("__p"))).select("__row"))
    return rows.join(found.distinct(), "__row", "left_semi").drop("__row")


def keep_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """rows where all listed columns are present."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


# --------------------------------------------------------------------------- D*


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """D1."""
    return df.select(col).distinct()


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct on the given columns (all when None)."""
    return (df.select(*cols) if cols else df).distinct()


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """D3: first row per key in a stated order (not dropDuplicates: order is defined).

    Filtering ``row_number() == 1`` lets Catalyst add a partial group limit before
    the shuffle, so a hot key forwards one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def dense_index(df: DataFrame, order: Sequence[Column | str], name: str = "id") -> DataFrame:
    """1-based consecutive index of the rows of ``df`` in ``order``, without a
    single-partition window.

    The rows are range-sorted across partitions, tagged with
    ``monotonically_increasing_id`` (partition id in the high bits, position in
    the low bits) and staged in the checkpoint folder so the tags are stable.
    A table of one count per partition (bounded by the partition count, not by
    the data) gives each partition its offset; it is the only thing broadcast.
    """
    return number_rows(df.orderBy(*order), name)


def number_rows(df: DataFrame, name: str = "id") -> DataFrame:
    """1-based number of each row of a sorted ``df`` (see ``dense_index``)."""
    ranked = stage(df.withColumn("__mid", F.monotonically_increasing_id()), "ranked")
    pid = (F.col("__mid") / F.lit(1 << 33)).cast("long")
    counts = ranked.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__pid",
        F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__off"))
    return (ranked.withColumn("__pid", pid)
            .join(F.broadcast(offsets), "__pid")
            .withColumn(name, F.col("__off") + (F.col("__mid") - F.col("__pid") * F.lit(1 << 33)) + 1)
            .drop("__pid", "__off", "__mid"))


HOT_ROWS = 1_000_000        # a key group above this many rows is not numbered in one task


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                  name: str = "rn", hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based row number within each key group (NULL keys group together).

    Groups of up to ``hot_rows`` rows are numbered by one window: one exchange of
    the data.  The rows of larger groups are split off and range-sorted on (keys,
    order) over all partitions instead, numbered as a whole (``dense_index``), and
    shifted by their group's first number.  There are at most rows / ``hot_rows``
    such groups, which bounds what is broadcast.
    """
    keys = list(keys)
    if largest_group(df, keys) <= hot_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    alias = [f"__k_{i}" for i in range(len(keys))]
    hot = df.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, alias)]).agg(
        F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).drop("__n").withColumn("__hot", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, alias)])
    marked = df.join(F.broadcast(hot), same, "left").drop(*alias)
    cold = marked.where(F.col("__hot").isNull()).drop("__hot")
    cold = cold.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    idx = dense_index(marked.where(F.col("__hot")).drop("__hot"),
                      [F.col(k).asc_nulls_first() for k in keys] + list(order), "__gidx")
    first = idx.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, alias)]).agg(F.min("__gidx").alias("__first"))
    out = idx.join(F.broadcast(first), same)
    out = out.withColumn(name, (F.col("__gidx") - F.col("__first") + 1).cast("long")).drop("__gidx", "__first", *alias)
    return cold.unionByName(out)


def surrogate_id(df: DataFrame, keys: Sequence[str], name: str = "id",
                 order: Sequence[Column | str] | None = None) -> DataFrame:
    """Dense 1-based id over distinct keys, joined back (NULL keys get an id too).

    Only the distinct keys are numbered (``dense_index``); the id table is
    broadcast when it is small, so the data is not exchanged on a few keys.
    """
    from trajectra.operators.joins import checked_broadcast, left_null_safe
    order = list(order) if order is not None else [F.col(k).asc_nulls_last() for k in keys]
    ids = dense_index(df.select(*keys).distinct(), order, name)
    ids = ids.select(*[F.col(k).alias(f"__id_{k}") for k in keys], name)
    return left_null_safe(df, checked_broadcast(ids), [(k, f"__id_{k}") for k in keys])


# --------------------------------------------------------------------------- O*, U*


def sort_missing_last(df: DataFrame, keys: Sequence[str], descending: Sequence[bool] | None = None) -> DataFrame:
    """O1: sort ascending (or descending) with NULLs last, as dplyr's arrange."""
    descending = list(descending) if descending is not None else [False] * len(keys)
    return df.orderBy(*[F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_last()
                        for k, d in zip(keys, descending)])


def head(df: DataFrame, keys: Sequence[str], n: int, descending: Sequence[bool] | None = None) -> DataFrame:
    """O2: first n rows in key order (TakeOrderedAndProject: top-n per task, then merged)."""
    return sort_missing_last(df, keys, descending).limit(n)


def stack(*dfs: DataFrame) -> DataFrame:
    """Union by name, absent columns filled with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def append_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows (by name, absent columns NULL)."""
    return df.unionByName(rows, allowMissingColumns=True)


# --------------------------------------------------------------------------- W2, W3, W6


def score_vectors(panel: DataFrame, subject: str = "subject", wave: str = "wave", y: str = "y", name: str = "vector") -> DataFrame:
    """One row per subject with all its scores, in wave order, as one text key ('.' for a missing one).

    The key stands for every wave the subject has, however many the panel has; equal
    keys are equal score vectors.
    """
    cell = F.struct(F.col(wave).alias("w"), F.coalesce(F.col(y).cast("string"), F.lit(".")).alias("v"))
    return panel.groupBy(subject).agg(F.sort_array(F.collect_list(cell)).alias("__v")).select(
        subject, F.concat_ws(",", F.transform("__v", lambda c: F.concat_ws(":", c["w"].cast("string"), c["v"]))).alias(name))


def number_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                    name: str = "n_in_group") -> DataFrame:
    """Row number within a group of identical key vectors (NULL keys group together)."""
    return number_within(df, keys, order, name)


def position_in_block(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                      width: int, pos: str = "pos", block: str = "block",
                      within: str = "pos_in_block") -> DataFrame:
    """W3 + P10: position within a group, its block number and position in the block."""
    from trajectra.functions.columns import block_number
    out = number_within(df, keys, order, pos)
    return (out.withColumn(block, block_number(F.col(pos), width))
               .withColumn(within, ((F.col(pos) - 1) % width).cast("int")))


def ordered_id(df: DataFrame, col: str, custom_order: Sequence, name: str = "order_id") -> DataFrame:
    """1-based id of each distinct value by its place in a custom list.

    Values not in the list come after it, in natural order.  The rank is a CASE
    expression (no join); numbering runs over the distinct values only.
    """
    from trajectra.functions.columns import list_rank
    return surrogate_id(df, [col], name, [list_rank(F.col(col), custom_order).asc(), F.col(col).asc_nulls_last()])
