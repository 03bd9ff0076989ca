"""Sharding by Karmarkar-Karp differencing.

Documents with equal texts form one indivisible group.  Groups are dealt by hash
into buckets of bounded size; inside a bucket, the two partial partitions with
the largest spread are combined again and again, one's largest part with the
other's smallest.  Each bucket ends as one partial partition of ``shards`` sums,
and those are the items of the next level, until one partition is left.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.llm.common import attach, number_in_groups, prepare, staged, text_key

PER_BUCKET = 2_000      # items that one task differences at a time


def difference(vectors: list[list[int]], shards: int) -> list[list[int]]:
    """Karmarkar-Karp over vectors of ``shards`` part sums.

    Returns, for each vector, the final part of each of its parts.  Ties are
    broken by position, so equal input gives equal output.
    """
    n = len(vectors)
    own = []                       # per input: parts in falling order of size
    heap, sums = [], {}
    for i, v in enumerate(vectors):
        rank = sorted(range(shards), key=lambda p: (-v[p], p))
        own.append(rank)
        s = [v[p] for p in rank]
        sums[i] = s
        heap.append((s[-1] - s[0], i))
    heapq.heapify(heap)
    merges = []
    node = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sa, sb = sums.pop(a), sums.pop(b)
        both = [x + y for x, y in zip(sa, reversed(sb))]
        rank = sorted(range(shards), key=lambda p: -both[p])
        s = [both[p] for p in rank]
        sums[node] = s
        merges.append((a, b, rank))
        heapq.heappush(heap, (s[-1] - s[0], node))
        node += 1
    final = {node - 1: list(range(shards))}
    for top in range(node - 1, n - 1, -1):
        a, b, rank = merges[top - n]
        at = final.pop(top)
        ma, mb = [0] * shards, [0] * shards
        for j, p in enumerate(rank):
            ma[p] = at[j]
            mb[shards - 1 - p] = at[j]
        final[a], final[b] = ma, mb
    out = []
    for i in range(n):
        parts = [0] * shards
        for j, p in enumerate(own[i]):
            parts[p] = final[i][j]
        out.append(parts)
    return out


def _difference_bucket(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "part"], kind="stable")
        items = pdf["item"].drop_duplicates().tolist()
        at = {k: i for i, k in enumerate(items)}
        vectors = [[0] * shards for _ in items]
        rows = list(zip(pdf["item"].tolist(), pdf["part"].tolist(), pdf["size"].tolist()))
        for k, p, s in rows:
            vectors[at[k]][p] = s
        maps = difference(vectors, shards)
        return pd.DataFrame({"item": [r[0] for r in rows], "part": pd.array([r[1] for r in rows], "int32"),
                             "to": pd.array([maps[at[k]][p] for k, p, _ in rows], "int32"),
                             "size": [r[2] for r in rows], "bucket": pdf["bucket"].iloc[0]})
    return run


def place_groups(groups: DataFrame, shards: int, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``groups`` (item string, size long; a staged table) -> (item, shard).

    Each level reads a table ``per_bucket`` times smaller (times ``shards``), so
    the number of levels is logarithmic and no task sees more than a few
    thousand items.
    """
    per_bucket = max(per_bucket, 2 * shards)
    prepare(groups.sparkSession)
    schema = "item string, part int, to int, size long, bucket long"
    level = groups.select("item", F.lit(0).alias("part"), "size")
    n, out = groups.count(), None
    while True:
        buckets = -(-n // per_bucket)
        done = staged(level.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(max(1, buckets))))
                      .groupBy("bucket").applyInPandas(_difference_bucket(shards), schema), "kk")
        if out is None:
            out = done.select("item", F.col("bucket").cast("string").alias("_up"), F.col("to").alias("_part"))
        else:
            step = done.select(F.col("item").alias("_i"), F.col("part").alias("_p"),
                               F.col("bucket").cast("string").alias("_u"), F.col("to").alias("_t"))
            out = out.join(step, (F.col("_up") == F.col("_i")) & (F.col("_part") == F.col("_p"))).select(
                "item", F.col("_u").alias("_up"), F.col("_t").alias("_part"))
        if buckets <= 1:
            return out.select("item", F.col("_part").alias("shard"))
        level = done.groupBy(F.col("bucket").cast("string").alias("item"), F.col("to").alias("part")).agg(
            F.sum("size").alias("size"))
        n = buckets


def shard_documents(docs: DataFrame, shards: int = 16, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into a shard of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'), shard,
    slot (gapless from 0 inside the shard) and grown_shard (null for this law).

    Null texts count as empty ones: size 1, crc32 0, in the group of the empty
    texts.  Repeated rows are rows of their own, with a slot each, in one shard.
    Null doc_ids are kept.  An empty table gives an empty result.  Other columns
    are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                              F.crc32(text.cast("binary")).alias("text_crc32"), text_key(F.col("text")).alias("item")), "sizes")
    total = rows.count()
    groups = staged(rows.groupBy("item").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("size")), "groups")
    placed = place_groups(groups, shards, per_bucket).join(groups.select(F.col("item").alias("_k"), "copies"),
                                                           F.col("item") == F.col("_k")).select("item", "shard", "copies")
    with_shard = attach(rows, placed, "item", "copies", total, F.xxhash64("doc_id", F.monotonically_increasing_id()))
    with_shard = staged(with_shard.select("doc_id", "size", "text_crc32", "shard", "item"), "sharded")
    out = number_in_groups(with_shard, "shard", ["doc_id", "item"], total // shards, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
