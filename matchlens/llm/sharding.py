"""Operator 3: shards of near-equal bytes that keep equal texts together.

Differencing: a partial partition is a tuple of sums, one per part. The two with the largest
spread are combined, the largest part of one with the smallest of the other, until one is
left. Groups of equal texts are first dealt over blocks of bounded size, which are differenced
in parallel; the tuples that blocks come to are differenced again, a thousand at a time, until
one is left. No step sees more than a block.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm.store import numbered, ship, written

SHARDS = 16
#: Groups in a block, on average; partial partitions combined by one task.
BLOCK, FAN_IN = 1 << 15, 1 << 10


def difference(tuples: np.ndarray) -> np.ndarray:
    """For n tuples of sums, each in descending order: the final part of each of their parts."""
    n, parts = tuples.shape
    sums = list(tuples)
    heap = [(int(t[-1] - t[0]), i) for i, t in enumerate(sums)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[a] = sums[b] = None
        heapq.heappush(heap, (int(total[-1] - total[0]), len(sums)))
        sums.append(total)
        merges.append((a, b, order))
    final = {n + len(merges) - 1: np.arange(parts)} if n else {}
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        here = np.empty(parts, dtype=np.int64)
        here[order] = final.pop(n + k)  # part ``order[j]`` of a became part j
        final[a], final[b] = here, here[::-1]
    return np.array([final[i] for i in range(n)]).reshape(n, parts)


def _balance_groups(shards: int):
    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "text_key"], ascending=[False, True])
        tuples = np.zeros((len(groups), shards), dtype=np.int64)
        tuples[:, 0] = groups["bytes"]
        return groups.assign(part=difference(tuples)[:, 0])

    return run


def _balance_blocks(shards: int):
    def run(sums: pd.DataFrame) -> pd.DataFrame:
        wide = sums.pivot_table(index="block", columns="part", values="bytes", fill_value=0)
        wide = wide.reindex(columns=range(shards), fill_value=0).sort_index()
        table = wide.to_numpy(dtype=np.int64)
        order = np.argsort(-table, axis=1, kind="stable")
        final = difference(np.take_along_axis(table, order, axis=1))
        whole = np.empty_like(final)
        np.put_along_axis(whole, order, final, axis=1)
        blocks = np.repeat(wide.index.to_numpy(), shards)
        parts = np.tile(np.arange(shards), len(wide))
        return pd.DataFrame({"block": blocks, "part": parts, "new_part": whole.ravel()})

    return run


def shard_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add ``part`` (0 to ``shards`` - 1) to the rows of ``groups`` (text_key, bytes): sums of
    ``bytes`` near equal, each row indivisible. Every text_key is there once."""
    ship(groups.sparkSession)
    groups = written(groups.select("text_key", "bytes"), "groups")
    blocks = max(1, math.ceil(groups.count() / BLOCK))
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("text_key"), F.lit(blocks)))
    schema = f"text_key {dict(groups.dtypes)['text_key']}, bytes long, block long, part long"
    placed = dealt.groupBy("block").applyInPandas(_balance_groups(shards), schema)
    placed = written(placed, "placed")
    while blocks > 1:
        blocks = math.ceil(blocks / FAN_IN)
        sums = placed.groupBy("block", "part").agg(F.sum("bytes").alias("bytes"))
        moves = (
            sums.withColumn("above", F.floor(F.col("block") / FAN_IN))
            .groupBy("above")
            .applyInPandas(_balance_blocks(shards), "block long, part long, new_part long")
        )
        placed = written(
            placed.join(moves, ["block", "part"]).select(
                "text_key",
                "bytes",
                F.floor(F.col("block") / FAN_IN).alias("block"),
                F.col("new_part").alias("part"),
            ),
            "placed",
        )
    return placed.select("text_key", "part")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    Law ``bytes``: sums of ``size`` near equal, equal texts together (null and empty texts are
    equal). ``slot`` is gapless from 0 in each shard. Repeated rows are placed each. An empty
    table gives no rows; other columns are ignored. A group of copies is never gathered: it
    counts as one number, and its rows are joined to its shard and numbered in buckets.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("text_key"),
        ),
        "sizes",
    )
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"))
    placed = rows.join(shard_groups(groups, shards), "text_key").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("part").cast("int").alias("shard"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    placed = written(placed, "sharded")
    return numbered(placed, "shard", ["doc_id", "text_crc32", "size"], "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 of near-equal bytes."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
