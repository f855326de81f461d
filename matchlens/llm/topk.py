"""Operator 11: exact top-k search by inner product, over statistics of segments.

A vector is cut into segments at several resolutions. With the mean and the deviation of each
segment (L components), the squared distance of two vectors is at least the sum of
L * ((difference of means)^2 + (difference of deviations)^2). As the squared length of a vector is
the sum of L * (mean^2 + deviation^2), a distance that is at least D means an inner product of
at most (|q|^2 + |x|^2 - D) / 2, and that is the product of the two rows of statistics, each
scaled by the root of L. Candidates whose bound stays below the k-th best score so far are
dropped, coarse to fine; those left are multiplied out in whole numbers.

Queries go in blocks of bounded size, broadcast one at a time; candidates stay where they are.
A task keeps the k best of its candidates for each query, so what is shuffled is k rows a query
and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlens.llm.store import fresh_path, partitions, ship, written
from matchlens.llm.vectors import LEAST, as_longs, exact, usable, whole, widest

NEAREST, EVERY = 5, 50
#: Numbers in a block of queries (32 MB as doubles); rows compared at once.
BLOCK_CELLS, QUERIES, CANDIDATES = 1 << 22, 512, 4096
#: Queries that give a task its first bounds.
FIRST = 256
#: Whole numbers below it are exact in a double.
EXACT = 1 << 53


def resolutions(width: int) -> list[int]:
    """Numbers of segments, coarse to fine: each four times the last, down to two components."""
    counts, n = [], 1
    while n * 2 <= width:
        counts.append(n)
        n *= 4
    return counts + [width // 2] if width > 2 and counts[-1] != width // 2 else counts


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments of each row, scaled by the root of their length."""
    edges = np.arange(segments + 1) * rows.shape[1] // segments
    lengths = np.diff(edges)
    means = np.add.reduceat(rows, edges[:-1], axis=1) / lengths
    centred = rows - np.repeat(means, lengths, axis=1)
    spread = np.sqrt(np.add.reduceat(centred * centred, edges[:-1], axis=1))
    return np.hstack([means * np.sqrt(lengths), spread])


class Side:
    """Rows to compare, with what is known of them at each resolution."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.largest = np.abs(rows).max(initial=0)
        # lengths and statistics of a scaled copy, so that no square leaves the range of a double
        self.unit = max(self.largest, 1.0)
        scaled = rows / self.unit
        self.length = np.sqrt((scaled * scaled).sum(axis=1))
        self.levels = [statistics(scaled, n) for n in resolutions(rows.shape[1])]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; beyond the range of a long, the nearest long."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    return as_longs(a @ b.T if top < EXACT else exact(a).dot(exact(b).T))


def survivors(queries: Side, at: slice, candidates: Side, least: np.ndarray) -> np.ndarray:
    """Which candidates may reach the score ``least`` of each query of ``at``."""
    # what rounding does to a bound lies well below this share of the lengths
    margin = 1e-9 * np.outer(queries.length[at], candidates.length)
    wanted = least.astype(np.float64) / queries.unit / candidates.unit
    wanted = np.where(least == LEAST, -np.inf, wanted * (1 - 1e-15 * np.sign(wanted)))[:, None] - margin
    alive = np.ones(wanted.shape, dtype=bool)
    for mine, theirs in zip(queries.levels, candidates.levels, strict=True):
        columns = np.flatnonzero(alive.any(axis=0))
        alive[:, columns] &= mine[at] @ theirs[columns].T >= wanted[:, columns]
    return alive


class Best:
    """The ``k`` best candidates of each query so far; ties go to the smaller (id, row)."""

    def __init__(self, queries: int, k: int):
        self.k = k
        #: score, whether the id is null, id, row
        self.found = [np.empty((4, 0), dtype=np.int64)] * queries
        self.least = np.full(queries, LEAST)

    def add(self, query: int, new: np.ndarray) -> None:
        both = np.hstack([self.found[query], new])
        # the complement turns the order around without leaving the range of a long
        order = np.lexsort((both[3], both[2], both[1], ~both[0]))[: self.k]
        self.found[query] = both[:, order]
        if len(order) == self.k:
            self.least[query] = both[0, order[-1]]


def _least_among_first(queries: Side, own: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the first queries, its own row left out."""
    least = np.full(len(own), LEAST)
    if min(FIRST, len(own)) <= k:
        return least
    for begin in range(0, len(own), QUERIES):
        at = slice(begin, begin + QUERIES)
        found = scores(queries.rows[at], queries.rows[:FIRST])
        found[own[at, None] == own[None, :FIRST]] = LEAST
        least[at] = np.sort(found, axis=1)[:, -k]
    return least


def _look(queries: Side, own, candidates: Side, names: np.ndarray, best: Best, floor) -> None:
    for begin in range(0, len(own), QUERIES):
        at = slice(begin, min(begin + QUERIES, len(own)))
        alive = survivors(queries, at, candidates, np.maximum(best.least[at], floor[at]))
        alive &= own[at, None] != names[None, 2]
        columns = np.flatnonzero(alive.any(axis=0))
        found = scores(queries.rows[at], candidates.rows[columns])
        alive = alive[:, columns] & (found >= best.least[at, None])
        for i in np.flatnonzero(alive.any(axis=1)):
            here = np.flatnonzero(alive[i])
            best.add(begin + i, np.vstack([found[i, here], names[:, columns[here]]]))


def _searcher(block, width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors = block.value
        queries, best, floor = Side(vectors), Best(len(own), k), None
        for batch in batches:
            if floor is None:
                floor = _least_among_first(queries, own, k)
            none = np.asarray(batch.column(1).is_null(), dtype=np.int64)
            names = np.stack([none, batch.column(1).fill_null(0).to_numpy(), batch.column(0).to_numpy()])
            for begin in range(0, batch.num_rows, CANDIDATES):
                rows = whole(batch.column(2).slice(begin, CANDIDATES), width)
                _look(queries, own, Side(rows), names[:, begin : begin + CANDIDATES], best, floor)
        for begin in range(0, len(own), QUERIES):
            found = best.found[begin : begin + QUERIES]
            score, null, ids, row = np.hstack(found)
            mine = np.repeat(own[begin : begin + QUERIES], [f.shape[1] for f in found])
            ids = pa.array(ids, mask=null == 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine), pa.array(row), ids, pa.array(score)], names=["query", "row", "vec_id", "score"]
            )

    return run


def _blocks(queries: DataFrame, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, vectors) of the queries, in blocks of bounded size."""
    size = max(1, BLOCK_CELLS // max(width, 1))
    queries = written(queries.repartitionByRange(partitions(queries.sparkSession), "row"), "queries")
    last = -1
    while True:
        block = queries.where(F.col("row") > last).orderBy("row").limit(size).toArrow()
        if not block.num_rows:
            return
        own = block.column("row").to_numpy()
        yield own, whole(block.column("vector").combine_chunks(), width)
        if block.num_rows < size:
            return
        last = int(own[-1])


def nearest(
    vectors: DataFrame, is_query, k: int = NEAREST, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` where ``is_query`` holds, the
    ``k`` other rows with the highest inner products of floor(256 * component).

    Ties go to the smaller id, null ids last, then to the row that was written first. Rows whose
    vector is null or has a null or non-finite component take no part. A row is left out of its
    own result only: of repeated rows, each is a query and a candidate of the others. Shorter
    vectors count as filled up with zeros, an empty one as all zeros. Scores beyond the range of a
    long count as the nearest long. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(usable(vector)).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("long").alias("vec_id"),
        F.col(vector).alias("vector"),
        is_query.alias("is_query"),
    )
    rows = written(rows, "vectors")
    width = widest(rows, "vector")
    candidates, queries = rows.drop("is_query"), rows.where("is_query")
    path, found = fresh_path(spark, "nearest"), "query long, row long, vec_id long, score long"
    queries.limit(0).select(F.lit(0).cast("long").alias("query"), "row", "vec_id",
                            F.lit(0).cast("long").alias("score")).write.parquet(path)
    for own, block in _blocks(queries, width):
        held = spark.sparkContext.broadcast((own, block))
        part = candidates.mapInArrow(_searcher(held, width, k), found)
        part.write.mode("append").parquet(path)
        held.unpersist()
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    ranked = spark.read.schema(found).parquet(path).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))
    )
    ids = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.where(F.col("rank") <= k).join(ids, "query").select("query_id", "rank", "vec_id", "score")


def op11_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose vec_id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL
        AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(
        list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM kept q JOIN kept c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
