"""Operator 12: vector codes by product quantization, in whole numbers throughout.

Vectors are cut into parts; each part has a codebook. To find the nearest entry, parts and
entries are filled up with zeros to a power of two P and put through the Walsh-Hadamard
transform, which only adds and subtracts and scales each squared distance by P. The squared
differences of coefficients are added up in sequency order, slow ones first, as these hold most of
a smooth part; an entry whose sum is past that of a known one is dropped before the rest is
looked at. What is left has its exact distance.

A round is one pass over the vectors. Each task sums its parts by entry, so a round shuffles one
row a task, part and entry, and only the codebooks reach the driver: ``entries`` vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm.store import free_name, ship, written
from matchlens.llm.vectors import MOST, as_longs, exact, usable, whole, widest

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors looked at together.
TOGETHER = 1024


def sequency_order(size: int) -> np.ndarray:
    """For a power of two: the Hadamard matrix, its rows by their number of changes of sign."""
    matrix = np.ones((1, 1), dtype=np.int64)
    while len(matrix) < size:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[np.argsort((np.diff(matrix, axis=1) != 0).sum(axis=1), kind="stable")]


class Books:
    """Codebooks (part, entry, position) of whole numbers, ready to find nearest entries."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.parts, self.entries, self.length = books.shape
        self.size = 1 << max(0, self.length - 1).bit_length()
        self.matrix = sequency_order(self.size)[:, : self.length]
        self.largest = max((abs(int(v)) for v in books.ravel()), default=0)
        self.changed = {}

    def _transformed(self, kind) -> np.ndarray:
        """(coefficient, part, entry), as numbers of this kind; made once."""
        if kind not in self.changed:
            found = self.books.astype(kind) @ self.matrix.T.astype(kind)
            self.changed[kind] = np.ascontiguousarray(np.moveaxis(found, 2, 0))
        return self.changed[kind]

    def whole_numbers(self, rows: np.ndarray) -> np.ndarray:
        """``rows`` of doubles as (row, part, position): longs where no sum can leave their range."""
        top = max(np.abs(rows).max(initial=0), self.largest)
        fits = 4 * float(top) ** 2 * self.size**3 < MOST
        rows = rows.astype(np.int64) if fits else exact(rows)
        return rows.reshape(len(rows), self.parts, self.length)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each (row, part); ties go to the lower entry."""
        kind = vectors.dtype
        mine = np.moveaxis(vectors @ self.matrix.T.astype(kind), 2, 0)
        theirs = self._transformed(np.dtype(kind))
        first = (mine[0][:, :, None] - theirs[0]) ** 2
        likely = first.argmin(axis=2)
        part = np.arange(self.parts)
        known = sum((mine[c] - theirs[c][part, likely]) ** 2 for c in range(self.size))
        cell, entry = np.nonzero((first <= known[:, :, None]).reshape(-1, self.entries))
        sums, known = first.reshape(-1, self.entries)[cell, entry], known.ravel()
        of_part = cell % self.parts
        for c in range(1, self.size):
            gap = mine[c].ravel()[cell] - theirs[c][of_part, entry]
            sums = sums + gap * gap
            alive = (sums <= known[cell]).astype(bool)
            cell, entry, sums, of_part = cell[alive], entry[alive], sums[alive], of_part[alive]
        # cells are ascending and each still has an entry, entries ascend in each
        begins = np.flatnonzero(np.diff(cell, prepend=-1))
        least = np.minimum.reduceat(sums, begins) if len(begins) else sums
        is_least = (sums == np.repeat(least, np.diff([*begins, len(cell)]))).astype(bool)
        chosen = np.minimum.reduceat(np.where(is_least, entry, self.entries), begins) if len(begins) else entry
        shape = vectors.shape[:2]
        return chosen.reshape(shape), (least // self.size).reshape(shape)


def _chunks(batches: Iterator[pa.RecordBatch], column: int, books: Books):
    for batch in batches:
        for begin in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(begin, TOGETHER)
            yield part, books.whole_numbers(whole(part.column(column), books.parts * books.length))


def _summing(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Books(given.value)
        cells = books.parts * books.entries
        sums = np.zeros((cells, books.length), dtype=object)
        counts = np.zeros(cells, dtype=np.int64)
        for _, vectors in _chunks(batches, 0, books):
            entry, _ = books.nearest(vectors)
            cell = (entry + np.arange(books.parts) * books.entries).ravel()
            order = np.argsort(cell, kind="stable")
            begins = np.flatnonzero(np.diff(cell[order], prepend=-1))
            found = np.add.reduceat(vectors.reshape(-1, books.length)[order], begins, axis=0)
            sums[cell[order][begins]] += found
            counts += np.bincount(cell, minlength=cells)
        used = np.flatnonzero(counts)
        values = [(int(c), [str(v) for v in sums[c]], int(counts[c])) for c in used]
        if values:
            cell, total, count = zip(*values, strict=True)
            total = pa.array(total, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), total, pa.array(count)],
                                             names=["cell", "sums", "count"])

    return run


def _coding(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Books(given.value)
        for batch, vectors in _chunks(batches, 2, books):
            entry, error = books.nearest(vectors)
            codes = [row.astype(np.uint8).tobytes().hex() for row in entry]
            error = as_longs(error.sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def _as_books(rows: np.ndarray, parts: int) -> np.ndarray:
    """(part, entry, position) of rows that become the entries of all parts."""
    cut = exact(rows).reshape(len(rows), parts, rows.shape[1] // parts)
    return np.ascontiguousarray(np.moveaxis(cut, 0, 1))


def _wide(books: np.ndarray):
    """As longs where all fit: they travel faster than objects."""
    top = max((abs(int(v)) for v in books.ravel()), default=0)
    return books.astype(np.int64) if top <= MOST else books


def train(vectors: DataFrame, first: np.ndarray, parts: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, position) after ``rounds`` over ``vectors`` (vector). ``first`` are
    the rows whose parts the codebooks start as."""
    books = _as_books(first, parts)
    for _ in range(rounds):
        given = vectors.sparkSession.sparkContext.broadcast(_wide(books))
        sums = vectors.mapInArrow(_summing(given), "cell long, sums array<string>, count long")
        # a row a part and entry of each task; the sums of one of them are added up in one task
        place = sums.select("cell", "count", F.posexplode("sums").alias("at", "value"))
        found = place.groupBy("cell", "at").agg(
            F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.sum("count").alias("count")
        )
        books = books.copy()
        for row in found.collect():  # at most one for each number of the codebooks
            part, entry = divmod(row["cell"], books.shape[1])
            books[part, entry, row["at"]] = int(row["total"]) // row["count"]
        given.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row with a usable vector.

    Rows whose vector is null or has a null or non-finite component are left out. Codebooks
    start with the ``entries`` rows of smallest (id, vector), null ids last; fewer rows make
    smaller codebooks. All vectors are filled up with zeros to the longest, and that to a multiple
    of ``parts``. Ties go to the lower entry. Repeated rows are coded each and count each;
    other columns are ignored; an empty table gives no rows. ``entries`` is at most 256. Errors
    beyond the range of a long count as the largest long.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(usable(vector)).select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")
    )
    width = -(-max(widest(rows, "vector"), 1) // parts) * parts
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = rows.orderBy(*order).limit(entries).toArrow()
    books = train(rows.select("vector"), whole(first.column("vector").combine_chunks(), width), parts, rounds)
    given = spark.sparkContext.broadcast(_wide(books))
    kind = dict(rows.dtypes)["label"]
    schema = f"vec_id long, label {kind}, code string, error long"
    coded = written(rows.mapInArrow(_coding(given), schema), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long")
    same = free_name(coded, "same")
    per_label = coded.groupBy(F.col("label").alias(same)).agg(total.alias("label_error"))
    per_label = written(per_label, "labels")
    return coded.join(per_label, coded["label"].eqNullSafe(per_label[same])).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def op12_walsh_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, with their errors."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(n: int) -> str:
    """SQL of an assignment to the codebooks ``book{n}``: ``coded{n}`` (row, part, entry, error)."""
    return f"""
coded{n} AS (
    SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
        SELECT x.r, x.p, b.e, CAST(sum((x.v - b.v) * (x.v - b.v)) AS BIGINT) AS d
        FROM cells x JOIN book{n} b ON x.p = b.p AND x.i = b.i GROUP BY x.r, x.p, b.e)
    GROUP BY r, p)"""


def _next_sql(n: int) -> str:
    return f"""
mean{n} AS (
    SELECT c.p, c.e, x.i, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n
    FROM coded{n} c JOIN cells x ON c.r = x.r AND c.p = x.p GROUP BY c.p, c.e, x.i),
book{n + 1} AS (
    SELECT b.p, b.e, b.i, CASE WHEN m.n IS NULL THEN b.v
        ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS v
    FROM book{n} b LEFT JOIN mean{n} m ON b.p = m.p AND b.e = m.e AND b.i = m.i)"""


ORACLE = f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding AS v FROM embeddings
    WHERE embedding IS NOT NULL
        AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
placed AS (
    SELECT r, unnest(range(len(v))) AS j, len(v) // {PARTS} AS w,
        CAST(floor(256 * unnest(v)::DOUBLE) AS BIGINT) AS v FROM kept),
cells AS MATERIALIZED (SELECT r, j // w AS p, j % w AS i, v FROM placed),
book0 AS (SELECT p, r AS e, i, v FROM cells WHERE r < {ENTRIES}),
{_round_sql(0)},{_next_sql(0)},{_round_sql(1)},{_next_sql(1)},{_round_sql(2)},
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book2),
summed AS (
    SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code,
        CAST(sum(d) AS BIGINT) AS error FROM coded2 GROUP BY r)
SELECT vec_id, code, error,
    CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN summed USING (r), digest
"""
