"""Operator 2: pack documents into as few sequences of bounded length as possible.

The packing is decided on the histogram of piece lengths, which has at most ``capacity``
entries however many documents there are. First dominance reduction fixes small sets that
some best packing contains (a piece that nothing fits beside, two pieces that fill a sequence
exactly, a piece beside which only one more fits, with the longest that does). What is left
is packed best-fit, longest first. Both work on whole counts: n pieces of one length go to n
(or n/k) consecutive sequences at once, so the decision is a short list of *runs*, and each
piece finds its own place from its length and its number among the pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm import tokens
from matchlens.llm.store import numbered, ship, written

CAPACITY = 2048
SEPARATOR_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Run(NamedTuple):
    """Pieces number ``first`` to ``last`` - 1 of ``length``, ``each`` to a sequence from
    ``sequence`` on, behind the ``offset`` ids that are there already."""

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


class _Packing:
    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = {n: c for n, c in counts.items() if c}
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.taken: dict[int, int] = defaultdict(int)
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: (first, n)

    def place(self, length: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        first = self.taken[length]
        self.runs.append(Run(length, first, first + pieces, sequence, each, offset))
        self.taken[length] += pieces
        self.left[length] -= pieces
        if not self.left[length]:
            del self.left[length]

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def fix_dominating(self) -> bool:
        """One pass over the lengths, longest first; whether anything was fixed."""
        fixed, lengths = False, sorted(self.left)
        for x in reversed(lengths):
            while x in self.left:
                room, here = self.capacity - x, lengths[: bisect_right(lengths, self.capacity - x)]
                here = [y for y in here if self.left.get(y, 0) - (y == x) > 0]
                if not here:
                    n = self.left[x]
                    self.place(x, n, self.new(n), 1, 0)
                    fixed = True
                    break
                y, small = here[-1], here[0]
                second = small if self.left[small] - (small == x) > 1 else (*here, room)[1]
                if y != room and small + second <= room:
                    break
                fixed = True
                if x == y:
                    n = self.left[x] // 2
                    self.place(x, 2 * n, self.new(n), 2, 0)
                else:
                    n = min(self.left[x], self.left[y])
                    sequence = self.new(n)
                    self.place(x, n, sequence, 1, 0)
                    self.place(y, n, sequence, 1, x)
        return fixed

    def best_fit(self) -> None:
        """Each piece into the sequence with the least room that it fits; longest first."""
        for length in sorted(self.left, reverse=True):
            while (c := self.left.get(length, 0)) > 0:
                room = next((r for r in range(length, self.capacity + 1) if self.open[r]), 0)
                if room:
                    sequence, n = self.open[room].pop()
                else:
                    room, n = self.capacity, -(-c // (self.capacity // length))
                    sequence = self.new(n)
                each = min(room // length, c)
                full = min(n, c // each)
                self.place(length, full * each, sequence, each, self.capacity - room)
                if full < n:
                    self.open[room].append((sequence + full, n - full))
                if rest := room - each * length:
                    self.open[rest].append((sequence, full))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Where the pieces of each length (1 to ``capacity``) go."""
    packing = _Packing(counts, capacity)
    while packing.fix_dominating():
        pass
    packing.best_fit()
    return packing.runs


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids by the tokenizer
    and a separator, cut into pieces of ``capacity`` ids where longer. Null text: only the
    separator. Each row of ``docs`` is a document of its own, also if doc_ids repeat."""
    ship(docs.sparkSession)
    path = vocabulary or tokens.vocabulary_path()
    separator = np.uint32(SEPARATOR_ID).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = tokens.encoder(path), 4 * capacity
        for batch in batches:
            rows = []
            ids_of = encoder.encode(batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                ids += separator
                for k, at in enumerate(range(0, len(ids), size)):
                    piece = ids[at : at + size]
                    rows.append((doc_id, k, k * capacity, len(piece) // 4, zlib.crc32(piece)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, PIECES
    )


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (lengths from 1 to ``capacity``).

    Only the histogram of lengths reaches the driver. Pieces of equal length are
    interchangeable; they are numbered by hash buckets of (doc_id, piece), so also a length
    that a third of all pieces share is numbered in many tasks.
    """
    ship(pieces.sparkSession)
    pieces = written(pieces, "pieces")
    counts = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    runs = sorted(plan(dict(map(tuple, counts)), capacity))
    table = np.array(runs, dtype=np.int64).reshape(-1, 6)
    ranked = numbered(pieces, "length", ["doc_id", "piece", "ids_crc32"], "number_in_length")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, number):
        import pandas as pd

        # runs are sorted by (length, first): the last that starts at or before the piece
        keys = table[:, 0] * (1 << 44) + table[:, 1]
        run = table[np.searchsorted(keys, length * (1 << 44) + number, side="right") - 1]
        step = number.to_numpy() - run[:, 1]
        return pd.DataFrame(
            {
                "sequence_id": run[:, 3] + step // run[:, 4],
                "offset": run[:, 5] + step % run[:, 4] * length.to_numpy(),
            }
        )

    return (
        ranked.withColumn("place", place("length", "number_in_length"))
        .select(*pieces.columns, "place.sequence_id", "place.offset")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document, with its place in a sequence.

    Null and empty texts are pieces of one id. Repeated rows are packed each. An empty table
    gives no rows. Other columns of ``docs`` are ignored. Null doc_ids stay null.
    """
    return pack_pieces(token_pieces(docs, capacity), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
