"""Operator 6: near duplicates by SimHash fingerprints, linked through popcount vectors.

A fingerprint is mapped to the 16 numbers of set bits in its segments of 4 bits. The Manhattan
distance of two such vectors is at most the Hamming distance of the fingerprints, so links are
sought among vectors at distance 2 or less: such vectors have a grid point in common that is
at most one step from either. Every distinct fingerprint goes to its own grid point and those
one step away (33 at most), fingerprints in one cell are compared exactly.

A cell with many fingerprints is not compared pair by pair: there each fingerprint goes to its
64 variants with one bit flipped and to itself. Two fingerprints link exactly if they have a
variant in common, so a chain from the smallest of a variant to the others keeps all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm.graph import components
from matchlens.llm.store import free_name, row_key, ship, written

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Fingerprints in a cell up to which they are compared in pairs.
PAIRED = 32

_BLANK = bytes([*range(0x09, 0x0E), 0x20])
_FOLD = bytes.maketrans(
    bytes(range(65, 91)) + _BLANK, bytes(range(97, 123)) + b" " * len(_BLANK)
)
_LOW_BITS = 0x1111111111111111


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case (ASCII letters only), parted by ASCII white space."""
    return (text or b"").translate(_FOLD).split()


def fingerprint(text: bytes | None) -> int:
    """Bit by bit, whether over half of the shingles' hashes have it. No words: 0."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype="<u8")
        marks = pa.array(found.view("<i8"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), marks], names=["doc_id", "row_key", "mark"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, mark): the 64 bits of the fingerprint as a signed number."""
    ship(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string").cast("binary"),
        row_key("doc_id", "text").alias("row_key"),
    ).mapInArrow(_fingerprints, "doc_id long, row_key long, mark long")


def _segment_counts(mark):
    """The number of set bits of each segment of 4 bits, in its place: 16 digits from 0 to 4."""
    each = [F.shiftrightunsigned(mark, i).bitwiseAND(F.lit(_LOW_BITS)) for i in range(4)]
    return each[0] + each[1] + each[2] + each[3]


def _cells(counts):
    """The grid point and those one step away, within 0 and 4."""
    near = [counts]
    for i in range(0, 64, 4):
        digit, step = F.shiftrightunsigned(counts, i).bitwiseAND(F.lit(7)), F.lit(1 << i)
        near += [F.when(digit > 0, counts - step), F.when(digit < 4, counts + step)]
    return F.array_compact(F.array(*near))


def near_links(marks: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct ``mark`` of ``marks``, at most two bits apart: every
    two that are that near are linked, at once or through others with the same property."""
    placed = marks.select("mark", F.explode(_cells(_segment_counts(F.col("mark")))).alias("cell"))
    placed = written(placed, "cells")
    shared = placed.groupBy("cell").count().where("count > 1")
    shared = written(placed.join(shared, "cell"), "shared")
    left, right = (
        shared.where(F.col("count") <= PAIRED).select("cell", F.col("mark").alias(name))
        for name in ("a", "b")
    )
    pairs = left.join(right, "cell").where(f"a < b and bit_count(a ^ b) <= {MOST_BITS}")
    flips = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {i})") for i in range(64)])
    crowded = shared.where(F.col("count") > PAIRED).select("mark").distinct()
    variants = crowded.select(
        "mark", F.explode(F.transform(flips, lambda bit: F.col("mark").bitwiseXOR(bit))).alias("v")
    )
    variants = written(variants, "variants")
    first = variants.groupBy("v").agg(F.min("mark").alias("a"), F.count(F.lit(1)).alias("n"))
    stars = variants.join(first.where("n > 1"), "v").where("a <> mark")
    return pairs.select("a", "b").union(stars.select("a", F.col("mark").alias("b"))).distinct()


#: Makes more links between roots, of ``docs`` and the (doc_id, row_key, root) of its rows.
MoreLinks = Callable[[DataFrame, DataFrame], DataFrame]


def near_duplicates(docs: DataFrame, more: MoreLinks | None = None) -> DataFrame:
    """(doc_id, row_key, root, fingerprint, component_id) of every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links. Null, empty and wordless
    texts have fingerprint zero and link like any other. Null doc_ids are never smallest,
    unless a component has no other. Repeated rows get equal results; other columns are
    ignored; an empty table gives no rows. Links of ``more`` count like those of fingerprints.
    """
    rows = written(fingerprints(docs), "fingerprints")
    marks = written(rows.groupBy("mark").agg(F.min("doc_id").alias("least")), "marks")
    roots = components(near_links(marks))
    rooted = marks.join(roots, marks["mark"] == roots["node"], "left").select(
        "mark", "least", F.coalesce("root", "mark").alias("root")
    )
    rooted = written(rooted, "rooted")
    if more:
        of_rows = rows.join(rooted, "mark").select("doc_id", "row_key", "root")
        joined = components(more(docs, written(of_rows, "roots")))
        joined = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
        rooted = rooted.join(joined, "root", "left").select(
            "mark", "least", F.coalesce("top", "root").alias("root")
        )
        rooted = written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(rooted.join(least, "root").select("mark", "root", "component_id"))
    return rows.join(found, "mark").select(
        "doc_id",
        "row_key",
        "root",
        F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(docs: DataFrame, more: MoreLinks | None = None) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component.

    Of rows with that same doc_id, those with the smallest (row_key) stay; exact repeats of a
    row stay as one. Components in which every doc_id is null keep one row.
    """
    found = near_duplicates(docs, more).groupBy("root", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("times"))
    first = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "times")).alias("f")
    )
    keep, key, again = (free_name(docs, n) for n in ("keep_id", "keep_key", "keep_again"))
    kept = first.select(
        F.col("f.doc_id").alias(keep), F.col("f.row_key").alias(key), (F.col("f.times") > 1).alias(again)
    )
    kept = written(kept)
    same = docs["doc_id"].cast("long").eqNullSafe(kept[keep])
    chosen = docs.join(kept, same & (row_key("doc_id", "text") == kept[key]))
    # exact repeats of the chosen row: one stays; only they are shuffled once more
    once, repeated = chosen.where(~F.col(again)), chosen.where(again)
    return once.union(repeated.dropDuplicates([keep, key])).drop(keep, key, again)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key", "root")
