"""Operator 4: repeated byte strings across documents, by merging Burrows-Wheeler transforms.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier. Comparing all
suffixes of a corpus in one order is no distributed job, so equal strings are brought together
first: every string has an *anchor*, the least hash among its inner runs of ``GRAM`` bytes.
Consecutive strings of a document with the same anchor form a *run*, the stretch of text that
holds them. Equal strings have equal anchors, so an anchor that stands in one place only can be
set aside, and the runs of an anchor are a small collection of their own.

Runs that are equal as a whole need no comparison; all but the earliest go. The different runs
of an anchor are sorted by suffix: they are dealt over shards, each shard's transform is built,
and the transforms are merged by refining their interleave one symbol at a time. After
``LENGTH`` rounds the merged order falls into intervals of equal strings.

An anchor with more than ``CROWD`` different runs is not merged in one task. Its strings are
brought together by a hash of their own instead, so that each of them spreads by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm.store import row_key, ship, written

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # inner runs of a string
#: Strings in a run, at most; bytes that are looked at together, few enough to stay in the
#: processor's cache; runs that are passed on together.
LONGEST_RUN, CHUNK, PASSED_ON = 128, 1 << 15, 1 << 15
#: Bytes of a shard, and of the collections that a task sorts at a time; runs of one anchor.
SHARD, BATCH, CROWD = 1 << 16, 1 << 17, 2048
#: Documents up to which their keys are broadcast (16 bytes each), anchors likewise (8 bytes).
HELD_KEYS, HELD_ANCHORS = 1_000_000, 2_000_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _A
    return x ^ (x >> np.uint64(32))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of each run of ``GRAM`` bytes, eight at a time."""
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    n = len(data) - GRAM + 1
    found = eight[:n] * _B
    for at in range(8, GRAM, 8):
        found = _mix(found) * _B + eight[at : at + n]
    return _mix(found)


def _sliding(values: np.ndarray, span: int, least) -> np.ndarray:
    """``least`` of each ``span`` neighbours, by doubling."""
    have = 1
    while 2 * have <= span:
        values, have = least(values[:-have], values[have:]), 2 * have
    rest = span - have
    return least(values[:-rest], values[rest:]) if rest else values


class Runs(NamedTuple):
    """Runs of several texts; ``text`` is the number of the text. Tied: the anchor stands in the
    run more than once, so it may hold equal strings."""

    text: np.ndarray
    start: np.ndarray
    strings: np.ndarray
    anchor: np.ndarray
    tied: np.ndarray
    whole: np.ndarray  # a hash of the run's bytes


def runs(texts: list[bytes], hashed: bool) -> Iterator[Runs]:
    """The runs of texts, about ``PASSED_ON`` at a time."""
    held: list[Runs] = []
    size = 0
    for found in _chunks(texts, hashed):
        held.append(found)
        size += len(found.text)
        if size >= PASSED_ON:
            yield Runs(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield Runs(*map(np.concatenate, zip(*held, strict=True)))


def _chunks(texts: list[bytes], hashed: bool) -> Iterator[Runs]:
    """Short texts are looked at together, long ones a chunk at a time."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        for base in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
            held.append((k, base, text[base : base + CHUNK + LENGTH - 1]))
            size += len(held[-1][2])
            if size >= CHUNK:
                yield _runs(held, hashed)
                held, size = [], 0
    if held:
        yield _runs(held, hashed)


def _runs(pieces: list[tuple[int, int, bytes]], hashed: bool) -> Runs:
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    firsts = np.cumsum(sizes) - sizes
    grams = _gram_hashes(data)
    least = _sliding(grams, SPAN, np.minimum)
    inside = np.zeros(len(least) + 1, dtype=np.int8)  # strings that lie in one piece
    inside[firsts] += 1
    inside[firsts + sizes - LENGTH + 1] -= 1
    inside = np.cumsum(inside, dtype=np.int8)[:-1].astype(bool)
    new = np.append(True, least[1:] != least[:-1]) | np.append(True, inside[1:] != inside[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(least))
    starts, ends = starts[inside[starts]], ends[inside[starts]]
    if (ends - starts).max() > LONGEST_RUN:
        parts = -((starts - ends) // LONGEST_RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + nth * LONGEST_RUN
        ends = np.minimum(starts + LONGEST_RUN, np.repeat(ends, parts))
    # a gram is an anchor if it is the least of some string: the largest least it is part of
    reached = _sliding(np.pad(least, SPAN - 1, mode="edge"), SPAN, np.maximum)
    at = np.flatnonzero(grams == reached)
    again = (grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) < SPAN + LONGEST_RUN)
    again = np.append(0, np.cumsum(again))  # pairs up to an anchor
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends + SPAN - 1) - 1
    tied = again[np.maximum(last, first)] > again[first]
    piece = np.searchsorted(firsts, starts, side="right") - 1
    text, base = (np.array([p[i] for p in pieces]) for i in (0, 1))
    whole = starts
    if hashed:
        powers = np.full(len(grams), _B)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.append(np.uint64(0), np.cumsum(_mix(grams + _A) * powers, dtype="<u8"))
        # every sum is moved to the last power, and then by what that is too much
        whole = (sums[ends + SPAN - 1] - sums[starts]) * powers[len(grams) - 1 - starts]
        whole = _mix(whole * _scale(len(grams))).view("<i8")
    place = base[piece] + starts - firsts[piece]
    return Runs(text[piece], place, ends - starts, least[starts].view("<i8"), tied, whole)


_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))


def _scale(n: int) -> np.uint64:
    """What takes the power ``n`` - 1 out again, so that chunks of any length agree."""
    return np.uint64(pow(int(_INVERSE), n - 1, 1 << 64))


def transform(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, string, offset) of a shard's suffixes in order: the symbol before each (0: none),
    and where it is. Suffixes are compared up to their string's end; strings of a shard that end
    alike are in the order given."""
    sizes = np.array([len(s) + 1 for s in strings])
    text = np.zeros(sizes.sum(), dtype=np.int64)
    firsts = np.cumsum(sizes) - sizes
    for at, s in zip(firsts, strings, strict=True):
        text[at : at + len(s)] = s.astype(np.int64) + 1
    of = np.repeat(np.arange(len(strings)), sizes)
    offset = np.arange(len(text)) - firsts[of]
    ends = text == 0
    # a suffix's rank is the place where those that agree with it so far begin; only suffixes
    # that agree with another one are sorted again, by what stands ``have`` symbols on
    said = np.where(ends, of, text + len(strings))
    order = np.argsort(said, kind="stable")
    rank, place, have = np.zeros(len(text), dtype=np.int64), np.arange(len(text)), 1
    suffix, key = order, said[order]
    while len(suffix):
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[suffix] = place[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        many = ~(new & np.append(new[1:], True))
        place, suffix = place[many], suffix[many]
        # none of them reaches past its string's end, which would have told it apart
        key = rank[suffix] * len(text) + rank[suffix + have]
        again = np.argsort(key, kind="stable")
        suffix, key = suffix[again], key[again]
        order[place] = suffix
        have *= 2
    before = np.where(offset > 0, text[np.arange(len(text)) - 1], 0)
    return before[order].astype(np.uint16), of[order], offset[order]


def merge(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, interval) of the suffixes that have ``depth`` symbols in common with another one:
    the place in the shards' transforms, laid end to end, and the number of the interval of
    suffixes that agree so far.

    ``shards`` are the transforms. In round k the suffixes
    are in order of their first k symbols: the merged transform of round k - 1 is sorted by
    symbol, stable, and each symbol leads to the suffix it begins. Only symbols are read, never
    the suffixes. Each string's end is a symbol of its own. An interval of one suffix stays one
    whatever stands before it, so it is left out of the rounds that follow.
    """
    symbols = np.concatenate(shards)
    begins = np.zeros(len(symbols), dtype=np.int32)
    base = 0
    for shard in shards:
        begins[base + np.argsort(shard, kind="stable")] = base + np.arange(len(shard))
        base += len(shard)
    place = np.arange(len(symbols), dtype=np.int32)
    interval = np.zeros(len(symbols), dtype=np.int32)
    for _ in range(depth):
        said = symbols[place]
        moved = np.argsort(said, kind="stable")
        moved = moved[np.count_nonzero(said == 0) :]  # nothing stands before a string's start
        said, source = said[moved], interval[moved]
        new = np.ones(len(moved), dtype=bool)
        new[1:] = (said[1:] != said[:-1]) | (source[1:] != source[:-1])
        many = ~(new & np.append(new[1:], True))
        place, interval = begins[place[moved[many]]], np.cumsum(new, dtype=np.int32)[many]
    return place, interval


def repeated(strings: list[np.ndarray], document: np.ndarray, start: np.ndarray) -> list[tuple]:
    """(string, first, last) of windows of ``strings`` that an earlier one equals; ``string``
    begins at ``start`` of ``document`` (numbers in order of documents)."""
    shards, held, size = [[]], [[]], 0
    for k, s in enumerate(strings):
        if size + len(s) > SHARD and shards[-1]:
            shards.append([])
            held.append([])
            size = 0
        shards[-1].append(s)
        held[-1].append(k)
        size += len(s)
    built = [transform(shard) for shard in shards]
    place, interval = merge([b[0] for b in built], LENGTH)
    string = np.concatenate([np.array(held[k])[of] for k, (_, of, _) in enumerate(built)])[place]
    offset = np.concatenate([at for _, _, at in built])[place]
    place = np.lexsort((start[string] + offset, document[string], interval))
    string, offset, interval = string[place], offset[place], interval[place]
    later = np.concatenate([[False], interval[1:] == interval[:-1]]) if len(place) else place
    string, offset = string[later], offset[later]
    return _stretches(string, offset)


def _stretches(string: np.ndarray, offset: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(string):
        return []
    place = np.lexsort((offset, string))
    string, offset = string[place], offset[place]
    breaks = np.flatnonzero((string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1))
    firsts, lasts = np.append(0, breaks + 1), np.append(breaks, len(string) - 1)
    return list(zip(string[firsts].tolist(), offset[firsts].tolist(), offset[lasts].tolist(), strict=True))


def _rows_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key("doc_id", F.col("text")).alias("row_key"),
        text.alias("text"),
    )


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with a key of ``keys`` (k_id, k_key); broadcast where they are few."""
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("row_key") == F.col("k_key"))
    held = keys if keys.count() > HELD_KEYS else F.broadcast(keys)
    return rows.join(held, same, "left_semi")


def _keyed(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("doc_id").alias("k_id"), F.col("row_key").alias("k_key"), *more)


def _spots(rows: DataFrame) -> DataFrame:
    """(anchor, whole, tied, doc_id, row_key, start, n): runs whose anchor also stands elsewhere."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in runs(batch.column(0).to_pylist(), False):
                twice = found.anchor[found.tied]  # counts as two places
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(found.anchor, twice))], names=["anchor"]
                )

    def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "whole", "tied", "doc_id", "row_key", "start", "n"]
        for batch in batches:
            for found in runs(batch.column(2).to_pylist(), True):
                own = pa.array(found.text)
                columns = [
                    pa.array(found.anchor),
                    pa.array(found.whole),
                    pa.array(found.tied),
                    batch.column(0).take(own),
                    batch.column(1).take(own),
                    pa.array(found.start.astype("i8")),
                    pa.array(found.strings.astype("i4")),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    long = rows.where(F.octet_length("text") >= LENGTH)
    seen = long.select("text").mapInArrow(anchors, "anchor long").groupBy("anchor").count()
    shared = written(seen.where("count > 1").select("anchor"), "anchors")
    held = shared if shared.count() > HELD_ANCHORS else F.broadcast(shared)
    schema = "anchor long, whole long, tied boolean, doc_id long, row_key long, start long, n int"
    found = long.select("doc_id", "row_key", "text").mapInArrow(whole_runs, schema)
    return written(found.join(held, "anchor"), "spots")


PLACE = "doc_id long, row_key long, start long, stop long"


def _places(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "row_key", "start", "stop"]
    )


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of repeated strings in runs that come sorted by anchor."""

    def done(kept: list[tuple]) -> pa.RecordBatch:
        kept.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        same = [k > 0 and kept[k - 1][1:3] == row[1:3] for k, row in enumerate(kept)]
        document = np.cumsum(~np.array(same, dtype=bool))
        strings = [np.frombuffer(row[4], np.uint8) for row in kept]
        start = np.array([row[3] for row in kept])
        return _places(
            [
                (*kept[k][1:3], kept[k][3] + first, kept[k][3] + last + LENGTH)
                for k, first, last in repeated(strings, document, start)
            ]
        )

    kept, size, anchor = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > BATCH and row[0] != anchor:
                yield done(kept)
                kept, size = [], 0
            kept.append(row)
            size, anchor = size + len(row[4]), row[0]
    if kept:
        yield done(kept)


def _hash_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of the runs with 128 bits of hash."""
    for batch in batches:
        rows = []
        for _, doc_id, key, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for i in range(len(text) - LENGTH + 1):
                mark = hashlib.blake2b(text[i : i + LENGTH], digest_size=16).digest()
                rows.append((mark, doc_id, key, start + i))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = pa.binary(), pa.int64(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["mark", "doc_id", "row_key", "start"],
        )


def repeated_places(rows: DataFrame) -> DataFrame:
    """(doc_id, row_key, start, stop): stretches of ``rows`` (doc_id, row_key, text as bytes) in
    which every byte is to go; they may overlap."""
    spots = _spots(rows)
    order = F.struct("doc_id", "row_key", "start")
    firsts = spots.groupBy("anchor", "whole", "n").agg(
        F.min(order).alias("first"), F.max("tied").alias("tied"), F.count(F.lit(1)).alias("times")
    )
    firsts = written(firsts, "firsts")
    repeats = firsts.where("times > 1").select("anchor", "whole", "n", "first")
    copies = spots.join(repeats, ["anchor", "whole", "n"]).where(order > F.col("first"))
    stop = (F.col("start") + F.col("n") + LENGTH - 1).alias("stop")
    copies = copies.select("doc_id", "row_key", "start", stop)

    different = firsts.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("runs"), F.max("tied").alias("tied")
    )
    different = different.where("runs > 1 or tied").select("anchor", "runs")
    wanted = firsts.drop("tied").join(different, "anchor").select("anchor", "runs", "first.*", "n")
    lists = wanted.groupBy("doc_id", "row_key").agg(
        F.collect_list(F.struct("anchor", "runs", "start", "n")).alias("w")  # runs of a document
    )
    lists = written(_keyed(lists, "w"), "wanted")
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("row_key") == F.col("k_key"))
    texts = _only(rows, lists.select("k_id", "k_key")).join(lists, same)
    cut = F.substring("text", F.col("w.start").cast("int") + 1, F.col("w.n") + LENGTH - 1)
    strings = texts.select("doc_id", "row_key", "text", F.explode("w").alias("w")).select(
        F.col("w.anchor"), F.col("w.runs"), "doc_id", "row_key", F.col("w.start"), cut.alias("said")
    )
    strings = written(strings.dropDuplicates(["anchor", "doc_id", "row_key", "start"]), "strings")
    few = strings.where(F.col("runs") <= CROWD).drop("runs")
    few = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_merge_batches, PLACE)
    crowd = strings.where(F.col("runs") > CROWD).drop("runs").mapInArrow(
        _hash_strings, "mark binary, doc_id long, row_key long, start long"
    )
    crowd = written(crowd, "crowd")
    earliest = crowd.groupBy("mark").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    later = crowd.join(earliest.where("n > 1"), "mark").where(order > F.col("first"))
    later = later.select("doc_id", "row_key", "start", (F.col("start") + LENGTH).alias("stop"))
    return few.union(later).union(copies)


def _take_out(text: bytes, places: list[dict]) -> tuple[int, int, bytes]:
    """(bytes removed, stretches removed, what is left)."""
    edges = np.zeros(len(text) + 1, dtype=np.int64)
    for p in places:
        edges[p["start"]] += 1
        edges[p["stop"]] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    stretches = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].any())
    return int(gone.sum()), stretches, np.frombuffer(text, np.uint8)[~gone].tobytes()


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_bytes, n_removed, n_spans, kept, sha): of every row of ``docs``, what is
    left when each byte covered by a string of ``LENGTH`` bytes that starts earlier is gone.

    Earlier: a smaller doc_id (null is smallest), or the same document and a smaller start.
    Strings are judged on the input. Of exact copies of a text only the first is compared; the
    others go whole, if they have ``LENGTH`` bytes. Null texts are empty. Exact repeats of a row
    count as one and get equal results; among rows with one doc_id but other texts a hash tells
    which is earlier. ``kept`` is null where nothing is removed, ``sha`` is the SHA-256 of the whole text. Other columns are ignored; an
    empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = _rows_of(docs)
    n = F.octet_length("text").cast("long").alias("n_bytes")
    table = written(rows.select("doc_id", "row_key", n, F.sha2("text", 256).alias("sha")), "rows")
    first = table.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(
        F.min(F.struct("doc_id", "row_key")).alias("f"), F.count(F.lit(1)).alias("times")
    )
    first = written(first.where("times > 1").select("sha", "f"), "copied")
    copies = table.join(first, "sha").where(F.struct("doc_id", "row_key") > F.col("f"))
    copies = written(copies.select("doc_id", "row_key").distinct(), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("row_key") == F.col("k_key"))
    known = _keyed(copies)
    known = known if copies.count() > HELD_KEYS else F.broadcast(known)
    places = repeated_places(rows.join(known, same, "left_anti"))
    lists = places.groupBy("doc_id", "row_key").agg(
        F.collect_list(F.struct("start", "stop")).alias("places")  # of one document
    )
    lists = written(_keyed(lists, "places"), "places")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch.column(i).to_pylist() for i in (2, 3)), strict=True)
            done = [_take_out(text, places) for text, places in both]
            columns = list(zip(*done, strict=True)) or [()] * 3
            kinds = pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["k_id", "k_key", "n_removed", "n_spans", "kept"],
            )

    touched = _only(rows, lists.select("k_id", "k_key")).join(lists, same)
    touched = touched.select("doc_id", "row_key", "text", "places").mapInArrow(
        remove, "k_id long, k_key long, n_removed long, n_spans long, kept binary"
    )
    touched = touched.dropDuplicates(["k_id", "k_key"])
    none = F.lit(0).cast("long")
    whole = _keyed(copies).select(
        F.col("k_id").alias("c_id"), F.col("k_key").alias("c_key"), F.lit(True).alias("copy")
    )
    copied = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("row_key") == F.col("c_key"))
    marked = table.join(whole, copied, "left").join(touched, same, "left")
    return marked.select(
        "doc_id",
        "row_key",
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(F.col("copy"), none + 1).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(F.col("copy"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        "sha",
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: bytes, removed bytes and stretches, and a digest of the rest."""
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest: Column = F.when(F.col("kept").isNull(), F.col("sha")).otherwise(F.sha2("kept", 256))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", digest.alias("kept_sha256"))


#: Texts as hexadecimal digits, two to a byte.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
    SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k
    FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS s FROM d WHERE len(h) >= 200)),
later AS (
    SELECT doc_id, s FROM (
        SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM strings)
    WHERE nth > 1),
breaks AS (
    SELECT *, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS new
    FROM later),
counted AS (
    SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS stretch FROM breaks),
stretches AS (
    SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM counted GROUP BY doc_id, stretch),
around AS (
    SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM stretches),
taken AS (
    SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept,
        max(b) AS stop, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed
    FROM around JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
    coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, 2 * stop + 1) END))
    AS kept_sha256
FROM d LEFT JOIN taken USING (doc_id)
"""
