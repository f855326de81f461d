"""Links between texts that have at least four fifths of their runs of five words in common.

Exact, without sampling: two sets with a Jaccard likeness of 0.8 have in common at least four
fifths of either, so under any order of all runs they meet among the first n - ceil(0.8 n) + 1 of
each. Runs are ordered by how many texts have them, as a table of hashed counts tells, so these first
ones are mostly runs that hardly any other text has. A pair that meets is only looked at if the
places of the common run leave room for four fifths. Then sketches of both, about a bit for each run, tell
how many runs only one of them has, at least, and only pairs that can still be alike are compared
over the whole sets. These are large rows: first one pair of each set is compared, and what is then
still apart in groups, as below. So what is written of whole sets grows with the texts, not with the
pairs that have a run in common by chance.

A run that many texts have is not compared pair by pair at once: all are compared with the least
of them first. The texts of a run that are still apart are sieved by their sketches, in packs of
bounded size, pack with pack in tasks that pass on only as many links as join what can be alike. Texts
so joined are groups, and these are compared as whole sets in the same way. At most one link a text is
passed on, so nothing that is written grows with the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.graph import components
from matchlens.llm.simhash import PAIRED, words_of
from matchlens.llm.store import drop, passing, row_key, ship, written

#: Words in a run; texts link if they share at least LIKE[0] / LIKE[1] of all runs of both.
RUN, LIKE = 5, (4, 5)
#: Hashed counts of runs (2 MB). They only decide an order, so any number of runs gives right links.
COUNTS = 1 << 18
#: Bits of a sketch, at least and at most; in between the next power of two from the number of runs.
LEAST_BITS, MOST_BITS = 1 << 6, 1 << 15
#: Runs of all texts of a pack, on average; packs that one task compares with each pack of a group.
PACK, TOGETHER = 1 << 15, 8
#: Texts of a pack of sketches, on average.
CELL = 1 << 10
#: How many pairs of packs reach Python at once: they are large rows.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def runs(text: bytes | None) -> np.ndarray:
    """Hashes of the runs of ``RUN`` words, distinct and ascending. A shorter text is one run."""
    words = words_of(text)
    if len(words) <= RUN:
        found = [b" ".join(words)] if words else []
    else:
        found = map(b" ".join, zip(*(words[i:] for i in range(RUN)), strict=False))
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=RUN), found), "<u8").view("<i8"))


def _least_common(n):
    """How many runs a text of ``n`` has in common with any that it links to, at least."""
    return -(-LIKE[0] * n // LIKE[1])


def sketch(found: np.ndarray) -> bytes:
    """Of each bucket of the runs ``found``, whether it has an odd number of them."""
    bits = min(max(LEAST_BITS, 1 << len(found).bit_length()), MOST_BITS)
    odd = np.bincount(found & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def unlike(one: bytes, other: bytes) -> int:
    """How many runs only one of two sets has, at least: what both have is in the same bucket of
    either sketch and cancels out, also after the halves of the longer sketch are laid together."""
    narrow, wide = (int.from_bytes(s, "little") for s in sorted((one, other), key=len))
    bits = 8 * max(len(one), len(other))
    while bits > 8 * min(len(one), len(other)):
        bits //= 2
        wide = (wide >> bits) ^ (wide & ((1 << bits) - 1))
    return (narrow ^ wide).bit_count()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype("i4")
    values = np.concatenate([np.empty(0, "<i8"), *arrays])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTS, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            np.add.at(counts, runs(text) & (COUNTS - 1), 1)
    place = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(counts[place])], names=["place", "count"])


def _hashed_counts(rows: DataFrame) -> np.ndarray:
    """How many texts have the runs of each hash bucket."""
    found = rows.select("text").mapInArrow(_counting, "place long, count long")
    found = found.groupBy("place").agg(F.sum("count").alias("count")).toArrow()
    counts = np.zeros(COUNTS, dtype=np.int64)
    counts[found.column("place").to_numpy()] = found.column("count").to_numpy()
    return counts


def _beginning(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = given.value
        for batch in batches:
            found = [runs(t) for t in batch.column(2).to_pylist()]
            keys = [xxhash.xxh128_digest(r.tobytes()) for r in found]
            sizes = pa.array([len(r) for r in found], pa.int32())
            ranked = (r[np.argsort(counts[r & (COUNTS - 1)], kind="stable")] for r in found)
            first = _lists([r[: len(r) - _least_common(len(r)) + 1] for r in ranked])
            sketches = pa.array(map(sketch, found), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(keys, pa.binary()), sizes, first, sketches],
                names=["doc_id", "row_key", "key", "n", "first", "sketch"],
            )

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _lists([runs(t) for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["key", "runs"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key("doc_id", "text").alias("row_key"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["row_key"] == b["row_key"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def _entries(begun: DataFrame, roots: DataFrame) -> DataFrame:
    """(run, key, at, n, root): the first runs of each set that another set has among its first."""
    each = begun.select(F.posexplode("first").alias("at", "run"), "key", "n")
    shared = each.groupBy("run").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    shared = written(shared.where("low <> high").select("run"), "runs")
    found = each.join(shared, "run").dropDuplicates(["run", "key"])
    return written(found.join(roots, "key").select("run", "key", "at", "n", "root"), "entries")


def _whole_sets(rows: DataFrame, begun: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, runs) of the sets in ``keys``."""
    chosen = begun.select("key", "doc_id", "row_key").join(keys, "key", "left_semi").dropDuplicates(["key"])
    chosen = written(chosen, "chosen")
    texts = rows.join(chosen, _same_row(rows, chosen)).select("key", "text")
    return written(texts.mapInArrow(_whole, "key binary, runs array<long>").dropDuplicates(["key"]), "whole")


def _room(x: str, y: str) -> Column:
    """Whether what follows the common run, in the same order in both, can be enough."""
    left = F.least(F.col(f"n{x}") - F.col(f"at{x}"), F.col(f"n{y}") - F.col(f"at{y}"))
    return left * sum(LIKE) >= (F.col(f"n{x}") + F.col(f"n{y}")) * LIKE[0]


def _side(entries: DataFrame, x: str) -> DataFrame:
    columns = {"key": x, "root": f"r{x}", "n": f"n{x}", "at": f"at{x}"}
    return entries.select("run", *[F.col(c).alias(name) for c, name in columns.items()])


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, ra, rb): keys that meet and are not in one component yet."""
    apart = left.join(right, "run").where((F.col("ra") != F.col("rb")) & _room("a", "b"))
    swap = F.col("a") > F.col("b")
    low = F.struct("a", "b", "ra", "rb")
    high = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("rb").alias("ra"), F.col("ra").alias("rb"))
    return apart.select(F.when(swap, high).otherwise(low).alias("p")).select("p.*").distinct()


def _keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()


def _sieving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("na", "nb", "sketch_a", "sketch_b"))
        # alike sets have so few runs apart: n_a + n_b - 2 * common
        few = [unlike(x, y) * sum(LIKE) <= (m + n) * (LIKE[1] - LIKE[0]) for m, n, x, y in zip(*columns, strict=True)]
        yield batch.select(["a", "b", "ra", "rb", "na", "nb"]).filter(pa.array(few, pa.bool_()))


def _sieved(pairs: DataFrame, begun: DataFrame) -> DataFrame:
    """The ``pairs`` that can be alike enough by their sketches: all that are, and few others."""
    each = begun.select("key", "n", "sketch").join(_keys(pairs), "key", "left_semi").dropDuplicates(["key"])
    with passing() as kept:
        each = written(each, "sketches")
        left, right = (
            each.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"sketch_{x}"))
            for x in ("a", "b")
        )
        met = pairs.join(left, "a").join(right, "b")
        met = met.select("a", "b", "ra", "rb", "na", "nb", "sketch_a", "sketch_b")
        return kept(written(met.mapInArrow(_sieving, "a binary, b binary, ra long, rb long, na int, nb int"), "near"))


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The ``pairs`` whose roots the ``links`` leave apart, with the roots that they have then."""
    joined = components(links)
    for x in ("ra", "rb"):
        tops = joined.select(F.col("node").alias(x), F.col("root").alias("top"))
        pairs = pairs.join(tops, x, "left").withColumn(x, F.coalesce("top", x)).drop("top")
    return pairs.where("ra <> rb")


def _verified(pairs: DataFrame, rows: DataFrame, begun: DataFrame) -> DataFrame:
    """(a, b): links that join the roots of the ``pairs`` that are alike enough.

    First one pair of each set is compared, as whole sets are large rows. Of the others those still
    apart are compared in groups."""
    near = _sieved(written(pairs, "pairs"), begun)
    one = near.groupBy("b").agg(F.min(F.struct("a", "ra", "rb")).alias("p")).select("b", "p.*")
    one = written(one, "one")
    with passing() as kept:
        whole = _whole_sets(rows, begun, _keys(one))
        left, right = (
            whole.select(F.col("key").alias(x), F.col("runs").alias(f"runs_{x}")) for x in ("a", "b")
        )
        common = F.size(F.array_intersect("runs_a", "runs_b"))
        both = F.size("runs_a") + F.size("runs_b")
        found = one.join(left, "a").join(right, "b").where(common * sum(LIKE) >= both * LIKE[0])
        links = kept(written(found.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links"))
    rest = written(_apart(near, links), "rest")
    if rest.isEmpty():
        return links
    ends = (
        rest.select(F.xxhash64("a").alias("run"), F.col(x).alias("key"), F.col(f"n{x}").alias("n"), F.col(f"r{x}").alias("root"))
        for x in ("a", "b")
    )
    return links.union(_within_groups(reduce(DataFrame.union, ends).distinct(), rows, begun))


def alike(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which sets of two packs are alike enough: their numbers in either."""
    sizes = np.array([len(r) for r in (*left, *right)])
    values, place, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = times[place] > 1
    number = np.cumsum(times > 1) - 1
    width = int((times > 1).sum())
    common = np.zeros((len(left), len(right)), dtype=np.int64)
    for begin in range(0, width, 4096):  # so many runs at a time
        column = number[place] - begin
        here = shared & (column >= 0) & (column < 4096)
        has = np.zeros((len(sizes), min(4096, width - begin)), dtype=np.float32)
        has[owner[here], column[here]] = 1
        common += (has[: len(left)] @ has[len(left) :].T).astype(np.int64)
    both = sizes[: len(left), None] + sizes[None, len(left) :]
    return np.nonzero(common * sum(LIKE) >= both * LIKE[0])


def _spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same nodes with as few as possible."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := top.get(x, x)) != x:
            top[x] = x = top.get(y, y)
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        one, other = find(x), find(y)
        if one != other:
            top[max(one, other)] = min(one, other)
            kept.append((one, other))
    return kept


def _comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = []
        for i in range(batch.num_rows):
            sides = []
            for column in (0, 1):
                pack = batch.column(column)[i].values
                roots = pack.field("root").to_numpy(zero_copy_only=False)
                lists = pack.field("runs")
                ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                sides.append((roots, [values[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]))
            (mine, left), (theirs, right) = sides
            at, there = alike(left, right)
            links += _spanning(mine[at], theirs[there])
        a, b = zip(*links, strict=True) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _odd(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of one length as rows of bits in bytes, laid together to ``width`` bytes."""
    rows = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), -1)
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def maybe_alike(left: list[tuple[int, bytes]], right: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Which sets of two packs, as numbers of runs and sketches, can be alike: their numbers in
    either. Sketches of alike sets differ by one doubling at most."""
    found = [np.empty((2, 0), dtype=np.int64)]
    places = [{k: np.array([i for i, (_, x) in enumerate(side) if len(x) == k]) for k in {len(x) for _, x in side}}
              for side in (left, right)]
    for one, i in places[0].items():
        for other in {one // 2, one, 2 * one} & places[1].keys():
            j, width = places[1][other], min(one, other)
            x, y = _odd([left[k][1] for k in i], width), _odd([right[k][1] for k in j], width)
            same = np.zeros((len(i), len(j)), dtype=np.float32)
            for begin in range(0, width, 512):  # so many bytes of the sketches at a time
                a, b = (2 * np.unpackbits(z[:, begin : begin + 512], axis=1).astype(np.float32) - 1 for z in (x, y))
                same += a @ b.T
            both = np.array([left[k][0] for k in i])[:, None] + np.array([right[k][0] for k in j])[None]
            at, there = np.nonzero((8 * width - same.astype(np.int64)) // 2 * sum(LIKE) <= both * (LIKE[1] - LIKE[0]))
            found.append(np.stack([i[at], j[there]]))
    return tuple(np.concatenate(found, axis=1))


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = []
        for i in range(batch.num_rows):
            sides = [batch.column(column)[i].values for column in (0, 1)]
            (node, root), (other, top) = (
                (s.field("node").to_numpy(), s.field("root").to_numpy()) for s in sides
            )
            sets = (list(zip(s.field("n").to_pylist(), s.field("sketch").to_pylist(), strict=True)) for s in sides)
            at, there = maybe_alike(*sets)
            apart = root[at] != top[there]
            links += _spanning(node[at[apart]], other[there[apart]])
        a, b = zip(*links, strict=True) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _joined(named: DataFrame, begun: DataFrame) -> DataFrame:
    """(a, b): links that join the nodes of ``named`` (run, key, n, root, node) that share a run, have
    other roots and can be alike by their sketches."""
    sketches = begun.select("key", "sketch").join(named.select("key").distinct(), "key", "left_semi")
    sizes = named.groupBy("run").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("packs"))
    pack = F.pmod(F.xxhash64("node"), F.col("packs")).alias("pack")
    sets = F.collect_list(F.struct("node", "root", "n", "sketch")).alias("sets")
    with passing() as kept:
        sketches = written(sketches.dropDuplicates(["key"]), "sketches")
        dealt = named.join(sizes, "run").join(sketches, "key")
        dealt = dealt.select(F.col("run").alias("group"), "packs", pack, "node", "root", "n", "sketch")
        cells = written(dealt.groupBy("group", "packs", "pack").agg(sets), "sketched")
        return kept(_met(cells, _joining))


def _packs(members: DataFrame, whole: DataFrame) -> DataFrame:
    """(group, packs, pack, sets): the sets of each group, in packs of bounded size."""
    sizes = members.groupBy("group").agg(F.ceil(F.sum("n") / PACK).alias("packs"))
    dealt = members.join(sizes, "group").join(whole, "key")
    pack = F.pmod(F.xxhash64("key"), F.col("packs")).alias("pack")
    sets = F.collect_list(F.struct("root", "runs")).alias("sets")
    return dealt.select("group", "packs", pack, "root", "runs").groupBy("group", "packs", "pack").agg(sets)


def _met(packs: DataFrame, compare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(a, b): what ``compare`` links in every two packs of a group of ``packs``, and in each."""
    # A task takes TOGETHER packs of a group and meets all packs of it that are not before them.
    shares = F.ceil(F.col("packs") / TOGETHER)
    left = packs.select("group", "pack", F.floor(F.col("pack") / TOGETHER).alias("share"), F.col("sets").alias("one"))
    right = packs.select(
        "group", F.col("pack").alias("other_pack"), F.col("sets").alias("other"),
        F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"),
    ).where(F.col("share") <= F.floor(F.col("other_pack") / TOGETHER))
    met = left.join(right, ["group", "share"]).where("pack <= other_pack").select("one", "other")
    spark = packs.sparkSession
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "8")  # pairs of packs are large rows
    try:
        return written(met.mapInArrow(compare, "a long, b long").distinct(), "links")
    finally:
        spark.conf.set(BATCH, before)


def _within_groups(open_: DataFrame, rows: DataFrame, begun: DataFrame) -> DataFrame:
    """(a, b): links between the roots of ``open_`` (run, key, n, root) that share a run."""
    named = written(open_.withColumn("node", F.xxhash64("key")), "open")
    groups = components(_joined(named, begun))
    members = named.join(groups.withColumnRenamed("root", "group"), "node")
    members = written(members.select("group", "key", "n", "root").distinct(), "members")
    with passing() as kept:
        whole = _whole_sets(rows, begun, members.select("key"))
        packs = kept(written(_packs(members, whole), "packs"))
    return _met(packs, _comparing)


def similar(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """Links (a, b) between roots of ``rooted`` (doc_id, row_key, root of each row of ``docs``).
    With them, all texts that have a Jaccard likeness of 0.8 are in one component.

    A text of 1 to ``RUN`` words is one run; texts without words (null, empty, blank) have none and
    get no links here. Repeated rows and equal sets count as one set. A very long text is one
    row of its pack. An empty table gives no links.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = _rows(docs)
    given = spark.sparkContext.broadcast(_hashed_counts(rows))
    begun = rows.mapInArrow(
        _beginning(given),
        "doc_id long, row_key long, key binary, n int, first array<long>, sketch binary",
    )
    begun = written(begun, "begun")
    rooted = rooted.dropDuplicates(["doc_id", "row_key"])
    of_row = begun.select("doc_id", "row_key", "key")
    of_set = of_row.join(rooted, _same_row(of_row, rooted)).select("key", "root").distinct()
    of_set = written(of_set, "placed")
    least = written(of_set.groupBy("key").agg(F.min("root").alias("root")), "roots")
    same = of_set.join(least.withColumnRenamed("root", "a"), "key").where("a <> root")
    links = same.select("a", F.col("root").alias("b")).distinct()

    entries = _entries(begun, least)
    cells = entries.groupBy("run").agg(F.min("key").alias("least"), F.count("key").alias("count"))
    cells = written(cells, "cells")
    small = entries.join(cells.where(F.col("count").between(2, PAIRED)), "run").drop("least", "count")
    small = written(small, "small")
    links = links.union(_verified(_pairs(_side(small, "a"), _side(small, "b")), rows, begun))

    crowded = entries.join(cells.where(F.col("count") > PAIRED), "run").drop("count")
    crowded = written(crowded, "crowded")
    if crowded.isEmpty():
        drop(begun)
        return links
    stars = _pairs(_side(crowded.where("key = least"), "a"), _side(crowded, "b"))
    links = written(links.union(_verified(stars, rows, begun)), "links")
    joined = components(links)
    crowded = crowded.join(joined, crowded["root"] == joined["node"], "left").select(
        "run", "key", "n", F.coalesce(joined["root"], crowded["root"]).alias("root")
    )
    crowded = written(crowded, "crowded")
    parts = crowded.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    open_ = crowded.join(parts.where("low <> high").select("run"), "run", "left_semi")
    links = links.union(_within_groups(open_, rows, begun))
    drop(begun)
    return links
