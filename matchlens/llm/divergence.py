"""Operator 13: how the sources of a language differ in their words, by shared segment trees.

Every (lang, source) group has a count for each kept term of its language. Terms are dealt over
blocks of bounded size and put in descending frequency there; the counts of a group in a block
are the leaves of a binary tree over the terms. Trees are hash-consed: equal counts are one leaf,
and two nodes with the same two children are one node, within a group and between groups. Rare
terms, which most groups lack, so become a few nodes.

The difference of two groups over a block comes from walking both trees at once from the roots
down. What a pair of nodes is worth depends on the pair alone, so equal pairs of a level are
merged, with how often they occur, before their children are looked at: each distinct pair is
expanded once, and only distinct pairs of counts are priced. All numbers are whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlens.llm.store import ship, written

LEAST_DOCUMENTS, SMOOTHING, TOP = 30, 5, 50
#: Two factors of 10^9.
STEPS = 32_000, 31_250
#: Leaves of a block; counts of a block over all groups; groups that one task compares.
TERMS, CELLS, GROUPS = 1 << 12, 1 << 20, 64
#: Distinct (lang, source, term) that a task holds before it passes their counts on.
HELD = 1 << 18

_LETTERS = frozenset([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_FOLD = bytes(c + 32 if 0x41 <= c < 0x5B else c if c in _LETTERS else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of all characters beyond ASCII; only A-Z in lower case."""
    return text.translate(_FOLD).split()


def _passed_on(found: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, documents) in found.items():
        terms = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
             pa.array(terms, pa.binary()).cast(pa.string()),
             pa.array(list(counts.values()), pa.int64()),
             pa.array([documents[t] for t in terms], pa.int64())],
            names=["lang", "source", "term", "count", "documents"],
        )


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, held = {}, 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts, documents = found.setdefault((lang, source), (Counter(), Counter()))
            before, of_text = len(counts), Counter(terms_of(text))
            counts.update(of_text)
            documents.update(of_text.keys())
            held += len(counts) - before
            if held > HELD:
                yield from _passed_on(found)
                found, held = {}, 0
    yield from _passed_on(found)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, documents) of every term that occurs. Nulls count as ''."""
    ship(docs.sparkSession)
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    schema = "lang string, source string, term string, count long, documents long"
    parts = docs.select(*names, text.alias("text")).mapInArrow(_counting, schema)
    return parts.groupBy("lang", "source", "term").agg(
        F.sum("count").alias("count"), F.sum("documents").alias("documents")
    )


def _price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact for counts up to 2 * 10^14. In two
    steps, so that no product leaves 64 bits."""
    def div(a, b):
        return F.call_function("div", a, b)

    whole = total + SMOOTHING * terms
    scaled = (count + SMOOTHING) * STEPS[0]
    return 1 + div(scaled, whole) * STEPS[1] + div(scaled % whole * STEPS[1], whole)


def prices(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same of an array of longs."""
    whole = total + SMOOTHING * terms
    once, rest = np.divmod((counts + SMOOTHING) * STEPS[0], whole)
    return 1 + once * STEPS[1] + rest * STEPS[1] // whole


class Forest:
    """Hash-consed trees over the columns of ``counts`` (group, term), whose number is a power
    of two. Nodes of a level are numbered; equal ones have the same number."""

    def __init__(self, counts: np.ndarray):
        self.leaves, nodes = np.unique(counts, return_inverse=True)
        nodes = nodes.reshape(counts.shape)
        #: From the leaves up: the two children of each node.
        self.children = []
        kinds = len(self.leaves)
        while nodes.shape[1] > 1:
            pairs = nodes[:, ::2] * kinds + nodes[:, 1::2]
            distinct, nodes = np.unique(pairs, return_inverse=True)
            nodes = nodes.reshape(pairs.shape)
            self.children.append(np.stack(np.divmod(distinct, kinds)))
            kinds = len(distinct)
        self.roots = nodes[:, 0]

    def pairs_of_leaves(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of counts of two groups at one term, and how often each occurs."""
        mine, theirs, times = self.roots[[a]], self.roots[[b]], np.ones(1, dtype=np.int64)
        for children in reversed(self.children):
            mine, theirs = children[:, mine].ravel(), children[:, theirs].ravel()
            kinds = int(theirs.max()) + 1
            distinct, place = np.unique(mine * kinds + theirs, return_inverse=True)
            times = np.bincount(place, np.tile(times, 2)).astype(np.int64)
            mine, theirs = np.divmod(distinct, kinds)
        return self.leaves[mine], self.leaves[theirs], times


def differences(counts: np.ndarray, pairs, totals, terms: int) -> list[int]:
    """For each (a, b) of ``pairs``: the sum of |p - q| over the columns of ``counts``."""
    width = 1 << max(0, counts.shape[1] - 1).bit_length()
    # columns that only fill up have a count of -1 in all groups, and no price
    filled = np.pad(counts, ((0, 0), (0, width - counts.shape[1])), constant_values=-1)
    forest = Forest(filled)
    # the price of each distinct count, group by group
    known = {g: prices(np.maximum(forest.leaves, 0), totals[g], terms) for g in {g for p in pairs for g in p}}
    found = []
    for a, b in pairs:
        if totals[a] == totals[b] and forest.roots[a] == forest.roots[b]:
            found.append(0)
            continue
        mine, theirs, times = forest.pairs_of_leaves(a, b)
        real = mine >= 0
        left = known[a][np.searchsorted(forest.leaves, mine[real])]
        right = known[b][np.searchsorted(forest.leaves, theirs[real])]
        found.append(int((np.abs(left - right) * times[real]).sum()))
    return found


def _comparer(together: int):
    """Partial differences of the groups of two shares of a language, over one block of terms.
    Each group has a row without a place, in which ``count`` is the number of terms of the block."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one, two = int(rows["one"].iat[0]), int(rows["two"].iat[0])
        groups = rows[rows["place"] < 0].sort_values("number")
        numbers = groups["number"].to_numpy()
        counts = np.zeros((len(numbers), int(groups["count"].iat[0])), dtype=np.int64)
        real = rows[rows["place"] >= 0]
        counts[np.searchsorted(numbers, real["number"]), real["place"]] = real["count"]
        share = numbers // together
        wanted = (share[:, None] == one) & (share == two) & (numbers[:, None] < numbers)
        left, right = np.nonzero(wanted)
        pairs = list(zip(left.tolist(), right.tolist(), strict=True))
        value = differences(counts, pairs, groups["total"].tolist(), int(groups["terms"].iat[0]))
        found = {"lang": rows["lang"].iat[0], "a": numbers[left], "b": numbers[right], "value": value}
        return pd.DataFrame(found).astype({"value": "int64"})

    return run


def _numbered_groups(groups: DataFrame) -> DataFrame:
    """Add ``number``, from 0 within each lang. Groups are few beside documents and terms."""
    by_source = Window.partitionBy("lang").orderBy("source")
    return groups.withColumn("number", F.row_number().over(by_source) - 1)


def audit(
    docs: DataFrame,
    least: int = LEAST_DOCUMENTS,
    top: int = TOP,
    block: int = TERMS,
    together: int = GROUPS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs.

    Part ``pair``: for every other source of the language the sum of |p - q| over the kept
    terms, all ranks. Part ``term``: the ``top`` terms whose share in the source is furthest above
    that in the language. Kept terms are those in at least ``least`` documents (rows) of the
    language; ties go to the smaller item. Null text, lang and source count as ''; repeated
    rows count each; other columns are ignored; an empty table gives no rows. A task
    compares ``together`` groups with as many over a ``block`` of terms.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    counts = written(counted(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.sum("count").alias("in_lang")
    )
    kept = written(kept.where(F.col("documents") >= least), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("lang_total"))
    found = counts.drop("documents").join(kept.drop("documents"), ["lang", "term"])
    found = written(found, "found")
    totals = found.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = docs.select(*names).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total"])
    groups = written(_numbered_groups(groups), "groups")
    return _pairs(found, kept, groups, block, together).unionByName(_terms(found, groups, top))


def _terms(found: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    p = _price(F.col("count"), F.col("total"), F.col("terms"))
    q = _price(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    above = found.join(groups.drop("number"), ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (p - q).cast("long").alias("value"),
    )
    return _ranked(above.where("value > 0")).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _blocks(kept: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(lang, term, block, place): terms dealt over blocks, in descending frequency in each."""
    # a block holds at most CELLS counts, however many sources its language has
    size = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(CELLS) / F.col("sources"))))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / size))
    dealt = kept.join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("term"), blocks))
    by_count = Window.partitionBy("lang", "block").orderBy(F.col("in_lang").desc(), "term")
    place = (F.row_number().over(by_count) - 1).alias("place")
    return written(dealt.select("lang", "term", "block", place), "places")


def _pairs(
    found: DataFrame, kept: DataFrame, groups: DataFrame, block: int, together: int
) -> DataFrame:
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.max("terms").alias("terms"))
    sizes = written(sizes, "sizes")
    places = _blocks(kept, sizes, block)
    of_group = groups.select("lang", "source", "number", "total", "terms")
    cells = found.join(places, ["lang", "term"]).join(of_group, ["lang", "source"])
    widths = places.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("count"))
    every = of_group.join(widths, "lang").withColumn("place", F.lit(-1))
    columns = ["lang", "block", "place", "number", "count", "total", "terms"]
    rows = cells.select(columns).union(every.select(columns)).join(sizes.select("lang", "sources"), "lang")
    share, last = F.floor(F.col("number") / together), F.ceil(F.col("sources") / together) - 1
    other = F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other")
    tasks = rows.select(*columns, share.alias("share"), other).select(
        *columns, F.least("share", "other").alias("one"), F.greatest("share", "other").alias("two")
    )
    parts = tasks.groupBy("lang", "block", "one", "two").applyInPandas(
        _comparer(together), "lang string, a int, b int, value long"
    )
    sums = written(parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "sums")
    both = sums.union(sums.select("lang", "b", "a", "value"))
    one, two = groups.select("lang", "source", "number"), groups.select("lang", F.col("source").alias("item"), "number")
    if_no_terms = F.coalesce("value", F.lit(0).cast("long")).alias("value")
    pairs = one.withColumnRenamed("number", "a").join(two.withColumnRenamed("number", "b"), "lang")
    pairs = pairs.where("a <> b").join(both, ["lang", "a", "b"], "left")
    return _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", if_no_terms))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of all documents: pairs of sources, and terms that stand out."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
words AS (SELECT r, lang, source,
    unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS c FROM words GROUP BY lang, source, term),
cells AS (
    SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c FROM groups g JOIN kept k ON g.lang = k.lang
    LEFT JOIN counts n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
priced AS (
    SELECT lang, source, term, c, 1 + (CAST(c + 5 AS HUGEINT) * 1000000000)
        // (sum(c) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p
    FROM cells),
whole AS (SELECT lang, term, sum(c) AS c FROM cells GROUP BY lang, term),
whole_priced AS (
    SELECT lang, term, 1 + (CAST(c + 5 AS HUGEINT) * 1000000000)
        // (sum(c) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM whole),
distance AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term GROUP BY a.lang, a.source, b.source),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN distance x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL
    SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM priced p
    JOIN whole_priced q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
ranked AS (SELECT *, CAST(row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
