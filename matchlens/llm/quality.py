"""Operator 10: importance resampling of documents towards labelled good ones.

Two hashed n-gram models are counted: of the target text (labelled documents of good quality
that are not toxic) and of the raw text (all documents). An n-gram's log ratio tells how much
more frequent it is among the good than in raw text; how sure that is, grows with its count. There are
three kinds of n-grams: words, word beginnings, and the shape of a word together with whether
it repeats the one before it.

A long document holds far more ordinary words than telling ones, so the ratio of a whole text
would say little of a passage in it. Its weight is that of its worst passage: the least, over all
single words and beginnings and all runs of ``PASSAGE`` n-grams of a kind, of the summed log
ratios less what target text has on average, divided by the root of the run's length.

Documents are drawn without replacement by Gumbel top-k: the k with the largest log weight plus
Gumbel noise. k is the number of documents whose weight is at least the cut that separates the
labelled good from the rest best, among labelled documents whose words were not counted. Every count, k and the k-th key cover all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm.store import free_name, row_key, ship, written

#: Buckets of all hashed n-grams; the model is one number for each.
BUCKETS, BLOCK = 1 << 20, 1 << 12
PASSAGE, BEGINNING, SHAPE = 32, 5, 8
#: Log weights are worst passages divided by this; the noise has a spread of about one.
TEMPERATURE = 0.05
#: About so many labelled rows are used at most, those of the smallest hashes.
MOST_LABELS = 200_000
HELD = 4
KINDS, SHAPES = 3, 2
#: How many times its share a lost good document counts against a rejected bad one.
CARE = 2
REMEMBERED, LONGEST = 1 << 19, 64
_ROUNDS, _BINS = 4, 4096

_LETTERS, _DIGITS, _RUNS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")
_EDGES = ".,;:!?()\"'"


class _Grams(dict):
    """Words by number; a table has the hashes of their n-grams: of the word, its beginning and
    its shape."""

    def __init__(self) -> None:
        self.table = np.zeros((REMEMBERED, KINDS), dtype=np.int32)
        self.used = 0

    def __missing__(self, word: str) -> int:
        number = self.used
        if number == len(self.table):  # within one text; the table shrinks again with the next
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        core = word.strip(_EDGES)
        if word.isalpha():
            shape = "a"
        elif word[:-1].isalpha():
            shape = "a" + _DIGITS.sub("0", word[-1])
        else:
            shape = _RUNS.sub(r"\1", _DIGITS.sub("0", _LETTERS.sub("a", word)))[:SHAPE]
        for kind, gram in enumerate(("w" + core, "b" + core[:BEGINNING], "s" + shape)):
            self.table[number, kind] = xxhash.xxh64_intdigest(gram) % BUCKETS
        self.used += 1
        if len(word) <= LONGEST:
            self[word] = number
        return number

    def of(self, text: str | None) -> np.ndarray:
        """The buckets of a text: a row for each kind, a column for each word."""
        words = (text or "").lower().split()
        if self.used + len(words) > REMEMBERED and self.used:
            self.clear()
            self.__init__()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        found = self.table[numbers].T
        again = numbers[1:] == numbers[:-1]
        found[SHAPES, 1:] = (found[SHAPES, 1:] + 7919 * again) % BUCKETS
        return found


@cache
def _grams() -> _Grams:
    return _Grams()


def labelled(labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """(doc_id, good, held): documents with labels, about ``most`` at most. Several labels of
    one document must all be good; a document with a null among them is left out. Held ones,
    one in ``HELD``, are not counted as target text: the cut is found on them, as the words of
    counted ones look more usual than those of other documents."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    rows = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.agg(F.min(good).alias("good"), F.max(good.isNull()).alias("unsure"))
    rows = written(rows.where("not unsure").drop("unsure"), "labels")
    n, space = rows.count(), 1 << 40
    share = int(space * min(1.0, most / max(n, 1)))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < share)
    return rows.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD)) == 0)


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, row_key, text, good, held), the last two null without a label. The labels are
    few by construction, see ``labelled``."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key("doc_id", "text").alias("row_key"),
        F.col("text").cast("string").alias("text"),
    )
    return texts.join(F.broadcast(labels), "doc_id", "left").select(
        "doc_id", "row_key", "text", "good", "held"
    )


def count_grams(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(kind, bucket, target, raw): how often a shape is in texts, and in how many texts a word
    or beginning is, so that one which a single document repeats is no sign of others. Each
    task sums its documents up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros((KINDS, BUCKETS), dtype=np.int64)
        target = np.zeros((KINDS, BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, good, held in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                for kind, buckets in enumerate(_grams().of(text)):
                    there, n = np.unique(buckets, return_counts=True)
                    n = n if kind == SHAPES else 1
                    raw[kind, there] += n
                    if good and not held:
                        target[kind, there] += n
        kind, bucket = raw.nonzero()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kind.astype("i4")),
                pa.array(bucket.astype("i4")),
                pa.array(target[kind, bucket]),
                pa.array(raw[kind, bucket]),
            ],
            names=["kind", "bucket", "target", "raw"],
        )

    counted = _marked(docs, labels).mapInArrow(
        count, "kind int, bucket int, target long, raw long"
    )
    return counted.groupBy("kind", "bucket").agg(
        F.sum("target").alias("target"), F.sum("raw").alias("raw")
    )


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratio of each kind and bucket, less the target text's mean of its kind.

    Without target text all ratios are zero. The ratios reach the driver as blocks of numbers:
    ``KINDS`` * ``BUCKETS`` of four bytes at most, whatever the size of the corpus.
    """
    counts = written(count_grams(docs, labels), "counts")
    of, into = (F.col(c).cast("double") for c in ("target", "raw"))
    totals = counts.groupBy("kind").agg(F.sum(of), F.sum(into)).collect()  # a row for each kind
    shares = [(kind, target / raw) for kind, target, raw in totals if target]
    if not shares:
        return np.zeros((KINDS, BUCKETS), dtype=np.float32)
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares for x in pair]), F.col("kind"))
    rated = counts.where(F.col("kind").isin([kind for kind, _ in shares])).select(
        "kind", "bucket", "target", F.log((of + 1) / (into * share + 1)).alias("ratio")
    )
    means = rated.groupBy("kind").agg(F.sum(of * F.col("ratio")) / F.sum(of)).collect()

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows["bucket"].iloc[0] // BLOCK * BLOCK
        numbers = np.zeros(BLOCK, dtype=np.float32)
        numbers[rows["bucket"] - first] = rows["ratio"]
        there = np.zeros(BLOCK, dtype=bool)
        there[rows["bucket"] - first] = True
        found = {"first": [first], "ratios": [numbers.tobytes()], "there": [there.tobytes()]}
        return pd.DataFrame({"kind": rows["kind"].iloc[:1], **found})

    blocks = rated.groupBy("kind", (F.col("bucket") / BLOCK).cast("int")).applyInPandas(
        block, "kind int, first int, ratios binary, there binary"
    )
    model = np.zeros((KINDS, BUCKETS), dtype=np.float32)
    mean = dict(map(tuple, means))
    for kind, first, ratios, there in blocks.collect():
        centred = np.frombuffer(ratios, np.float32) - np.frombuffer(there, bool) * mean[kind]
        model[kind, first : first + BLOCK] = centred
    return model


def worst_passage(ratios: np.ndarray) -> float:
    """``ratios``: of each kind (row) and n-gram. Of no n-grams: 0."""
    n = ratios.shape[1]
    if not n:
        return 0.0
    run = min(n, PASSAGE)
    sums = np.cumsum(np.pad(ratios, ((0, 0), (1, 0))), axis=1, dtype=np.float64)
    return float(min(ratios[:SHAPES].min(), ((sums[:, run:] - sums[:, :-run]) / np.sqrt(run)).min()))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, row_key, worst, good, held) of every row of ``docs``."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = np.arange(KINDS)[:, None]
        for batch in batches:
            texts = batch.column(2).to_pylist()
            worst = [worst_passage(model.value[kinds, _grams().of(text)]) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(worst, pa.float64()), *batch.columns[3:]],
                names=["doc_id", "row_key", "worst", "good", "held"],
            )

    return _marked(docs, labels).mapInArrow(
        weigh, "doc_id long, row_key long, worst double, good boolean, held boolean"
    )


def best_cut(scored: DataFrame) -> float:
    """The least loss among held documents, if what is at or above it is kept: the share of
    bad ones kept plus ``CARE`` times the share of good ones lost. Keeps all if either are
    missing."""
    step = 0.05
    bins = scored.where("held").groupBy(F.floor(F.col("worst") / step).alias("bin"))
    bins = bins.agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("good").alias("n"))
    bins = bins.toPandas().sort_values("bin")  # as many as there are steps between scores
    good, bad = bins["good"].to_numpy(float), (bins["n"] - bins["good"]).to_numpy(float)
    if not good.sum() or not bad.sum():
        return float("-inf")
    lost = np.cumsum(good) - good
    gained = np.cumsum(bad) - bad
    return float(bins["bin"].iloc[int(np.argmax(gained / bad.sum() - CARE * lost / good.sum()))] * step)


def gumbel(*keys: str | Column) -> Column:
    """Standard Gumbel noise, the same for the same keys."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), *keys), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def top_threshold(keyed: DataFrame, k: int) -> float:
    """A bound that k values of ``key`` reach, or as few more as lie within 2^-48 of their range.

    Each round counts the values in equal bins and goes on in the one that holds the k-th.
    """
    low, high, above = *keyed.agg(F.min("key"), F.max("key")).first(), 0
    if k <= 0 or low is None:
        return float("inf")
    for _ in range(_ROUNDS):
        width = (high - low) / _BINS
        if width <= 0 or low + width == low:
            break
        bin_ = F.least(F.floor((F.col("key") - low) / width), F.lit(_BINS - 1))
        inside = keyed.where((F.col("key") >= low) & (F.col("key") <= high))
        counts = dict(map(tuple, inside.groupBy(bin_.alias("bin")).count().collect()))
        for b in sorted(counts, reverse=True):
            if above + counts[b] >= k:
                low, high = low + b * width, low + (b + 1) * width if b < _BINS - 1 else high
                break
            above += counts[b]
    return low


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, row_key, log_weight, key) of the rows of ``docs`` that are drawn.

    Null and empty texts have log weight 0, like text without any sign. Rows with the same
    doc_id and text get the same weight and noise: all are drawn or none. Rows tied at the last
    place are all drawn. Without labels of both kinds every row is drawn. An empty table gives
    no rows; null doc_ids are drawn like others; other columns are ignored.
    """
    scored = written(score(docs, written(labelled(labels), "labels")), "scored")
    log_weight = F.col("worst") / TEMPERATURE
    keyed = scored.select(
        "doc_id",
        "row_key",
        "worst",
        log_weight.alias("log_weight"),
        (log_weight + gumbel("doc_id", "row_key")).alias("key"),
    )
    k = keyed.where(F.col("worst") >= best_cut(scored)).count()
    return keyed.where(F.col("key") >= top_threshold(keyed, k)).drop("worst")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``select`` draws, as they are."""
    kept = select(docs, labels).select("doc_id", "row_key").distinct()
    keep, key = free_name(docs, "keep_id"), free_name(docs, "keep_key")
    kept = written(kept.select(F.col("doc_id").alias(keep), F.col("row_key").alias(key)))
    same = docs["doc_id"].cast("long").eqNullSafe(kept[keep])
    return docs.join(kept, same & (row_key("doc_id", "text") == kept[key]), "left_semi")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, with their log weight and key."""
    drawn = select(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/labels.parquet"),
    )
    return drawn.select("doc_id", "log_weight", "key")
