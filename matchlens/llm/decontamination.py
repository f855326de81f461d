"""Operator 5: benchmark passages in training text, by a positional inverted index.

The index holds where in which document a term stands. A window of benchmark words is looked
up from its rarest terms: their postings, shifted by the term's place in the window, must meet
at one start. What meets is compared word by word with the text. Postings are stored for the
terms that windows are looked up by; how rare a term is, is counted over all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm.store import free_name, row_key, ship, written

WINDOW = 13
#: Terms that a window is looked up by; a document is contaminated from this share of hit words.
RAREST, SHARE = 3, 20
#: Distinct lookup terms up to which tasks hold them as a set; beyond, they are joined.
HELD_TERMS = 1 << 20

#: Every byte that is no part of a word becomes a blank; A-Z become lower case. Bytes from 0x80
#: on (all of a character beyond ASCII) are word bytes.
_WORDS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
    else b + 32 if 0x41 <= b <= 0x5A
    else 0x20
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def _words(text: Column) -> Column:
    """The same in SQL, for the benchmark."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(
        F.coalesce(lower, F.lit("")), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)
    )


def windows_of(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, item_id, terms): every run of ``size`` words of each item, or all words of a
    shorter item; none of an item without words. ``window`` tells different terms apart."""
    items = benchmark.select(F.col("item_id"), _words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    runs = F.transform(starts, lambda i: F.slice("w", i + 1, size))
    terms = items.where(F.size("w") > 0).select("item_id", F.explode(runs).alias("terms"))
    return terms.distinct().withColumn("window", F.sha2(F.concat_ws(" ", "terms"), 256))


def count_words(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, n_words) of each document, and (term, n) of each of ``terms`` over all
    documents. Each task sums its terms up before they are shuffled."""
    kept = _held(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(kept) if kept is not None else None
        seen: Counter[bytes] = Counter()
        for batch in batches:
            sizes = []
            for text in batch.column(1).to_pylist():
                found = words_of(text)
                sizes.append(len(found))
                seen.update(found if wanted is None else filter(wanted.__contains__, found))
            yield _table(batch.column(0), batch.column(2), [None] * len(sizes), sizes)
            if len(seen) > HELD_TERMS:
                yield _table([None] * len(seen), [None] * len(seen), list(seen), list(seen.values()))
                seen.clear()
        yield _table([None] * len(seen), [None] * len(seen), list(seen), list(seen.values()))

    schema = "doc_id long, row_key long, term binary, n long"
    found = written(_bytes_of(docs).mapInArrow(count, schema), "words")
    sizes = found.where("term is null").select("doc_id", "row_key", F.col("n").alias("n_words"))
    totals = found.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
    return sizes, totals


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, doc_id, row_key, position) wherever one of ``terms`` stands."""
    kept = _held(terms)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(kept) if kept is not None else None
        for batch in batches:
            rows = []
            for doc_id, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, w in enumerate(words_of(text)):
                    if wanted is None or w in wanted:
                        rows.append((doc_id, key, w, k))
            yield _table(*(zip(*rows, strict=True) if rows else [[]] * 4))

    found = _bytes_of(docs).mapInArrow(
        post, "doc_id long, row_key long, term binary, n long"
    ).withColumnRenamed("n", "position")
    if kept is None:
        found = found.join(terms, "term", "left_semi")
    return written(found, "postings")


def lookups(windows: DataFrame, totals: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(window, term, place, rest): the rarest term of each window at its first place, and the
    next ``rarest`` - 1 with theirs. Windows with a term that no document has are left out."""
    runs = windows.dropDuplicates(["window"])
    places = runs.select("window", "terms", F.posexplode("terms").alias("place", "term"))
    places = places.select("window", "place", F.col("term").cast("binary").alias("term"))
    places = places.groupBy("window", "term").agg(F.min("place").alias("place"))
    known = places.join(totals, "term", "left").groupBy("window").agg(
        F.max(F.col("n").isNull()).alias("missing"),
        F.array_sort(F.collect_list(F.struct("n", "place", "term"))).alias("by_n"),  # of a window
    )
    rest = F.transform(F.slice("by_n", 2, rarest - 1), lambda t: F.struct(t["term"], t["place"]))
    return known.where("not missing").select(
        "window",
        F.col("by_n")[0]["term"].alias("term"),
        F.col("by_n")[0]["place"].alias("place"),
        rest.alias("rest"),
    )


def meet(index: DataFrame, looked_up: DataFrame, slack: int = 0) -> DataFrame:
    """(doc_id, row_key, window, start) where the lookup terms of a window stand together.

    The list of the rarest term, moved back by its place, is intersected with those of the
    others one after another. With ``slack`` 0 they stand at exactly their distances: candidates
    for exact phrases. Above, each at most ``slack`` words from there: proximity matches.
    """
    start = (F.col("position") - F.col("place")).alias("start")
    met = index.join(looked_up, "term").select("doc_id", "row_key", "window", start, "rest")
    if not slack:
        met = met.where("start >= 0")
    other = index.select(*(F.col(c).alias(f"i_{c}") for c in index.columns))
    same = F.col("doc_id").eqNullSafe(F.col("i_doc_id")) & (F.col("row_key") == F.col("i_row_key"))
    same &= F.col("ask.term") == F.col("i_term")
    due = F.col("start") + F.col("ask.place")
    if slack:
        same &= F.abs(F.col("i_position") - due) <= slack
    else:
        same &= F.col("i_position") == due
    for k in range(RAREST - 1):
        asked = written(met.withColumn("ask", F.get("rest", F.lit(k))), "met")
        there = asked.where("ask is not null").join(other, same, "left_semi")
        met = there.union(asked.where("ask is null")).drop("ask")
    return met.drop("rest")


def exact_matches(docs: DataFrame, candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_hit, items): candidates compared word by word with the texts.

    ``n_hit`` counts the words inside any true occurrence, ``items`` are the item_ids of the
    windows that occur. Documents without a candidate have no row.
    """
    terms = windows.groupBy("window").agg(
        F.first("terms").alias("terms"), F.collect_set("item_id").alias("item_ids")
    )
    spots = candidates.join(terms, "window").select(
        "doc_id",
        "row_key",
        F.struct("start", F.concat_ws(" ", "terms").cast("binary").alias("run"), "item_ids").alias("s"),
    )
    spots = spots.groupBy("doc_id", "row_key").agg(F.collect_list("s").alias("spots"))
    texts = _bytes_of(docs)
    same = texts["doc_id"].eqNullSafe(spots["doc_id"]) & (texts["row_key"] == spots["row_key"])
    joined = texts.join(spots, same).select(texts["doc_id"], texts["row_key"], "text", "spots")
    kind = dict(windows.dtypes)["item_id"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items = [], []
            for text, spots in zip(*(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                found = words_of(text)
                edges = np.zeros(len(found) + 1, dtype=np.int64)
                seen = set()
                for spot in spots:
                    run, start = spot["run"].split(b" "), spot["start"]
                    if found[start : start + len(run)] == run:
                        edges[start] += 1
                        edges[start + len(run)] -= 1
                        seen.update(spot["item_ids"])
                hits.append(int((np.cumsum(edges) > 0).sum()))
                items.append(sorted(seen))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(hits, pa.int64()),
                    pa.array(items, batch.column(3).type.value_type.field("item_ids").type),
                ],
                names=["doc_id", "row_key", "n_hit", "items"],
            )

    return joined.mapInArrow(
        compare, f"doc_id long, row_key long, n_hit long, items array<{kind}>"
    ).where("n_hit > 0").dropDuplicates(["doc_id", "row_key"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, row_key, n_words, n_hit, items, contaminated) of every row of ``docs``.

    Contaminated: at least one word in 20 is inside an occurrence of a window. Null and empty
    texts have no words. Repeated rows get equal results; null doc_ids stay. Items without an
    item_id hit words but are not listed. Other columns are ignored. An empty benchmark hits
    nothing; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    windows = written(windows_of(benchmark, size), "windows")
    vocabulary = windows.select(F.explode("terms").alias("term")).distinct()
    vocabulary = vocabulary.select(F.col("term").cast("binary").alias("term"))
    sizes, totals = count_words(docs, vocabulary)
    looked_up = written(lookups(windows, totals), "lookups")
    terms = looked_up.select("term").union(looked_up.select(F.explode("rest.term")))
    index = postings(docs, terms.distinct())
    found = exact_matches(docs, meet(index, looked_up), windows)
    found = written(found.select(*(F.col(c).alias(f"f_{c}") for c in found.columns)), "found")
    same = F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("row_key") == F.col("f_row_key"))
    hit = F.coalesce("f_n_hit", F.lit(0))
    return sizes.join(found, same, "left").select(
        "doc_id",
        "row_key",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("f_items", F.array().cast(dict(found.dtypes)["f_items"])).alias("items"),
        ((hit > 0) & (SHARE * hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they are."""
    found = contamination(docs, benchmark).where("contaminated")
    bad_id, bad_key = free_name(docs, "bad_id"), free_name(docs, "bad_key")
    bad = written(found.select(F.col("doc_id").alias(bad_id), F.col("row_key").alias(bad_key)))
    same = docs["doc_id"].cast("long").eqNullSafe(bad[bad_id])
    return docs.join(bad, same & (row_key("doc_id", "text") == bad[bad_key]), "left_anti")


def _held(terms: DataFrame) -> list[bytes] | None:
    """The terms, if they are few enough to be held by every task; else None."""
    found = [row[0] for row in terms.limit(HELD_TERMS + 1).collect()]
    return None if len(found) > HELD_TERMS else [bytes(x) for x in found]


def _bytes_of(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").cast("binary").alias("text"),
        row_key("doc_id", "text").alias("row_key"),
    )


def _table(doc_ids, keys, terms, numbers) -> pa.RecordBatch:
    kinds = pa.int64(), pa.int64(), pa.binary(), pa.int64()
    columns = doc_ids, keys, terms, numbers
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=["doc_id", "row_key", "term", "n"],
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
    )
    listed = F.array_sort(F.col("items").cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        "contaminated",
    )


#: Windows are joined to all runs of as many words. Runs are joined by blanks, as words have none.
ORACLE = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spans AS (
    SELECT item_id, w, least(len(w), 13) AS n, unnest(range(greatest(len(w) - 12, 1))) AS i
    FROM b WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS run FROM spans),
runs AS (
    SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS run
    FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i
          FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM runs JOIN windows USING (n, run)),
words AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
