"""Operator 5, its other half: benchmark windows that a text holds nearly word by word.

A window of n terms stands near ``start`` of a document if enough of its places match. Place k
matches if the document has its term at most ``slack`` words from ``start + k``. At most
``missing`` places of a window of full size may fail, and as large a share, rounded down, of a
shorter one.

If m places may fail, one of any m + 1 places matches. So a window is looked up in the positional
index by its m + 1 rarest places, whose postings, moved back by their place, are the only starts
that can match; a term that no document has is such a place, and simply has no postings. Then the
lists of all other terms are intersected with these starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.decontamination import WINDOW, count_words, postings, windows_of
from matchlens.llm.store import free_name, row_key, ship, written

SLACK, MISSING = 3, 3


def _may_fail(n: Column, size: int, missing: int) -> Column:
    return F.floor(n * missing / size).cast("int")


def _places(windows: DataFrame, totals: DataFrame, size: int, missing: int) -> DataFrame:
    """(window, n_terms, may_fail, place, term, nth): every place of the different windows;
    ``nth`` is its rank among those of its window, rarest first."""
    each = windows.dropDuplicates(["window"]).select(
        "window", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("place", "said")
    )
    each = each.select(
        "window",
        "n_terms",
        _may_fail(F.col("n_terms"), size, missing).alias("may_fail"),
        "place",
        F.col("said").cast("binary").alias("term"),
    )
    known = each.join(totals, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = Window.partitionBy("window").orderBy("n", "place")  # at most ``size`` rows
    return known.withColumn("nth", F.row_number().over(rarest)).drop("n")


def _starts(index: DataFrame, places: DataFrame, slack: int) -> DataFrame:
    """(doc_id, row_key, window, start): starts that some of the rarest places match."""
    looked_up = places.where(F.col("nth") <= F.col("may_fail") + 1).select("term", "window", "place")
    met = index.join(looked_up, "term").select(
        "doc_id", "row_key", "window", (F.col("position") - F.col("place")).alias("there")
    )
    shift = F.explode(F.sequence(F.lit(-slack), F.lit(slack))).alias("shift")
    near = met.distinct().select("doc_id", "row_key", "window", "there", shift)
    start = (F.col("there") + F.col("shift")).alias("start")
    return near.select("doc_id", "row_key", "window", start).distinct()


def proximity_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    slack: int = SLACK,
    missing: int = MISSING,
) -> DataFrame:
    """(doc_id, row_key, item_id, window, start, n_terms, n_matched, n_in_place) of every window
    of ``benchmark`` that stands near some start of a row of ``docs``, see above.

    Of several starts the one with most matching places counts, then with most places at
    exactly their distance (``n_in_place``, equal to ``n_terms`` for exact phrases), then the
    first. A start may lie before the text, if the window's first words are missing. A word may
    match several places with its term. Texts and items are cut into words as by
    ``contamination``; null and empty ones have none and match nothing. Repeated rows count as one,
    null doc_ids stay, and items without an item_id match like others. Other columns are ignored.
    Without documents or items there are no rows.
    """
    if slack < 0 or not 0 <= missing < size:
        raise ValueError("slack must not be negative, and missing must be from 0 to below size")
    ship(docs.sparkSession)
    windows = written(windows_of(benchmark, size), "windows")
    vocabulary = windows.select(F.explode("terms").alias("term")).distinct()
    vocabulary = vocabulary.select(F.col("term").cast("binary").alias("term"))
    _, totals = count_words(docs, vocabulary)
    places = written(_places(windows, totals, size, missing), "places")
    rare = places.where(F.col("nth") <= F.col("may_fail") + 1).select("term").distinct()
    starts = written(_starts(postings(docs, rare), places, slack), "starts")

    # the index of all terms, of documents with such a start only
    met_id, met_key = free_name(docs, "met_id"), free_name(docs, "met_key")
    met = starts.select(F.col("doc_id").alias(met_id), F.col("row_key").alias(met_key)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(met[met_id])
    kept = docs.join(met, same & (row_key("doc_id", "text") == met[met_key]), "left_semi")
    index = postings(kept, vocabulary)

    # positions fall into cells as wide as a place's reach, which so lies in two cells at most
    wide = 2 * slack + 1
    index = index.select(
        F.col("doc_id").alias("i_id"),
        F.col("row_key").alias("i_key"),
        F.col("term").alias("i_term"),
        F.floor(F.col("position") / wide).alias("i_cell"),
        "position",
    )
    due = F.col("start") + F.col("place")
    cells = F.array_distinct(F.array(F.floor((due - slack) / wide), F.floor((due + slack) / wide)))
    asked = starts.join(places.drop("nth"), "window").select(
        "*", due.alias("due"), F.explode(cells).alias("cell")
    )
    there = (
        F.col("doc_id").eqNullSafe(F.col("i_id"))
        & (F.col("row_key") == F.col("i_key"))
        & (F.col("term") == F.col("i_term"))
        & (F.col("cell") == F.col("i_cell"))
    )
    off = F.abs(F.col("position") - F.col("due"))
    found = asked.join(index, there).where(off <= slack)
    at = ["doc_id", "row_key", "window", "n_terms", "may_fail", "start"]
    found = found.groupBy(*at, "place").agg(F.min(off).alias("off"))
    found = found.groupBy(*at).agg(
        F.count(F.lit(1)).alias("n_matched"), F.count_if(F.col("off") == 0).alias("n_in_place")
    )
    found = found.where(F.col("n_matched") >= F.col("n_terms") - F.col("may_fail"))
    best = F.max(F.struct("n_matched", "n_in_place", (-F.col("start")).alias("back"))).alias("best")
    found = found.groupBy("doc_id", "row_key", "window", "n_terms").agg(best)
    items = windows.select("window", "item_id").distinct()
    return found.join(items, "window").select(
        "doc_id",
        "row_key",
        "item_id",
        "window",
        (-F.col("best.back")).alias("start"),
        "n_terms",
        F.col("best.n_matched").alias("n_matched"),
        F.col("best.n_in_place").alias("n_in_place"),
    )
