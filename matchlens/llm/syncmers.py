"""Operator 7: document fingerprints from closed syncmers.

Only DataFrame functions. A syncmer is a run of ``K`` words whose smallest inner run of ``S``
words (by hash) is its first or its last. Whether a run is chosen depends on its own words
alone, so an edit changes no choice beyond the runs it touches, and of ``K`` - ``S`` + 1
neighbours at least one is chosen. A fingerprint is all distinct hashes of a document's syncmers;
the likeness of two is the share of common hashes among those of both. ``passages`` also uses where
the syncmers are: it matches those that two texts share at one offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlens.llm.store import partitions, written

K, S = 5, 2
#: Ranges of doc_id in which neighbours are sought: at least this many, and one for so many rows.
ROWS_IN_RANGE, MOST_RANGES = 10_000, 1024


def _ahead(values: Column, n: int) -> Column:
    """``values`` from the ``n``-th on, so that it can be zipped with its start."""
    return F.slice(values, F.lit(n + 1), F.greatest(F.size(values) - n, F.lit(0)))


def _zip(a: Column, b: Column, of) -> Column:
    """Element by element over the shorter, ``b``."""
    return F.zip_with(F.slice(a, F.lit(1), F.size(b)), b, of)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"\s+", " "), " "), "")


def with_syncmers(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array<struct<at, mark>> of the closed syncmers of ``text``, in order; ``at``
    counts words from 0. A text of 1 to ``K`` - 1 words has one, of all its words; one without
    words (empty or null) has none. Words are what white space parts, in lower case."""
    step = df.withColumn(out, F.transform(_words(F.col(text)), lambda w: F.xxhash64(w)))
    first = F.col(out)
    inner = _zip(first, _ahead(first, 1), lambda a, b: F.xxhash64(a, b))
    step = step.withColumn(out, F.struct(first.alias("words"), inner.alias("inner")))
    words, inner = F.col(f"{out}.words"), F.col(f"{out}.inner")
    least = _zip(inner, _ahead(inner, 1), lambda a, b: F.least(a, b))
    step = step.withColumn(out, F.struct(words.alias("words"), inner.alias("inner"), least.alias("least")))
    least = F.col(f"{out}.least")  # of two neighbours; of four, where two such are two apart
    edges = _zip(inner, _ahead(inner, K - S), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    lowest = _zip(least, _ahead(least, 2), lambda a, b: F.least(a, b))
    chosen = F.zip_with(
        edges, lowest, lambda e, low: F.when((e["a"] == low) | (e["b"] == low), e)
    )
    mark = lambda e, i: F.xxhash64(e["a"], F.get(inner, i + 2), F.get(words, i + K - 1))
    found = F.transform(
        chosen, lambda e, i: F.when(e.isNotNull(), F.struct(i.alias("at"), mark(e, i).alias("mark")))
    )
    short = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(words).alias("mark")))
    none = F.array().cast("array<struct<at:int,mark:bigint>>")
    return step.withColumn(
        out,
        F.when(F.size(words) >= K, F.array_compact(found))
        .when(F.size(words) > 0, short)
        .otherwise(none),
    )


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the marks of all syncmers of ``text``, ascending and distinct."""
    marks = F.sort_array(F.array_distinct(F.transform(out, lambda m: m["mark"])))
    return with_syncmers(df, text, out).withColumn(out, marks)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: common marks among all of both. Two of documents without words are
    alike."""
    all_, both = F.size(a) + F.size(b), F.size(F.array_union(a, b))
    return F.when(all_ == 0, 1.0).otherwise((all_ - both) / both)


def passages(pairs: DataFrame, key: str, text: str, other: str, least: int = 2) -> DataFrame:
    """(``key``, at, other_at, n_words, n_marks): passages that ``text`` and ``other`` share, from
    word ``at`` in one and ``other_at`` in the other on.

    Shared marks lie on one passage if they have the same offset between the texts and their
    syncmers overlap or touch (each counts as ``K`` words, also that of a shorter text); passages of
    fewer than ``least`` marks are left out. Every place of
    a mark is matched with every place in the other text, so rows grow with the repeats of a mark
    within a pair of texts. ``key`` tells pairs apart; pairs where it is null are left out.
    """
    rows = pairs.select(F.col(key).alias("pair"), F.col(text).alias("text"), F.col(other).alias("other"))
    sides = with_syncmers(with_syncmers(rows, "text", "one"), "other", "two")
    sides = written(sides.select("pair", "one", "two"), "syncmers")
    one = sides.select("pair", F.inline("one"))
    two = sides.select("pair", F.inline("two").alias("other_at", "mark"))
    met = one.join(two, ["pair", "mark"]).withColumn("offset", F.col("other_at") - F.col("at"))
    on = Window.partitionBy("pair", "offset").orderBy("at")
    begins = F.col("at") - F.lag("at").over(on) > K
    begun = met.withColumn("begins", F.coalesce(begins, F.lit(True)).cast("int"))
    found = begun.withColumn("passage", F.sum("begins").over(on))
    ends = found.groupBy("pair", "offset", "passage").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("marks")
    )
    return ends.where(F.col("marks") >= least).select(
        F.col("pair").alias(key),
        F.col("first").alias("at"),
        (F.col("first") + F.col("offset")).alias("other_at"),
        (F.col("last") - F.col("first") + K).alias("n_words"),
        F.col("marks").alias("n_marks"),
    )


def as_text(fingerprint: Column) -> Column:
    """16 lower-case hex digits for each mark."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda m: F.lpad(F.hex(m), 16, "0")), ""))


def _ranges(rows: DataFrame) -> Column:
    """The number of the range of a row's doc_id: the first has the largest, the last the nulls.
    Ranges hold about equally many rows; at most ``MOST_RANGES`` bounds reach the driver."""
    n = max(partitions(rows.sparkSession), rows.count() // ROWS_IN_RANGE)
    n = min(MOST_RANGES, n)
    shares = [k / n for k in range(1, n)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 20 * n)).first()[0] if shares else None
    bounds = F.lit(sorted(set(found or []), reverse=True)).cast("array<bigint>")
    above = F.size(F.filter(bounds, lambda bound: bound > F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.size(bounds) + 1).otherwise(above)


def with_next(rows: DataFrame) -> DataFrame:
    """Add ``marks``, the fingerprint of ``text``, and ``next_text`` and ``next_marks`` of the
    next row in descending order of (doc_id, text), nulls last; after the last the first's.

    Rows are dealt once, by ranges of doc_id, and sorted in each. A row whose next one lies in
    another range gets it from the first rows of ranges, one for each.
    """
    rows = rows.withColumn("range", _ranges(rows))
    firsts = rows.groupBy("range").agg(F.max(F.struct("doc_id", "text")).alias("top"))
    firsts = with_fingerprint(firsts.select("range", "top.text"), "text", "marks")
    firsts = firsts.select("range", F.struct("text", "marks").alias("top"))
    around, everyone = Window.orderBy("range"), Window.partitionBy()
    before = F.coalesce(F.lag("range").over(around), F.max("range").over(everyone))
    firsts = written(firsts.select(before.alias("range"), "top"), "firsts")
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last()]
    following = F.lead(F.struct("text", "marks")).over(Window.partitionBy("range").orderBy(*order))
    # Texts are dealt first, and marks taken where they are sorted: marks are never shuffled.
    dealt = with_fingerprint(rows.repartition("range"), "text", "marks").withColumn("following", following)
    found = dealt.join(firsts, "range").withColumn("following", F.coalesce("following", "top"))
    return found.select(
        *rows.drop("range").columns,
        "marks",
        F.col("following.text").alias("next_text"),
        F.col("following.marks").alias("next_marks"),
    )


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last third replaced by as much of the start of the next document's.
    Null texts count as empty; rows with one doc_id are ordered by text; repeated rows are kept;
    other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = with_next(rows)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.left("next_text", third))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = with_fingerprint(rows, "edited", "edited_marks")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("marks")).alias("fingerprint"),
        as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their edited texts and their neighbours."""
    return fingerprint_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
