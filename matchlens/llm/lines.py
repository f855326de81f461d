"""Operator 1: line dedup across documents, exact and within one edited word.

Only DataFrame functions. A line is read as its lower-case words. Of equal lines the earliest
stays. For lines of ``NEAR_WORDS`` or more, a line also goes if an earlier one is within one
inserted, deleted or replaced word. Such lines are found by their deletion neighbourhood: each
line emits hashes of itself and of every copy with one word taken out. Two lines that differ by
a replaced word meet in the same copy with the gap at the same place; a line meets one with a
word more in that one's copy. So every line needs only the earliest of each meeting, no group
is ever paired with itself.

Emitting a hash per word is only done for lines that can have a partner: as one edit leaves one
half of a line as it is, lines that share no half with another line are sieved out first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.functions.barrier import evaluate_once
from matchlens.llm.store import free_name, passing, row_key, written

#: Bounds of the query, as in its SQL: lines with fewer words always stay; lines from so many words
#: on are also compared for edits. Where all lines are compared, those with fewer words than the
#: second are compared for equality, and an edit of a word with a digit does not count.
LEAST_WORDS, NEAR_WORDS = 3, 8
#: How a line takes part in a meeting: with a gap at its place, with a word cut out anywhere, as
#: it is. The first meet each other, the others meet across.
GAP, CUT, WHOLE = 0, 1, 2
#: Candidate lines up to which their places are broadcast (22 bytes each).
HELD_PLACES = 500_000


def _words(line: Column) -> Column:
    blanks = F.replace(F.replace(F.lower(line), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    words = F.split(F.trim(blanks), " ")
    return F.when(F.contains(blanks, F.lit("  ")), F.array_remove(words, "")).otherwise(words)


def _key(marks: Column) -> Column:
    """128 bits by which lines meet those with a word less, from the hashes of their words."""
    both = F.aggregate(marks, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
    return F.struct(F.xxhash64(marks).alias("x"), both.alias("y"))


def _halves(words: Column, n: Column) -> Column:
    """Hashes of the halves, cut as for a line of this length and of one word less; those of
    first halves are odd."""
    heads, tails = [F.floor(n / 2), F.floor((n - 1) / 2)], [F.ceil(n / 2), F.ceil((n - 1) / 2)]
    heads = [F.slice(words, F.lit(1), k.cast("int")) for k in heads]
    tails = [F.slice(words, -k.cast("int"), k.cast("int")) for k in tails]
    return F.array_distinct(
        F.array(
            *[F.xxhash64(half).bitwiseOR(F.lit(1)) for half in heads],
            *[F.xxhash64(half).bitwiseAND(F.lit(-2)) for half in tails],
        )
    )


def _without(words: Column, i: Column) -> Column:
    """``words`` less the one at ``i`` (from 0)."""
    return F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.size(words)))


def _said(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, line, said): every line, as it is."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key("doc_id", F.col("text")).alias("row_key"),
        F.split("text", "\n").alias("lines"),
    )
    return rows.select("doc_id", "row_key", F.posexplode("lines").alias("line", "said"))


def _read(said: DataFrame) -> DataFrame:
    """Add words, n_words and key, 128 bits of the words in order."""
    rows = evaluate_once(said, words=_words(F.col("said"))).drop("said")
    key = F.struct(F.xxhash64("words").alias("x"), F.xxhash64(F.lit(1), "words").alias("y"))
    return rows.withColumn("n_words", F.size("words")).withColumn("key", key)


def _compared(every: bool) -> Column:
    """Lines of ``LEAST_WORDS`` or more, or ``every`` line that is not blank."""
    if every:
        return (F.col("n_words") > 1) | (F.get("words", F.lit(0)) != "")
    return F.col("n_words") >= LEAST_WORDS


def _candidates(docs: DataFrame, found: DataFrame, firsts: DataFrame) -> DataFrame:
    """(order, words, key, low, high): lines with a half in common with another line, at
    their earliest place, and between which words the edit to such a line must be."""
    halves = found.select("key", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    shared = written(shared.where("low <> high").select("half"), "shared")
    is_head = F.col("half").bitwiseAND(F.lit(1)) == 1
    keys = halves.join(shared, "half").groupBy("key")
    keys = keys.agg(F.max(is_head).alias("head"), F.max(~is_head).alias("tail"))
    places = keys.join(firsts, "key").select(
        F.col("first.doc_id").alias("at_id"), F.col("first.row_key").alias("at_key"),
        F.col("first.line").alias("at_line"), "head", "tail",
    )
    places = written(places, "places")
    held = places if places.count() > HELD_PLACES else F.broadcast(places)
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("row_key") == F.col("at_key"))
    chosen = _said(docs).join(held, same & (F.col("line") == F.col("at_line")))
    n = F.col("n_words")
    low = F.when(F.col("tail"), 0).otherwise(F.floor((n - 1) / 2)).cast("int")
    high = F.when(F.col("head"), n - 1).otherwise(F.floor((n + 1) / 2)).cast("int")
    lines = _read(chosen).select(
        F.struct("doc_id", "row_key", "line").alias("order"), "words", "key",
        low.alias("low"), high.alias("high"),
    )
    return written(lines.dropDuplicates(["key"]), "candidates")


def _near(docs: DataFrame, found: DataFrame, firsts: DataFrame, every: bool) -> DataFrame:
    """(key) of the lines that have an earlier line within one word."""
    lines = _candidates(docs, found, firsts)
    places = F.sequence("low", "high")
    if every:  # numbers, dates and amounts tell lines apart: no edit there
        places = F.filter(places, lambda i: ~F.get("words", i).rlike(r"\p{N}"))
    marked = lines.select(
        "order", F.transform("words", lambda w: F.xxhash64(w)).alias("marks"), places.alias("places")
    )
    marked = marked.withColumn("met", _key(F.col("marks")))
    i, x, y = F.col("i"), F.col("x"), F.col("y")
    copies = marked.select("order", "marks", "met", F.explode("places").alias("i")).select(
        "order", "i", F.xxhash64(_without(F.col("marks"), i)).alias("x"),
        F.col("met.y").bitwiseXOR(F.get("marks", i)).alias("y"),
    )
    gap = F.struct(F.lit(GAP).alias("role"), F.xxhash64(x, i).alias("x"), y.alias("y"))
    cut = F.struct(F.lit(CUT).alias("role"), x.alias("x"), y.alias("y"))
    copies = copies.select("order", F.inline(F.array(gap, cut)))
    whole = marked.select("order", F.lit(WHOLE).alias("role"), "met.x", "met.y")
    met = written(copies.union(whole), "variants")
    roles = {k: F.col("role") == v for k, v in (("gap", GAP), ("cut", CUT), ("whole", WHOLE))}
    earliest = [F.min(F.when(is_role, F.col("order"))).alias(k) for k, is_role in roles.items()]
    firsts = met.groupBy("x", "y").agg(*earliest, F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.where("n > 1").drop("n"), "meetings")
    other = (
        F.when(roles["gap"], F.col("gap"))
        .when(roles["cut"], F.col("whole"))
        .otherwise(F.col("cut"))
    )
    links = met.join(firsts, ["x", "y"]).select("order", other.alias("other"))
    links = links.where("other < order").groupBy("order").agg(F.min("other").alias("other"))
    earlier = lines.select(F.col("order").alias("other"), F.col("words").alias("other_words"))
    one = lines.select("order", "key", "words")
    return links.join(one, "order").join(earlier, "other").where(_one_edit()).select("key")


def _one_edit() -> Column:
    """Whether ``words`` and ``other_words`` are at most one word apart."""
    a, b = F.col("words"), F.col("other_words")
    unlike = F.zip_with(a, b, lambda x, y: F.when(~x.eqNullSafe(y), 1))
    places = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    return (
        F.when(F.size(a) == F.size(b), F.size(F.array_compact(unlike)) <= 1)
        .when(F.size(a) == F.size(b) + 1, F.exists(places, lambda i: _without(a, i) == b))
        .when(F.size(a) + 1 == F.size(b), F.exists(places, lambda i: _without(b, i) == a))
        .otherwise(False)
    )


def removed_lines(docs: DataFrame, every: bool = False) -> DataFrame:
    """(doc_id, row_key, line) of each line to remove; ``line`` counts from 0. With ``every``,
    lines of any number of words are compared, see ``dedup_lines``."""
    halves = F.when(
        F.col("n_words") >= NEAR_WORDS, _halves(F.col("words"), F.col("n_words"))
    ).otherwise(F.array().cast("array<bigint>"))
    read = _read(_said(docs)).where(_compared(every))
    found = read.select("doc_id", "row_key", "line", "key", halves.alias("halves"))
    found = written(found, "lines")
    firsts = found.groupBy("key").agg(
        F.min(F.struct("doc_id", "row_key", "line")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    firsts = written(firsts, "firsts")
    near = written(_near(docs, found, firsts, every).withColumn("near", F.lit(True)), "near")
    decided = firsts.where("n > 1").join(near, "key", "full").select("key", "first", "near")
    decided = written(decided, "decided")
    later = F.struct("doc_id", "row_key", "line") > F.col("first")
    return (
        found.drop("halves").join(decided, "key")
        .where(F.col("near") | F.coalesce(later, F.lit(False)))
        .select("doc_id", "row_key", "line")
    )


def mark_lines(docs: DataFrame, out: str = "removed", every: bool = False) -> DataFrame:
    """``docs`` with the sorted numbers of its lines to remove (null: none)."""
    of, key = free_name(docs, "removed_of"), free_name(docs, "removed_key")
    with passing() as kept:
        per_document = removed_lines(docs, every).groupBy("doc_id", "row_key").agg(
            F.array_sort(F.collect_set("line")).alias(out)
        )
        per_document = per_document.select(F.col("doc_id").alias(of), F.col("row_key").alias(key), out)
        gone = kept(written(per_document))
    same = docs["doc_id"].cast("long").eqNullSafe(gone[of])
    same &= row_key(docs["doc_id"], docs["text"]) == gone[key]
    return docs.join(gone, same, "left").drop(of, key)


def kept_text(removed: Column) -> Column:
    """The text without the lines of ``removed``; the text itself where that is null."""
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return F.when(removed.isNull(), F.col("text")).otherwise(rest)


def dedup_lines(docs: DataFrame, every: bool = True) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; rows and other columns stay.

    All lines but blank ones are compared for equality. Those of ``NEAR_WORDS`` words and more also
    go if an earlier one is within one word, unless that word has a digit; headings, dates, amounts
    and code, which differ in little, so stay. Without ``every``, the bounds of the query hold.

    The earliest line is that with the smallest (doc_id, line), null doc_ids first. Whether an
    earlier line goes itself does not matter. Null and empty texts stay as they are; a document
    that loses every line has an empty text. Exact repeats of a row count as one and all stay
    alike; among rows with one doc_id but other texts, a hash decides which is earlier. A text
    is cut at line feeds only; words are cut at blanks, tabs and carriage returns.
    """
    removed = free_name(docs, "removed")
    marked = mark_lines(docs, removed, every)
    text = kept_text(F.col(removed)).alias("text")
    return marked.select(*[text if c.lower() == "text" else F.col(c) for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: how many lines they have and lose, and a digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.col("removed")
    return mark_lines(docs).select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col("removed")), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(kept_text(removed), F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = """
WITH raw AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
numbered AS (SELECT doc_id, l[i + 1] AS said, i FROM (
    SELECT doc_id, l, unnest(range(len(l))) AS i FROM raw)),
lines AS (SELECT doc_id, i, list_filter(string_split(translate(lower(said), chr(9) || chr(13),
    '  '), ' '), lambda x: x <> '') AS w, said FROM numbered),
long AS (
    SELECT w, array_to_string(w, ' ') AS line, min({'d': doc_id, 'i': i}) AS first
    FROM lines WHERE len(w) >= 3 GROUP BY w),
cuts AS (
    SELECT line, first, p, array_to_string(list_concat(w[1:p], w[p + 2:]), ' ') AS rest
    FROM (SELECT line, first, w, unnest(range(len(w))) AS p FROM long WHERE len(w) >= 8)),
near AS (
    SELECT a.line FROM cuts a JOIN cuts b USING (rest, p) WHERE b.first < a.first
    UNION SELECT a.line FROM cuts a JOIN long b ON a.rest = b.line
        WHERE b.first < a.first AND len(b.w) >= 8
    UNION SELECT b.line FROM cuts a JOIN long b ON a.rest = b.line
        WHERE a.first < b.first AND len(b.w) >= 8),
fate AS (
    SELECT doc_id, i, said, long.line IS NOT NULL AND ({'d': doc_id, 'i': i} > first
        OR near.line IS NOT NULL) AS gone
    FROM lines LEFT JOIN long ON array_to_string(lines.w, ' ') = long.line AND len(lines.w) >= 3
    LEFT JOIN near ON near.line = long.line)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_removed,
    sha256(coalesce(string_agg(said, chr(10) ORDER BY i) FILTER (WHERE NOT gone), ''))
    AS kept_sha256
FROM fate GROUP BY doc_id
"""
