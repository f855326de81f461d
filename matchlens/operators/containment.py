"""Which strings of one table contain strings of another, without comparing all of them.

An inverted index of character n-grams. A string that is contained in another has all of its
grams there, so it is enough to look it up by one of them, the one that the fewest strings have.
What meets on that gram is then compared in full. Strings of fewer than ``GRAM`` characters are a
gram of their length themselves. All joins are on equal grams.

One of the tables comes from a log, with each string once; the other may be of any size. Spark takes
the size of exploded grams for that of the file they come from, and would broadcast them by that.
So every join says how it is done: strings of the log are broadcast if they are few by count, and
all else is shuffled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.sources.scratch import fresh_path

#: Characters of a gram.
GRAM = 4

#: Strings count as few up to so many rows, and so many bytes if each comes once for each of its grams.
FEW_ROWS, FEW_BYTES = 10_000, 1 << 24


def shuffled(df: DataFrame) -> DataFrame:
    """Joined by shuffling, whatever its size is estimated at."""
    return df.hint("merge")


def placed(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else shuffled(df)


def kept(df: DataFrame, kind: str) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder, so that the log is read once for them."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def are_few(strings: DataFrame, column: str) -> bool:
    """Whether the strings, by count, are so few that a broadcast of them or their grams is small."""
    length = F.octet_length(column).cast("double")
    size = strings.agg(F.count(F.lit(1)).alias("rows"), F.sum(length * length).alias("bytes")).first()
    return size["rows"] <= FEW_ROWS and (size["bytes"] or 0) <= FEW_BYTES


def short_sizes(strings: DataFrame, column: str) -> list[int]:
    """The lengths of up to ``GRAM`` characters that occur."""
    size = F.char_length(column)
    found = strings.filter(size <= GRAM).select(size.alias("n")).distinct().collect()
    return sorted(r["n"] for r in found)


def grams(string: Column, sizes) -> Column:
    """The distinct runs of ``sizes`` characters of a string; size 0 is the empty string."""
    none = F.array().cast("array<string>")

    def of_size(n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        places = F.sequence(F.lit(1), F.char_length(string) - (n - 1))
        found = F.transform(places, lambda at: F.substring(string, at, F.lit(n)))
        return F.when(F.char_length(string) >= n, found).otherwise(none)

    return F.array_distinct(F.concat(*[of_size(n) for n in sizes]))


def rarest_gram(
    strings: DataFrame, column: str, group: list[str], index: DataFrame, few: bool = False
) -> DataFrame:
    """Add ``_gram``: the gram of ``column`` that the fewest rows of ``index`` (group, _gram, ...)
    have. A string of up to ``GRAM`` characters is its own gram. Strings with a gram that is not in
    the index are left out: none there contains them. ``few``: whether ``strings`` are."""
    counts = index.groupBy(*group, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    is_short = F.char_length(column) <= GRAM
    short = strings.filter(is_short).withColumn("_gram", F.col(column))
    of = grams(F.col(column), [GRAM])
    long = strings.filter(~is_short).select("*", F.size(of).alias("_all"), F.explode(of).alias("_gram"))
    keys = strings.columns
    met = placed(long, few).join(counts, [*group, "_gram"])
    best = met.groupBy(*keys, "_all").agg(
        F.count(F.lit(1)).alias("_known"), F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram")
    )
    return short.unionByName(best.filter(F.col("_known") == F.col("_all")).select(*keys, "_gram"))


def containing(
    texts: DataFrame, text: str, parts: DataFrame, part: str, group: list[str], few: bool | None = None
) -> DataFrame:
    """Pairs of distinct ``texts`` and ``parts`` of one group whose text contains the part.

    Both have the columns ``group``; no other column may be common. An empty part is
    contained in every text of its group. ``few``: whether the texts are, see ``are_few``; they
    are counted where it is not given.

    Most parts are contained in no text. Their first and last gram are looked up before all of
    their grams are listed.
    """
    few = are_few(texts, text) if few is None else few
    known = texts.select(*group, F.explode(grams(F.col(text), [GRAM])).alias("_gram")).distinct()
    is_short = F.char_length(part) <= GRAM
    long = parts.filter(~is_short)
    for end in (F.left(F.col(part), F.lit(GRAM)), F.right(F.col(part), F.lit(GRAM))):
        held = long.withColumn("_gram", end).join(placed(known, few), [*group, "_gram"], "left_semi")
        long = held.drop("_gram")
    of = grams(F.col(part), [GRAM])
    index = long.select(*group, F.explode(of).alias("_gram"))
    index = index.join(placed(known, few), [*group, "_gram"], "left_semi")
    by_gram = parts.filter(is_short).withColumn("_gram", F.col(part))
    by_gram = by_gram.unionByName(rarest_gram(long, part, group, index))
    sought = texts.select("*", F.explode(grams(F.col(text), range(GRAM + 1))).alias("_gram"))
    met = shuffled(sought).join(by_gram, [*group, "_gram"]).drop("_gram")
    return met.filter(F.contains(F.col(text), F.col(part)))


def contained(
    parts: DataFrame, part: str, texts: DataFrame, text: str, group: list[str],
    few: bool | None = None, sizes: list[int] | None = None,
) -> DataFrame:
    """The same pairs where the ``texts`` are the table that is indexed: each part looks for its
    rarest gram among them. ``few``: whether the parts are; ``sizes``: their lengths of up to
    ``GRAM``. Both are looked up where they are not given."""
    few = are_few(parts, part) if few is None else few
    sizes = short_sizes(parts, part) if sizes is None else sizes
    own = parts.select(*group, F.explode(grams(F.col(part), [GRAM])).alias("_gram")).distinct()
    counted = texts.select(*group, F.explode(grams(F.col(text), [GRAM])).alias("_gram"))
    counted = counted.join(placed(own, few), [*group, "_gram"], "left_semi")
    by_gram = rarest_gram(parts, part, group, counted, few)
    index = texts.select("*", F.explode(grams(F.col(text), sorted({*sizes, GRAM}))).alias("_gram"))
    met = placed(by_gram, few).join(index, [*group, "_gram"]).drop("_gram")
    return met.filter(F.contains(F.col(text), F.col(part)))
