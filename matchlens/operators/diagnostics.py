"""What a log contains: action types, samples, names and unit-like strings."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions.barrier import evaluate_once
from matchlens.functions.payload import (
    PARSED,
    any_match,
    is_production,
    item_count,
    match_texts,
    regex,
    unit_name,
    with_parsed,
)
from matchlens.functions.units import UNIT_PATTERNS
from matchlens.operators.containment import kept, shuffled
from matchlens.operators.patterns import matches_of
from matchlens.operators.series import MATCH

SAMPLES = 10
STRING_HITS = 20

#: Units of one class that are put to a match together.
BLOCK = 256

# Parts of unit names to look for, and the labels of sampled kinds.
UNIT_LIKE = r"villag|aldean|archer|arquero|skirm|militia|milicia|scout|explor"
SAMPLED_KINDS = ("DE_QUEUE", "ORDER", "BUILD", "RESEARCH")

_JSON_STRING = r'"(?:[^"\\]|\\.)*"\s*:?'


def action_type_counts(actions: DataFrame) -> DataFrame:
    """Actions of each type per match; a missing type counts as ''."""
    return actions.groupBy(MATCH, F.coalesce("type", F.lit("")).alias("type")).agg(
        F.count("*").alias("n")
    )


def by_frequency(counts: DataFrame) -> DataFrame:
    """Type counts, most common first within each match."""
    return counts.orderBy(MATCH, F.desc("n"), "type")


def sampled_kind(type_):
    """Label under which an action is sampled, or NULL."""
    queued, ordered, built, researched = SAMPLED_KINDS
    return (
        F.when(F.contains(type_, F.lit("QUEUE")), queued)
        .when(type_ == "ORDER", ordered)
        .when(type_ == "BUILD", built)
        .when(type_ == "RESEARCH", researched)
    )


def action_samples(actions: DataFrame, limit: int = SAMPLES) -> DataFrame:
    """The first actions of each kind in a match, with their payload.

    Spark keeps only ``limit`` rows per group and task before the shuffle.
    """
    first = Window.partitionBy(MATCH, "kind").orderBy("seq")
    return (
        actions.withColumn("kind", sampled_kind(F.col("type")))
        .filter(F.col("kind").isNotNull())
        .withColumn("rn", F.row_number().over(first))
        .filter(F.col("rn") <= limit)
        .select(MATCH, "kind", "rn", "seq", "type", "player", "payload")
    )


def prod_events(actions: DataFrame) -> DataFrame:
    return actions.filter(is_production(F.col("type"))).select(
        MATCH, "seq", "player", "t_us", "type"
    )


def unit_names(actions: DataFrame) -> DataFrame:
    """Production actions with the unit their payload names, if any."""
    return with_parsed(actions.filter(is_production(F.col("type")))).select(
        MATCH, "seq", unit_name(F.col(PARSED)).alias("name")
    )


def _with_class(pairs: DataFrame) -> DataFrame:
    """Add ``_class``, the same for units with the same sets of texts in ``pairs`` (_texts, unit):
    how many these are, and three hashes of 64 bits over them."""
    unit = Window.partitionBy("unit")
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "_texts")).over(unit).alias(f"h{i}") for i in range(3)]
    return pairs.select("*", F.struct(F.count(F.lit(1)).over(unit).alias("n"), *marks).alias("_class"))


def _per_unit_of_table(read: DataFrame, patterns: DataFrame) -> DataFrame:
    """Hits of ``patterns`` (unit, pattern) for ``read`` (match_id, items, _texts).

    Actions are first summed by match and set of texts, and written, so the log is read once. The
    patterns are joined to the distinct texts. Units that occur in the same sets are counted
    together as a class, and their names are put to the sums of each match last, in blocks: what
    is summed and shuffled does not grow with the number of units that a text has.
    """
    texts = F.array_sort(F.array_distinct("_texts"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("items").alias("items")]
    sets = kept(read.select(MATCH, "items", texts.alias("_texts")).groupBy(MATCH, "_texts").agg(*sums), "sets")
    each = sets.select("_texts").distinct().select("_texts", F.explode("_texts").alias("_text"))
    found = matches_of(each.select("_text").distinct(), patterns)
    pairs = _with_class(shuffled(each).join(found, "_text").select("_texts", "unit").distinct())
    # Each unit of a class has all of its sets, so any set tells how many units there are.
    classes = pairs.groupBy("_class", "_texts").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    totals = shuffled(sets).join(classes, "_texts").groupBy(MATCH, "_class", "_blocks").agg(
        F.sum("n").alias("n"), F.sum("items").alias("items")
    )
    places = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_block")
    block = F.pmod(F.xxhash64("unit"), F.col("_blocks")).alias("_block")
    members = shuffled(pairs.select("_class", "unit").distinct())
    dealt = members.join(classes.select("_class", "_blocks").distinct(), "_class")
    names = dealt.groupBy("_class", block).agg(F.collect_list("unit").alias("_units"))
    by = ["_class", "_block"]
    parts = int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = totals.select(MATCH, "_class", places, "n", "items").repartition(parts, *by)
    put = shuffled(spread).join(names.repartition(parts, *by), by)
    return put.select(MATCH, F.explode("_units").alias("unit"), "n", "items")


def unit_pattern_hits(
    actions: DataFrame, patterns: dict | DataFrame | None = None, mode: str = "loose"
) -> DataFrame:
    """Production actions and items of each unit line per match.

    Each action emits only the lines it matches, so nothing is multiplied by the
    number of patterns. ``patterns`` may be a DataFrame (unit, pattern), see ``patterns``.
    """
    known = UNIT_PATTERNS if patterns is None else patterns
    parsed = with_parsed(
        actions.filter(is_production(F.col("type")) & F.col("player").isNotNull())
    )
    read = evaluate_once(parsed, _texts=match_texts(F.col(PARSED), mode))
    if isinstance(known, DataFrame):
        rows = read.select(MATCH, item_count(F.col(PARSED)).alias("items"), "_texts")
        return _per_unit_of_table(rows, known)
    matched = [
        F.when(any_match(F.col("_texts"), pattern), F.lit(unit))
        for unit, pattern in known.items()
    ]
    # Units are collected in a projection, which is compiled; a generator's input is not.
    units = read.select(
        MATCH,
        item_count(F.col(PARSED)).alias("items"),
        F.array_compact(F.array(*matched)).alias("_units"),
    )
    return _per_unit(units.select(MATCH, "items", F.explode("_units").alias("unit")))


def _per_unit(hits: DataFrame) -> DataFrame:
    return hits.groupBy(MATCH, "unit").agg(F.count("*").alias("n"), F.sum("items").alias("items"))


def unit_string_hits(
    actions: DataFrame, pattern: str = UNIT_LIKE, limit: int = STRING_HITS
) -> DataFrame:
    """The first strings in a match's payloads that look like unit names.

    Strings at any depth, lists included, are found in the JSON text itself: a
    quoted token is a key if a colon follows. Within an action the last string
    comes first.
    """
    type_ = F.col("type")
    relevant = F.contains(type_, F.lit("QUEUE")) | type_.isin("ORDER", "BUILD", "RESEARCH")
    tokens = F.regexp_extract_all("payload", F.lit(_JSON_STRING), F.lit(0))
    values = F.filter(tokens, lambda s: ~F.endswith(s, F.lit(":")))
    plain = F.transform(
        values, lambda s: F.try_variant_get(F.try_parse_json(s), "$", "string")
    )
    hits = F.filter(F.reverse(plain), lambda s: s.rlike(regex(pattern)))
    first = Window.partitionBy(MATCH).orderBy("seq", "_place")
    return (
        actions.filter(relevant)
        .select(MATCH, "seq", "type", hits.alias("_hits"))
        .select(MATCH, "seq", "type", F.posexplode("_hits").alias("_place", "hit"))
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= limit)
        .select(MATCH, "seq", "type", "hit")
    )
