"""Inputs in other forms than the adapter makes them, derived from its tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens import schema
from matchlens.functions.constants import constant_array
from matchlens.functions.costs import KINDS, RESOURCES
from matchlens.functions.payload import is_production
from matchlens.operators import postgame
from matchlens.operators.series import MATCH
from matchlens.sources import tables as stored
from matchlens.sources.events import BUILDINGS, TECHS, UNITS
from matchlens.sources.scratch import fresh_path

#: Fixed value: what is added to player numbers to make ids of more than 32 bits.
LONG_ID = 76561198000000000
POSTGAME_SHAPES = ("keys", "walk", "header", "slots", "nested")


def sync_packets(snapshots: DataFrame) -> DataFrame:
    """Snapshots as packets: one map of player states per packet, times in milliseconds."""
    state = F.struct(F.col("total_res").alias("total_res"))
    none = F.create_map().cast("map<string,struct<total_res:double>>")
    named = F.create_map(F.coalesce(F.col("player").cast("string"), F.lit("")), state)
    return snapshots.select(
        MATCH,
        "seq",
        (F.col("t_us") / 1000).alias("current_time"),
        F.when(F.col("player").isNotNull(), named).otherwise(none).alias("players"),
    )


def _prefixed(actions: DataFrame, when: Column, fields: str) -> DataFrame:
    """Production payloads with more fields in front."""
    more = F.concat(F.lit("{" + fields + ","), F.expr("substring(payload, 2)"))
    wanted = is_production(F.col("type")) & when
    return actions.withColumn("payload", F.when(wanted, more).otherwise(F.col("payload")))


def noted(actions: DataFrame) -> DataFrame:
    """A third of the production payloads with a note that names another unit."""
    return _prefixed(actions, F.col("seq") % 3 == 1, '"note":"Villager"')


def repeated_keys(actions: DataFrame) -> DataFrame:
    """Production payloads in which a name comes first that a later value may replace."""
    return _prefixed(actions, F.lit(True), '"unit_name":"Monk"')


def damaged_lines(actions: DataFrame) -> str:
    """A folder of actions as JSON lines: of a hundred, one breaks off, one has no match and one has
    a time that is no number."""
    n = F.col("seq") % 100
    whole = F.to_json(F.struct(*schema.ACTIONS.fieldNames()))
    line = (
        F.when(n == 13, F.concat(F.lit('{"match_id":'), "match_id", F.lit(',"seq":'), "seq"))
        .when(n == 14, F.concat(F.lit('{"seq":'), "seq", F.lit("}")))
        .when(n == 15, F.concat(F.lit('{"match_id":'), "match_id", F.lit(',"t_us":"soon"}')))
        .otherwise(whole)
    )
    path = fresh_path(actions.sparkSession, "lines")
    actions.select(line.alias("value")).write.text(path)
    return path


def without_player(actions: DataFrame, player: int) -> DataFrame:
    """Odd matches without the actions of a player."""
    return actions.filter((F.col(MATCH) % 2 == 0) | ~F.col("player").eqNullSafe(F.lit(player)))


def own_costs(part: DataFrame) -> DataFrame:
    """A cost table with a row for each part: some named after units, buildings or technologies,
    longer or shorter than these, the others after the part."""
    n = F.col("p_partkey")

    def pick(names: list[str]) -> Column:
        return F.lower(F.get(constant_array(names), (n % len(names)).cast("int")))

    base = F.when(n % 3 == 0, pick(UNITS)).when(n % 3 == 1, pick(BUILDINGS)).otherwise(pick(TECHS))
    named = part.withColumn("_base", base)
    name = (
        F.when(n % 7 == 0, F.concat_ws(" ", "_base", "p_name"))
        .when(n % 7 == 1, F.left("_base", 3 + F.col("p_size") % 4))
        .when((n % 7 == 2) & (n % 5 == 0), F.col("_base"))
        .otherwise(F.concat_ws(" ", "p_name", n))
    )
    return named.select(
        F.get(constant_array(KINDS), (n % 3).cast("int")).alias("kind"),
        (n * 7919 % 1000003).alias("prio"),
        name.alias("name"),
        F.col("p_size").cast("bigint").alias("food"),
        (n % 13).alias("wood"),
        (n % 101).alias("gold"),
        F.lit(0).cast("bigint").alias("stone"),
    )


def own_patterns(part: DataFrame) -> DataFrame:
    """A pattern for each part: one in fifty after a unit, the others after the part."""
    n = F.col("p_partkey")
    unit = F.get(constant_array(UNITS), (n % len(UNITS)).cast("int"))
    words = F.regexp_replace("p_name", " ", r"\\s*")
    pattern = (
        F.when(n % 100 == 7, F.concat(F.lower(F.left(unit, F.lit(4))), F.lit("|"), words))
        .when(n % 100 == 8, F.concat(F.regexp_replace(unit, "[- ]", ".?"), F.lit("$")))
        .otherwise(F.concat(words, F.lit("|"), "p_brand"))
    )
    named = F.when(n == 42, F.lit("Villager")).otherwise(F.concat(F.lit("Line "), n))
    return part.select(named.alias("unit"), pattern.alias("pattern"))


def reshaped(documents: DataFrame, shape: str) -> DataFrame:
    """Post-game documents with the same totals in one of POSTGAME_SHAPES.

    keys: an object by player number. walk: records in some list, behind a line feed, beside
    text that holds JSON. header: the replay header's list. slots: records without ids, the
    players in order. nested: each record five objects down, with a long id.
    """
    totals = postgame.postgame_totals(documents)
    entry = F.struct("player", *RESOURCES)
    listed = totals.groupBy(MATCH).agg(F.sort_array(F.collect_list(entry)).alias("all"))

    def amounts(p: Column, after: str = "") -> Column:
        return F.struct(*[p[r].alias(f"{r}{after}") for r in RESOURCES])

    def record(p: Column, inner: Column, name: str) -> Column:
        return F.struct(p["player"].alias("player_id"), inner.alias(name))

    def each(of) -> Column:
        return F.transform("all", of)

    none = F.lit(None).cast("string")
    if shape == "keys":
        pairs = each(lambda p: F.struct(p["player"].cast("string").alias("k"), amounts(p).alias("v")))
        doc, header = F.to_json(F.struct(F.map_from_entries(pairs).alias("achievements"))), none
    elif shape == "walk":
        found = F.to_json(each(lambda p: record(p, amounts(p, "_collected"), "economy")))
        raw = ',"raw":"{\\"player\\":7,\\"food\\":1,\\"wood\\":1}"}'
        doc, header = F.concat(F.lit('\n\t{"teams":[{"members":'), found, F.lit("}]" + raw)), none
    elif shape == "header":
        def player(p: Column) -> Column:
            economy = F.struct(amounts(p, "_collected").alias("economy"))
            return F.struct(p["player"].alias("number"), economy.alias("achievements"))

        doc, header = F.lit("{}"), F.to_json(each(player))
    elif shape == "slots":
        doc, header = F.to_json(F.struct(each(lambda p: amounts(p)).alias("teams"))), none
    elif shape == "nested":
        def deep(p: Column) -> Column:
            inner = amounts(p)
            for _ in range(4):
                inner = F.struct(inner.alias("economy"))
            long_id = F.struct((p["player"] + F.lit(LONG_ID)).alias("player"))
            return record(long_id, inner, "economy")

        doc, header = F.to_json(F.struct(each(deep).alias("players"))), none
    else:
        raise ValueError(f"shape must be one of {POSTGAME_SHAPES}: {shape!r}")
    return listed.select(MATCH, doc.alias("doc"), header.alias("header"))


def reread(spark: SparkSession, table: str, rows: DataFrame, fmt: str = "parquet") -> DataFrame:
    """A table written to files and read again with the file of each row."""
    path = fresh_path(spark, table)
    (stored.write_json if fmt == "json" else stored.write_table)(rows, path)
    return stored.read_table(spark, table, path, fmt, lineage=True)
