"""Match tables derived from a generic ``events`` table (users, timestamps, types).

Eight consecutive users make a match; 30 days of events become one hour. The
``k`` of ``props`` (0 to 99) stands in for what a player chose.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens import schema
from matchlens.functions.barrier import evaluate_once
from matchlens.functions.constants import sql_literal
from matchlens.functions.timing import int_div, interval_micros

# Fixed values of the mapping.
UNITS = (
    ["Villager"] * 5
    + ["Aldeano", "Archer", "Heavy Cavalry Archer", "Elite Skirmisher", "Skirmisher"]
    + ["Militia", "Man-at-Arms", "Long Swordsman", "Spearman", "Scout Cavalry"]
    + ["Knight", "Paladin", "Camel Rider", "Eagle Scout", "Monk"]
)
BUILDINGS = [
    "House",
    "House",
    "Castle",
    "Town Center",
    "Farm",
    "Lumber Camp",
    "Watch Tower",
    "Barracks",
]
TECHS = [
    "Feudal Age",
    "Castle Age",
    "Imperial Age",
    "Loom",
    "Wheelbarrow",
    "Hand Cart",
    "Bracer",
    "Elite Skirmisher",
    "Ballistics",
    "Town Watch",
]
MARKET = ["food", "wood", "gold", "stone"]
NO_PLAYER_K = 99
TIME_FACTOR = 720
PLAYERS_PER_MATCH = 8


def _pick(values: list[str], index: str) -> str:
    """SQL for the entry of a constant list at ``index``, counted round."""
    entries = ", ".join(map(sql_literal, values))
    return f"get(array({entries}), CAST(({index}) % {len(values)} AS INT))"


def _keyed(events: DataFrame) -> DataFrame:
    since_start = F.col("ts").cast("timestamp_ntz") - F.lit("2024-01-01 00:00:00").cast(
        "timestamp_ntz"
    )
    keyed = evaluate_once(
        events, k=F.get_json_object("props", "$.k").cast("int"), _since=since_start
    )
    return keyed.select(
        int_div(F.col("user_id"), PLAYERS_PER_MATCH).alias("match_id"),
        F.when(F.col("k") != NO_PLAYER_K, (F.col("user_id") % PLAYERS_PER_MATCH + 1).cast("int"))
        .alias("player"),
        F.col("event_id").alias("seq"),
        int_div(interval_micros(F.col("_since")), TIME_FACTOR).alias("t_us"),
        "event_type",
        "value",
        "k",
    )


_ACTION_TYPE = """
CASE event_type
  WHEN 'click' THEN 'DE_QUEUE'
  WHEN 'view' THEN IF(k % 4 = 0, 'MULTIQUEUE', 'ORDER')
  WHEN 'signup' THEN 'BUILD'
  WHEN 'purchase' THEN 'RESEARCH'
  WHEN 'error' THEN IF(k % 2 = 0, 'BUY', 'SELL')
END"""

_UNIT, _COUNT = _pick(UNITS, "k"), "1 + k % 5"

_PAYLOAD = f"""
CASE
  WHEN event_type IN ('click', 'view') THEN CASE seq % 4
    WHEN 0 THEN concat('{{"unit":"', {_UNIT}, '","amount":', {_COUNT}, '}}')
    WHEN 1 THEN concat('{{"unit_name":"', {_UNIT}, '","count":', {_COUNT}, '}}')
    WHEN 2 THEN concat('{{"object_name":"', {_UNIT}, '","quantity":', {_COUNT}, '}}')
    ELSE concat('{{"unit":{{"name":"', {_UNIT}, '"}},"n":', {_COUNT}, '}}') END
  WHEN event_type = 'signup' THEN concat('{{"building":"', {_pick(BUILDINGS, "k")}, '"}}')
  WHEN event_type = 'purchase' THEN concat('{{"technology":"', {_pick(TECHS, "k")}, '"}}')
  WHEN event_type = 'error'
    THEN concat('{{"resource":"', {_pick(MARKET, "k div 2")}, '","amount":100}}')
END"""


def _postgame(keyed: DataFrame) -> DataFrame:
    def collected(kind: str, name: str) -> Column:
        return (F.count_if(F.col("event_type") == kind) * 100).alias(name)

    per_player = (
        keyed.filter(F.col("player").isNotNull())
        .groupBy("match_id", "player")
        .agg(
            collected("click", "food"),
            collected("view", "wood"),
            collected("purchase", "gold"),
            collected("error", "stone"),
        )
    )
    record = F.struct(
        F.col("player").alias("player_id"),
        F.struct("food", "wood", "gold", "stone").alias("total_collected"),
    )
    # At most PLAYERS_PER_MATCH records by construction.
    records = F.sort_array(F.collect_list(record)).alias("players")
    documents = per_player.groupBy("match_id").agg(records)
    return documents.select(
        "match_id",
        F.to_json(F.struct("players")).alias("doc"),
        F.lit(None).cast("string").alias("header"),
    )


def _missing(table, *names) -> list[Column]:
    return [F.lit(None).cast(table[n].dataType).alias(n) for n in names]


class EventTables:
    """The tables of ``MatchTables``, each planned when it is first used."""

    def __init__(self, spark: SparkSession, events_path: str):
        self._keyed = _keyed(spark.read.parquet(events_path))

    @cached_property
    def actions(self) -> DataFrame:
        return self._keyed.selectExpr(
            "match_id",
            "player",
            "seq",
            "t_us",
            f"{_ACTION_TYPE} AS type",
            f"{_PAYLOAD} AS payload",
        )

    @cached_property
    def matches(self) -> DataFrame:
        ends = self._keyed.groupBy("match_id").agg(F.max("t_us").alias("duration_us"))
        return ends.select("*", *_missing(schema.MATCHES, "map_id", "map_name", "version"))

    @cached_property
    def players(self) -> DataFrame:
        numbers = F.explode(F.sequence(F.lit(1), F.lit(PLAYERS_PER_MATCH))).alias("player")
        return (
            self._keyed.select("match_id")
            .distinct()
            .select("match_id", numbers)
            .select(
                "*",
                F.concat(F.lit("P"), "match_id", F.lit("_"), "player").alias("name"),
                *_missing(schema.PLAYERS, "civilization", "winner", "eapm"),
            )
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        known = (F.col("event_type") == "view") & (F.col("match_id") % 2 == 0)
        return self._keyed.filter(known).select(
            "match_id", "player", "seq", "t_us", F.col("value").alias("total_res")
        )

    @cached_property
    def postgame(self) -> DataFrame:
        return _postgame(self._keyed)


def tables_from_events(spark: SparkSession, events_path: str) -> EventTables:
    return EventTables(spark, events_path)
