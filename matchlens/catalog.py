"""The named queries: each reads an ``events`` file and returns a DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.functions.costs import RESOURCES
from matchlens.operators import (
    activity,
    diagnostics,
    events,
    patterns,
    postgame,
    production,
    resources,
    series,
    stock,
)
from matchlens.functions.units import augment_unit_patterns, is_villager
from matchlens.plans import reports, variants
from matchlens.sources.events import tables_from_events
from matchlens.sources.rejects import read_rejecting
from matchlens.sources.tables import MatchTables, explode_snapshots, record_json

Query = Callable[[SparkSession, str], DataFrame]

SELECTED_PLAYERS = (1, 3, 5)
OWN_PATTERNS = {"Villager": "villager", "Gatherer": "villager|aldean"}


def _match_summary(t: MatchTables) -> DataFrame:
    return reports.match_summary(t).select(
        "match_id",
        "duration_s",
        F.size("players").alias("n_players"),
        record_json(F.col("players")).alias("players_json"),
    )


def _player_summary(t: MatchTables) -> DataFrame:
    return reports.player_summary(t).drop("civ")


def _reread(t: MatchTables, table: str, fmt: str) -> DataFrame:
    rows = getattr(t, table)
    again = variants.reread(rows.sparkSession, table, rows, fmt)
    return again.withColumn("source_file", F.col("source_file").isNotNull())


def _rejects(t: MatchTables) -> DataFrame:
    folder = variants.damaged_lines(t.actions)
    rejects = read_rejecting(t.actions.sparkSession, "actions", folder, "json").rejects
    return rejects.withColumn("source_file", F.col("source_file").isNotNull())


def _postgame(shape: str):
    return lambda t: postgame.postgame_totals(variants.reshaped(t.postgame, shape))


BY_NAME: dict[str, Callable[[MatchTables], DataFrame]] = {
    # logs
    "prod_events": lambda t: diagnostics.prod_events(t.actions),
    "unit_names": lambda t: diagnostics.unit_names(t.actions),
    "unit_pattern_hits": lambda t: diagnostics.unit_pattern_hits(t.actions),
    "unit_string_hits": lambda t: diagnostics.unit_string_hits(t.actions),
    "action_type_counts": lambda t: diagnostics.action_type_counts(t.actions),
    "action_samples": lambda t: diagnostics.action_samples(t.actions).drop("payload"),
    # actions per minute
    "apm_timeseries": lambda t: activity.apm_timeseries(t.actions),
    "apm_timeseries_15s": lambda t: activity.apm_timeseries(t.actions, 15),
    "apm_named": lambda t: activity.apm_timeseries(t.actions, names=t.players),
    "apm_stats": lambda t: activity.apm_stats(t.actions),
    # production
    "villager_counts": lambda t: production.villager_counts(t.actions, t.players),
    "villager_counts_strict": lambda t: production.villager_counts(
        t.actions, t.players, mode="strict"
    ),
    "units_created_timeseries": lambda t: production.units_created_timeseries(t.actions),
    "units_created_selected": lambda t: production.units_created_timeseries(
        t.actions, "Scout", 120, players=SELECTED_PLAYERS
    ),
    "villager_gaps": lambda t: production.villager_gaps(t.actions),
    "tc_idle_time": lambda t: production.tc_idle_time(t.actions, t.players),
    "tc_idle_cumulative": lambda t: production.tc_idle_cumulative(t.actions),
    # resources
    "cost_lookup": lambda t: resources.cost_lookup(t.actions),
    "resource_deltas": lambda t: resources.resource_deltas(t.actions),
    **{
        f"resource_spend_{r}": lambda t, r=r: resources.resource_spend_timeseries(t.actions, r)
        for r in RESOURCES
    },
    **{
        f"resource_balance_{r}": lambda t, r=r: resources.resource_balance_timeseries(t.actions, r)
        for r in RESOURCES
    },
    "total_spend_cumulative": lambda t: resources.total_spend_timeseries(t.actions),
    "total_spend_per_window": lambda t: resources.total_spend_timeseries(
        t.actions, cumulative=False
    ),
    "approx_total_balance": lambda t: resources.approx_total_balance(t.actions),
    "resource_has_data": lambda t: resources.spend_has_data(t.actions, t.matches),
    # milestones
    "important_events": lambda t: events.important_events(t.actions),
    "events_tc_age": lambda t: events.important_events(t.actions, kinds=("tc", "age")),
    # stock and post-game
    "sync_stock": lambda t: stock.sync_stock(t.snapshots),
    "stock_total": lambda t: reports.stock_total(t),
    "postgame_totals": lambda t: postgame.postgame_totals(t.postgame),
    **{f"postgame_totals_{shape}": _postgame(shape) for shape in variants.POSTGAME_SHAPES},
    "resource_ramp": lambda t: reports.resource_view(t, "postgame", "food"),
    **{
        f"resource_ramp_{r}": lambda t, r=r: reports.resource_view(t, "postgame", r)
        for r in RESOURCES[1:]
    },
    "sync_packets": lambda t: explode_snapshots(variants.sync_packets(t.snapshots)),
    # other forms of the input
    "villager_counts_noted": lambda t: production.villager_counts(
        variants.noted(t.actions), t.players
    ),
    "villager_counts_noted_strict": lambda t: production.villager_counts(
        variants.noted(t.actions), t.players, mode="strict"
    ),
    "villager_counts_repeated_keys": lambda t: production.villager_counts(
        variants.repeated_keys(t.actions), t.players
    ),
    "apm_selected_or_all": lambda t: activity.apm_timeseries(
        variants.without_player(t.actions, 1), players=(1,), if_none="all"
    ),
    "actions_rejected": lambda t: _rejects(t),
    "actions_reread": lambda t: _reread(t, "actions", "parquet"),
    "matches_reread_json": lambda t: _reread(t, "matches", "json"),
    # presentation
    "events_in_time_order": lambda t: events.in_time_order(events.important_events(t.actions)),
    "action_types_by_frequency": lambda t: diagnostics.by_frequency(
        diagnostics.action_type_counts(t.actions)
    ),
    "unit_pattern_hits_own": lambda t: diagnostics.unit_pattern_hits(
        t.actions, augment_unit_patterns(OWN_PATTERNS)
    ),
    "villager_names": lambda t: diagnostics.unit_names(t.actions).withColumn(
        "is_villager", is_villager(F.col("name"))
    ),
    "apm_minutes": lambda t: series.with_minutes(activity.apm_timeseries(t.actions)),
    "spend_has_data_food": lambda t: series.has_data(
        resources.resource_spend_timeseries(t.actions, "food")
    ),
    # summaries
    "player_summary": _player_summary,
    "player_summary_rounded": lambda t: reports.rounded(_player_summary(t)),
    "match_summary": _match_summary,
}


def _query(build: Callable[[MatchTables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(tables_from_events(spark, f"{sf_dir}/events.parquet"))

    return run


#: Queries that read another table as well, given as the second argument.
WITH_PARTS: dict[str, Callable[[MatchTables, DataFrame], DataFrame]] = {
    "cost_lookup_own": lambda t, part: resources.cost_lookup(t.actions, variants.own_costs(part)),
    "resource_deltas_own": lambda t, part: resources.resource_deltas(
        t.actions, variants.own_costs(part)
    ),
    "unit_pattern_hits_table": lambda t, part: diagnostics.unit_pattern_hits(
        t.actions, patterns.augmented(variants.own_patterns(part))
    ),
}


def _query_with_parts(build: Callable[[MatchTables, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = spark.read.parquet(f"{sf_dir}/part.parquet")
        return build(tables_from_events(spark, f"{sf_dir}/events.parquet"), part)

    return run


def all_queries() -> dict[str, Query]:
    return {name: _query(build) for name, build in BY_NAME.items()} | {
        name: _query_with_parts(build) for name, build in WITH_PARTS.items()
    }
