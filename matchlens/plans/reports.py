"""Reports over all tables of the matches."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.functions.barrier import evaluate_once
from matchlens.functions.costs import resource_name
from matchlens.functions.payload import (
    PARSED,
    is_production,
    item_count,
    may_match,
    payload_matches,
    with_parsed,
)
from matchlens.functions.timing import DEFAULT_WINDOW, MICROS, int_div, window_micros
from matchlens.functions.units import VILLAGER
from matchlens.operators import activity, postgame, production, resources, series, stock
from matchlens.operators.series import KEY, MATCH
from matchlens.sources.tables import MatchTables

RESOURCE_VIEWS = ("spend", "balance", "stock", "postgame")


def _summed_around_villagers(actions: DataFrame, window_s, pattern, mode: str) -> DataFrame:
    """(match_id, player, t_us, v, v_trained, seq): a row for each villager action, with its
    ``seq``, and one without for all other actions of a player in a window."""
    acting = actions.filter(F.col("player").isNotNull() & F.col(MATCH).isNotNull() & F.col("t_us").isNotNull())
    possible = is_production(F.col("type")) & may_match(acting, pattern)
    parsed = with_parsed(acting, when=possible)
    payload = F.col(PARSED)
    is_match = payload.isNotNull() & payload_matches(payload, pattern, mode)
    read = evaluate_once(parsed, _items=F.when(is_match, item_count(payload)))
    villager = F.col("_items").isNotNull()
    placed = read.select(
        *KEY,
        "t_us",
        int_div(F.col("t_us"), window_micros(window_s)).alias("_window"),
        F.when(villager, F.col("seq")).alias("_mark"),
        F.coalesce("_items", F.lit(0).cast("bigint")).alias("_items"),
    )
    found = placed.groupBy(*KEY, "_window", "_mark").agg(
        F.max("t_us").alias("t_us"),
        F.count(F.lit(1)).alias("v"),
        F.sum("_items").alias("v_trained"),
        F.max("_mark").alias("seq"),
    )
    # Holds for all rows. It reads all columns, so that what the gaps and the windows each leave
    # out is not taken from one of their exchanges, which then is shared.
    some = F.greatest("v", "t_us", "v_trained", F.coalesce("seq", F.lit(0).cast("bigint"))) > 0
    return found.filter(some).select(*KEY, "t_us", "v", "v_trained", "seq")


def player_summary(
    tables: MatchTables,
    window_s=DEFAULT_WINDOW,
    pattern=VILLAGER,
    mode: str = "strict",
    base_prod_time=production.BASE_PROD_TIME,
    gap_threshold=production.GAP_THRESHOLD,
) -> DataFrame:
    """One row per player: villagers, idle time, actions per minute.

    The log is read and its payloads are parsed once: villager actions are kept one by one, for
    the gaps between them, all others are summed by window, and both go through one exchange.
    Players without actions have NULL in actions per minute, and a match of no length has a NULL
    idle share.
    """
    rows = _summed_around_villagers(tables.actions, window_s, pattern, mode)
    sums = series.window_sums(rows.drop("seq"), window_s)
    apm = activity.stats_of_sums(sums, window_s, F.sum("v_trained").alias("villagers_trained"))

    gaps = production.gaps_in_order(rows.filter(F.col("seq").isNotNull()))
    idle = (
        production.idle_increments(gaps, base_prod_time, gap_threshold)
        .groupBy(*KEY)
        .agg(F.sum("v").alias("idle_us"))
    )
    zero = F.lit(0).cast("bigint")
    joined = (
        tables.players.join(tables.matches.select(MATCH, "duration_us"), MATCH, "left")
        .join(apm, KEY, "left")
        .join(idle, KEY, "left")
    )
    idle_s = F.coalesce(F.col("idle_us") / MICROS, F.lit(0.0))
    duration_s = F.col("duration_us") / MICROS
    return joined.select(
        *KEY,
        "name",
        F.col("civilization").alias("civ"),
        F.coalesce("villagers_trained", zero).alias("villagers_trained"),
        idle_s.alias("tc_idle_s"),
        F.when(F.col("duration_us") > 0, 100.0 * idle_s / duration_s).alias("tc_idle_pct"),
        "apm_mean",
        "apm_peak",
    )


def rounded(summary: DataFrame, places: int = 1) -> DataFrame:
    """Summary with its measures rounded for presentation."""
    measures = ("tc_idle_s", "tc_idle_pct", "apm_mean", "apm_peak")
    return summary.withColumns({m: F.round(m, places) for m in measures})


def match_summary(tables: MatchTables) -> DataFrame:
    """One nested record per match with its players, in order of player number.

    The record is one row by nature; its list has one short entry per player slot
    of the match. If ``matches`` was read with lineage, the file is part of it.
    """
    path = [F.col("source_file").alias("path")] if "source_file" in tables.matches.columns else []
    entry = F.struct("player", "name", "civilization", "winner", "eapm")
    listed = tables.players.groupBy(MATCH).agg(F.sort_array(F.collect_list(entry)).alias("_all"))

    def public(p):
        return F.struct(*[p[f].alias(f) for f in ("name", "civilization", "winner", "eapm")])

    none = F.array().cast("array<struct<name:string,civilization:int,winner:boolean,eapm:int>>")
    return tables.matches.join(listed, MATCH, "left").select(
        MATCH,
        *path,
        "version",
        F.coalesce(F.col("duration_us") / MICROS, F.lit(0.0)).alias("duration_s"),
        "map_id",
        "map_name",
        F.coalesce(F.transform("_all", public), none).alias("players"),
    )


def stock_total(tables: MatchTables, window_s=DEFAULT_WINDOW) -> DataFrame:
    """Total stock of each player: from snapshots, else estimated from actions.

    Matches with a stock are taken out of the actions before these are priced.
    """
    known = stock.sync_stock(tables.snapshots, window_s)
    covered = stock.matches_with_stock(tables.snapshots)
    open_ = tables.actions.join(covered, MATCH, "left_anti")
    estimated = resources.approx_total_balance(open_, window_s).withColumn(
        "value", F.col("value").cast("double")
    )
    return known.unionByName(estimated)


def resource_view(
    tables: MatchTables,
    view: str,
    resource: str = "food",
    window_s=DEFAULT_WINDOW,
    start_at=0,
) -> DataFrame:
    """One of the resource views, all in the same form.

    A balance that would start at 0 starts at the usual stock of its resource.
    The stock view is over all resources, whatever ``resource`` says.
    """
    name = resource_name(resource)
    if view == "spend":
        return resources.resource_spend_timeseries(tables.actions, name, window_s)
    if view == "balance":
        start = start_at or resources.START_STOCK[name]
        return resources.resource_balance_timeseries(tables.actions, name, window_s, start)
    if view == "stock":
        return stock.sync_stock(tables.snapshots, window_s)
    if view == "postgame":
        totals = postgame.postgame_totals(tables.postgame)
        return postgame.resource_ramp(tables.players, tables.matches, totals, name, window_s)
    raise ValueError(f"view must be one of {RESOURCE_VIEWS}: {view!r}")
