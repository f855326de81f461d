"""Units created and production idle time."""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions.payload import matching_actions
from matchlens.functions.timing import DEFAULT_WINDOW, MICROS, int_div, to_micros
from matchlens.functions.units import VILLAGER, unit_pattern
from matchlens.operators import series
from matchlens.operators.series import KEY

# Seconds: time to train one villager, and the longest pause not counted as idle.
BASE_PROD_TIME = 25.0
GAP_THRESHOLD = 27.0

# Actions of one player that one window group may hold; see ``gaps_in_order``.
CHUNK = 1 << 20
LEVELS = 2


def villager_counts(
    actions: DataFrame,
    players: DataFrame,
    pattern: str | re.Pattern = VILLAGER,
    mode: str = "loose",
) -> DataFrame:
    """Villagers queued by every player of a match, 0 for none."""
    counts = (
        matching_actions(actions, pattern, mode)
        .groupBy(*KEY)
        .agg(F.sum("items").alias("villagers"))
    )
    return (
        players.select(*KEY)
        .join(counts, KEY, "left")
        .select(*KEY, F.coalesce("villagers", F.lit(0).cast("bigint")).alias("villagers"))
    )


def units_created_timeseries(
    actions: DataFrame,
    unit: str = "Villager",
    window_s=DEFAULT_WINDOW,
    *,
    pattern: str | re.Pattern | None = None,
    patterns: dict | None = None,
    mode: str = "loose",
    players=None,
    if_none: str = "empty",
) -> DataFrame:
    """Units of one line queued in each window; ``pattern`` overrides ``unit``."""
    wanted = unit_pattern(unit, patterns) if pattern is None else pattern
    rows = matching_actions(actions, wanted, mode).select(*KEY, "t_us", F.col("items").alias("v"))
    sums = series.select_players(series.window_sums(rows, window_s), players, if_none)
    return series.as_series(series.per_window(sums), window_s)


def _with_previous(rows: DataFrame, order: str, last: str, chunk: int, levels: int) -> DataFrame:
    """Add ``_previous``: ``last`` of the player's row before, in the order of the numbers ``order``.

    A window over a whole player would put all of a hot player's rows into one
    task. ``order`` is unique for a player, so ranges of ``chunk`` numbers are groups of
    bounded size: inside them a plain lag does. Their first rows get it from the rows of ranges,
    in the same way a level up. Both halves of a level read the same exchange.
    """
    if levels == 0:
        before = F.lag(last).over(Window.partitionBy(*KEY).orderBy(order))
        return rows.withColumn("_previous", before)
    others = [c for c in rows.columns if c not in KEY]
    ranged = rows.withColumn("_chunk", int_div(F.col(order), chunk))
    parts = ranged.repartition(*KEY, "_chunk")
    in_range = Window.partitionBy(*KEY, "_chunk").orderBy(order)
    placed = parts.select(
        *KEY, *others, F.lag(last).over(in_range).alias("_previous"), F.lag(order).over(in_range).alias("_before")
    )
    inside = placed.filter(F.col("_before").isNotNull()).drop("_before")
    ranges = parts.groupBy(*KEY, "_chunk").agg(
        F.min_by(F.struct(*others), order).alias("_first"), F.max_by(last, order).alias("_end")
    )
    ranges = ranges.withColumnRenamed("_chunk", f"_chunk{levels}")
    above = _with_previous(ranges, f"_chunk{levels}", "_end", chunk, levels - 1)
    firsts = above.select(*KEY, "_first.*", "_previous")
    return inside.unionByName(firsts)


def gaps_in_order(rows: DataFrame, chunk: int = CHUNK, levels: int = LEVELS) -> DataFrame:
    """Add ``gap_us``: time since the player's previous row in ``seq`` order, which is unique within
    a match. No window group holds more than ``chunk`` rows while ``seq`` stays below ``chunk`` to
    the power of ``levels`` + 1."""
    rows = rows.select(*KEY, "seq", "t_us")
    found = _with_previous(rows, "seq", "t_us", chunk, levels)
    return found.select(*KEY, "seq", "t_us", (F.col("t_us") - F.col("_previous")).alias("gap_us"))


def villager_gaps(
    actions: DataFrame,
    pattern: str | re.Pattern = VILLAGER,
    mode: str = "loose",
    chunk: int = CHUNK,
) -> DataFrame:
    """Villager actions with the time since the player's previous one, if any."""
    return gaps_in_order(matching_actions(actions, pattern, mode), chunk)


def idle_increments(
    gaps: DataFrame, base_prod_time=BASE_PROD_TIME, gap_threshold=GAP_THRESHOLD
) -> DataFrame:
    """Idle time ``v`` (microseconds) that each long gap adds."""
    idle: Column = F.col("gap_us") - to_micros(base_prod_time)
    return gaps.filter(F.col("gap_us") > to_micros(gap_threshold)).select(
        *KEY, "t_us", F.greatest(F.lit(0).cast("bigint"), idle).alias("v")
    )


def tc_idle_time(
    actions: DataFrame,
    players: DataFrame,
    pattern: str | re.Pattern = VILLAGER,
    base_prod_time=BASE_PROD_TIME,
    gap_threshold=GAP_THRESHOLD,
    mode: str = "loose",
    chunk: int = CHUNK,
) -> DataFrame:
    """Idle seconds of villager production of every player, 0.0 for none."""
    gaps = villager_gaps(actions, pattern, mode, chunk)
    idle = (
        idle_increments(gaps, base_prod_time, gap_threshold)
        .groupBy(*KEY)
        .agg(F.sum("v").alias("idle_us"))
    )
    return (
        players.select(*KEY)
        .join(idle, KEY, "left")
        .select(*KEY, F.coalesce(F.col("idle_us") / MICROS, F.lit(0.0)).alias("idle_s"))
    )


def tc_idle_cumulative(
    actions: DataFrame,
    window_s=DEFAULT_WINDOW,
    pattern: str | re.Pattern = VILLAGER,
    base_prod_time=BASE_PROD_TIME,
    gap_threshold=GAP_THRESHOLD,
    mode: str = "loose",
    chunk: int = CHUNK,
) -> DataFrame:
    """Idle seconds up to the start of each window, for players who were idle."""
    gaps = villager_gaps(actions, pattern, mode, chunk)
    rows = idle_increments(gaps, base_prod_time, gap_threshold)
    return series.as_series(
        series.total_at_start(rows, window_s), window_s, F.col("v") / MICROS
    )
