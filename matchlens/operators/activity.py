"""Actions per minute."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from matchlens.functions.timing import DEFAULT_WINDOW
from matchlens.operators import series
from matchlens.operators.series import KEY


def _rate(count: Column, window_s) -> Column:
    return count * 60 / F.lit(window_s)


def action_sums(
    actions: DataFrame,
    window_s,
    names: DataFrame | None = None,
    missing: Observation | None = None,
) -> DataFrame:
    rows = actions.filter(F.col("player").isNotNull())
    rows = rows.select(*KEY, "t_us", F.lit(1).cast("bigint").alias("v"))
    return series.window_sums(rows, window_s, names, missing)


def apm_timeseries(
    actions: DataFrame,
    window_s=DEFAULT_WINDOW,
    players=None,
    if_none: str = "empty",
    names: DataFrame | None = None,
    missing: Observation | None = None,
) -> DataFrame:
    """Actions per minute of each player in each window.

    ``names``, a table of players, adds the column ``name``; ``missing`` then counts players of the
    log that it does not name, see ``series.window_sums``.
    """
    sums = action_sums(actions, window_s, names, missing)
    sums = series.select_players(sums, players, if_none)
    return series.as_series(series.per_window(sums), window_s, _rate(F.col("v"), window_s))


def apm_stats(actions: DataFrame, window_s=DEFAULT_WINDOW) -> DataFrame:
    """Mean, sample deviation and peak over all windows, empty ones included."""
    return stats_of_sums(action_sums(actions, window_s), window_s)


def stats_of_sums(sums: DataFrame, window_s, *extra: Column) -> DataFrame:
    """The statistics need the non-empty windows and their number only.

    Sums of whole counts are exact, so results do not depend on the order of
    addition; squares are decimals because a single hot window can hold more
    than 2^32 actions.
    """
    exact = F.col("v").cast("decimal(18,0)")
    totals = sums.groupBy(*KEY, "n").agg(
        F.sum("v").alias("s1"),
        F.sum(exact * exact).alias("s2"),
        F.max("v").alias("peak"),
        *extra,
    )
    n, s1 = F.col("n"), F.col("s1").cast("decimal(38,0)")
    spread = (n.cast("decimal(38,0)") * F.col("s2") - s1 * s1).cast("double")
    sd = F.sqrt(spread / (n * (n - 1)).cast("double")) * (60 / window_s)
    return totals.select(
        *KEY,
        (F.col("s1") * 60 / (n * F.lit(window_s))).alias("apm_mean"),
        F.when(n > 1, sd).alias("apm_sd"),
        _rate(F.col("peak"), window_s).alias("apm_peak"),
        *[c for c in totals.columns if c not in (*KEY, "n", "s1", "s2", "peak")],
    )
