"""Resource stock from sync snapshots."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.functions.timing import DEFAULT_WINDOW
from matchlens.operators import series
from matchlens.operators.series import KEY, MATCH


def sync_stock(snapshots: DataFrame, window_s=DEFAULT_WINDOW) -> DataFrame:
    """Total stock known at the start of each window."""
    value = F.coalesce(F.col("total_res").cast("double"), F.lit(0.0))
    rows = snapshots.select(*KEY, "seq", "t_us", value.alias("v"))
    return series.as_series(series.last_at_start(rows, window_s), window_s)


def matches_with_stock(snapshots: DataFrame) -> DataFrame:
    """Matches for which ``sync_stock`` has any row, without building it."""
    return (
        snapshots.groupBy(MATCH)
        .agg(F.max("t_us").alias("_end"), F.max("player").alias("_player"))
        .filter((F.col("_end") > 0) & F.col("_player").isNotNull())
        .select(MATCH)
    )
