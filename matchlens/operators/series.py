"""Dense per-player series over fixed windows.

Every series starts with a hash aggregate on (match, player, window), which
Spark combines on the map side: from there on the data holds at most one row per
player and window however many actions a match has.

Windows are then dealt over blocks of ``BLOCK``, so that no task holds more of one
player however long a match lasts. What a block needs from outside (the number of windows of
the match, the total before it, the filled windows next to it) comes from one row per player
and block; only these rows, a few thousandth of the windows, are gathered by match.

A series runs over ``n = ceil(max_t / window)`` windows, where ``max_t`` is the
last moment among the rows given for the match, whoever caused it. Rows at
exactly ``max_t`` belong to the last window even if they lie on its end.
"""

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from matchlens.functions.barrier import evaluate_once
from matchlens.functions.timing import ceil_div, int_div, window_micros, window_start

MATCH = "match_id"
KEY = ["match_id", "player"]

# Windows generated per array when filling a gap, so that no row ever holds an
# array that grows with the length of its match.
FILL_BLOCK = 4096

# Windows of one player that are looked at together.
BLOCK = 4096
PLACE = ["match_id", "player", "block"]


def _in_block():
    return Window.partitionBy(*PLACE).orderBy("bucket")


def explode_windows(df: DataFrame, lo: Column, hi: Column, block: int = FILL_BLOCK) -> DataFrame:
    """Add ``bin``: one row per whole number from lo to hi, none if lo > hi."""
    none = F.array().cast("array<bigint>")
    starts = F.when(lo <= hi, F.sequence(lo, hi, F.lit(block).cast("bigint"))).otherwise(none)
    blocks = df.select("*", hi.alias("_hi"), F.explode(starts).alias("_lo"))
    last = F.least(F.col("_lo") + (block - 1), F.col("_hi"))
    return blocks.select("*", F.explode(F.sequence("_lo", last)).alias("bin")).drop("_lo", "_hi")


def _sparse(rows: DataFrame, bucket: Column, *values: Column) -> DataFrame:
    """Non-empty windows with the last moment in each.

    It is read by both sides of the join with ``_blocks``. Filters and columns that Catalyst would
    add to one side or take from it are settled here, so that both read one exchange.
    """
    known = rows.filter(F.col(MATCH).isNotNull() & F.col("t_us").isNotNull())
    placed = known.withColumn("bucket", F.coalesce(bucket, _zero()))
    placed = placed.withColumn("block", F.coalesce(int_div(F.col("bucket"), BLOCK), _zero()))
    return placed.groupBy(*PLACE, "bucket").agg(F.max("t_us").alias("t_us"), *values)


def _in_scope(sparse: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    joined = sparse.join(blocks, PLACE)
    return joined.filter(F.col("t_us") <= F.col("n") * width)  # holds for all, and reads t_us


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _named(blocks: DataFrame, players: DataFrame, missing: Observation | None) -> DataFrame:
    """Add ``name`` to the rows of blocks; ``missing`` counts the players without one."""
    named = blocks.join(players.select(*KEY, "name"), KEY, "left")
    if missing is None:
        return named
    unnamed = F.count_if(F.col("name").isNull() & F.col("_prev").isNull())
    return named.observe(missing, unnamed.alias("unnamed"))


def _blocks(sparse: DataFrame, width: int, sums: list[str], clamp: bool) -> DataFrame:
    """What each block of a player needs from outside: ``n``, the filled windows next to it,
    ``_before`` (the sum of ``v`` up to it) and ``_late``, what its last window gets from the end
    of the match. Blocks that are not to be emitted are left out."""
    of_player = Window.partitionBy(*KEY).orderBy("block")
    found = sparse.groupBy(*PLACE).agg(
        F.max("t_us").alias("t_us"),
        F.min("bucket").alias("_first"),
        F.max("bucket").alias("_last"),
        *[F.sum(c).alias(f"_{c}") for c in sums],
    )
    n = ceil_div(F.max("t_us").over(Window.partitionBy(MATCH)), width)
    found = found.withColumn("n", n).filter(F.col("player").isNotNull() & (F.col("n") > 0))
    if clamp:
        # The end of a match may open a block of its own. It joins the window before, if filled.
        end = F.col("n") - 1
        joins = (F.col("_first") > end) & (F.lag("_last").over(of_player) == end)
        found = found.withColumn("_joins", F.coalesce(joins, F.lit(False)))
        given = F.when(F.col("_joins"), F.struct(*[F.col(f"_{c}").alias(c) for c in sums]))
        found = found.withColumn("_late", F.lead(given).over(of_player)).filter(~F.col("_joins"))
        late = [F.coalesce(F.col("_late")[c], _zero()) for c in sums]
        found = found.withColumns({f"_{c}": F.col(f"_{c}") + x for c, x in zip(sums, late, strict=True)})
        found = found.withColumns({c: F.least(c, end) for c in ("_first", "_last")})
    before = F.sum("_v").over(of_player) - F.col("_v") if "v" in sums else _zero()
    return found.select(
        *PLACE,
        "n",
        F.lag("_last").over(of_player).alias("_prev"),
        F.lead("_first").over(of_player).alias("_next"),
        before.alias("_before"),
        *(["_late"] if clamp else []),
    )


def select_players(df: DataFrame, players, if_none: str = "empty") -> DataFrame:
    """Keep chosen players; an empty choice keeps all.

    A match with none of the chosen players gives no rows, or with
    ``if_none='all'`` all of its players. Windows are those of the whole match.
    """
    if if_none not in ("empty", "all"):
        raise ValueError(f"if_none must be 'empty' or 'all': {if_none!r}")
    if not players:
        return df
    chosen = F.col("player").isin(*players)
    if if_none == "empty":
        # Not pushed down: the other side of the join with ``_blocks`` needs all players.
        return evaluate_once(df, _any=chosen).filter("_any").drop("_any")
    any_chosen = F.max(chosen).over(Window.partitionBy(MATCH))
    return df.withColumn("_any", any_chosen).filter(chosen | ~F.col("_any")).drop("_any")


def window_sums(
    rows: DataFrame,
    window_s,
    players: DataFrame | None = None,
    missing: Observation | None = None,
) -> DataFrame:
    """Non-empty windows: ``match_id, player, n, bucket`` and the sum ``v`` of ``rows.v``.

    ``rows`` has match_id, player, t_us and v; other columns starting with ``v``
    are summed alike. With ``players``, rows also bear the ``name`` of their player, NULL where
    there is none; how many players that is shows in ``missing`` once the series has run. Names
    are joined to one row per player and block, before anything is filled.
    """
    width = window_micros(window_s)
    sums = [c for c in rows.columns if c.startswith("v")]
    each = [F.sum(c).alias(c) for c in sums]
    sparse = _sparse(rows, int_div(F.col("t_us"), width), *each)
    blocks = _blocks(sparse, width, sums, clamp=True)
    if players is not None:
        blocks = _named(blocks, players, missing)
    known = _in_scope(sparse, blocks, width)
    end = F.col("n") - 1
    late = F.when(F.col("bucket") == end, F.col("_late"))
    return (
        known.withColumns({c: F.col(c) + F.coalesce(late[c], _zero()) for c in sums})
        .withColumn("bucket", F.least("bucket", end))
        .groupBy(*PLACE, "n", "_prev", "_next", "_before", *_carried(known), "bucket")
        .agg(*each)
    )


def _carried(df: DataFrame) -> list[str]:
    """Columns that go with a player through a series."""
    return ["name"] if "name" in df.columns else []


def _spread(df: DataFrame, before: Column, at: Column, after: Column) -> DataFrame:
    """Fill all windows: ``before`` ahead of a player's first row, then per row
    ``at`` in its own window and ``after`` up to the next one."""
    order = _in_block()
    nodes = df.select(
        *KEY,
        *_carried(df),
        "n",
        "bucket",
        F.coalesce(F.lag("bucket").over(order), "_prev").alias("_left"),
        F.coalesce(F.lead("bucket").over(order), "_next").alias("_right"),
        before.alias("_ahead"),
        at.alias("_at"),
        after.alias("_after"),
    )
    lo = F.when(F.col("_left").isNull(), _zero()).otherwise(F.col("bucket"))
    hi = F.coalesce("_right", "n") - 1
    value = (
        F.when(F.col("bin") < F.col("bucket"), F.col("_ahead"))
        .when(F.col("bin") == F.col("bucket"), F.col("_at"))
        .otherwise(F.col("_after"))
    )
    return explode_windows(nodes, lo, hi).select(*KEY, *_carried(df), "bin", value.alias("v"))


def _running(df: DataFrame, start: Column) -> DataFrame:
    inside = F.sum("v").over(_in_block().rowsBetween(Window.unboundedPreceding, 0))
    total = inside + F.col("_before") + start
    return _spread(df, start, total, total)


def per_window(sums: DataFrame) -> DataFrame:
    """Sum of each window, 0 where nothing happened."""
    zero = F.lit(0).cast(sums.schema["v"].dataType)
    return _spread(sums, zero, F.col("v"), zero)


def running_total(sums: DataFrame, start=0) -> DataFrame:
    """Sum of each window and all before it, plus ``start``."""
    return _running(sums, F.lit(start).cast(sums.schema["v"].dataType))


def total_at_start(rows: DataFrame, window_s) -> DataFrame:
    """Sum of ``v`` over all rows up to the *start* of each window.

    A row counts from the first window that starts at or after it, so what
    happens inside the last window never shows.
    """
    width = window_micros(window_s)
    sparse = _sparse(rows, ceil_div(F.col("t_us"), width), F.sum("v").alias("v"))
    known = _in_scope(sparse, _blocks(sparse, width, ["v"], clamp=False), width)
    return _running(known, _zero())


def last_at_start(rows: DataFrame, window_s) -> DataFrame:
    """Last ``v`` seen up to the start of each window.

    Windows before a player's first value take the first value that any window
    edge, the closing one included, would show.
    """
    width = window_micros(window_s)
    last = F.max_by("v", F.struct("t_us", "seq")).alias("v")
    sparse = _sparse(rows, ceil_div(F.col("t_us"), width), last)
    known = _in_scope(sparse, _blocks(sparse, width, [], clamp=False), width)
    return _spread(known, F.col("v"), F.col("v"), F.col("v"))


def as_series(filled: DataFrame, window_s, value: Column | None = None) -> DataFrame:
    """Output form ``match_id, time_sec, player, value``."""
    return filled.select(
        MATCH,
        window_start(F.col("bin"), window_s).alias("time_sec"),
        "player",
        (F.col("v") if value is None else value).alias("value"),
        *_carried(filled),
    )


def with_names(series: DataFrame, players: DataFrame) -> DataFrame:
    """Add player names to any series, NULL for players without one. Spark broadcasts ``players``
    only where its size allows; ``window_sums`` adds names before windows are filled."""
    return series.join(players.select(*KEY, "name"), KEY, "left")


def with_minutes(series: DataFrame) -> DataFrame:
    return series.withColumn("time_min", F.col("time_sec") / 60)


def to_wide(series: DataFrame, players) -> DataFrame:
    """One column per given player number, for presentation."""
    return series.groupBy(MATCH, "time_sec").pivot("player", list(players)).agg(F.first("value"))


def has_data(series: DataFrame) -> DataFrame:
    """Whether the values of a series add up to anything but 0, per match."""
    return series.groupBy(MATCH).agg((F.sum("value") != 0).alias("has_data"))
