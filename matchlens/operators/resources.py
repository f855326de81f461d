"""Estimated resource spend, balance and stock, from the costs of actions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions import costs as C
from matchlens.functions.barrier import evaluate_once
from matchlens.functions.costs import RESOURCES, resource_name
from matchlens.functions.payload import PARSED, text, truthy_text, with_parsed
from matchlens.functions.timing import DEFAULT_WINDOW
from matchlens.operators import prices, series
from matchlens.operators.containment import kept
from matchlens.operators.series import KEY, MATCH

# Action types that cost a unit, and stocks at the start of a match.
COSTED_PRODUCTION = ("DE_QUEUE", "QUEUE", "ORDER", "TRAIN", "CREATE")
START_STOCK = {"food": 200, "wood": 200, "gold": 100, "stone": 200}


def _any_of(*keys: str) -> Column:
    return F.coalesce(*[truthy_text(F.col(PARSED), f"$.{key}") for key in keys])


def priced_kind(type_: Column) -> Column:
    """Which cost table applies to an action type, or NULL."""
    return (
        F.when(type_.isin(*COSTED_PRODUCTION), "unit")
        .when(type_ == "BUILD", "building")
        .when(type_ == "RESEARCH", "tech")
    )


def priced_name(type_: Column) -> Column:
    return (
        F.when(type_.isin(*COSTED_PRODUCTION), _any_of("unit", "unit_name", "object_name"))
        .when(type_ == "BUILD", _any_of("building", "building_name"))
        .when(type_ == "RESEARCH", _any_of("technology", "tech"))
    )


def _amount(type_: Column) -> Column:
    """Units or goods moved: ``amount`` as a whole number, NULL if it is none.

    Without an amount a market trade moves nothing, all else one piece; buildings
    and technologies are always single.
    """
    given = truthy_text(F.col(PARSED), "$.amount")
    number = F.try_variant_get(F.col(PARSED), "$.amount", "bigint")
    one = F.lit(1).cast("bigint")
    absent = F.when(type_.isin("BUY", "SELL"), one - 1).otherwise(one)
    return F.when(type_.isin("BUILD", "RESEARCH"), one).otherwise(
        F.when(given.isNotNull(), number).otherwise(absent)
    )


def resource_deltas(actions: DataFrame, costs=None) -> DataFrame:
    """Signed change of each resource per action: costs below 0, market as traded.

    Actions that change nothing known are dropped; entries that cost nothing stay.
    With ``costs`` as a list (or none) narrow transformations only: names are priced in place,
    without a join. A DataFrame of costs is joined, see ``prices``.
    """
    type_ = F.col("type")
    trade = type_.isin("BUY", "SELL")
    known = type_.isin(*COSTED_PRODUCTION, "BUILD", "RESEARCH", "BUY", "SELL")
    parsed = with_parsed(actions.filter(F.col("player").isNotNull() & known))
    # One step per value: each compiles to a method that the JVM still optimizes.
    named = evaluate_once(parsed, _kind=priced_kind(type_), _key=C.normalized(priced_name(type_)))
    named = evaluate_once(
        named,
        _amount=_amount(type_),
        _resource=F.when(trade, F.lower(text(F.col(PARSED), "$.resource"))),
    )
    traded = F
    for i, resource in enumerate(RESOURCES):
        traded = traded.when(F.contains(F.col("_resource"), F.lit(resource)), F.lit(i))
    traded = F.when(F.col("_amount") != 0, traded.otherwise(F.lit(None).cast("int")))
    moved = evaluate_once(named.drop(PARSED), _traded=traded).filter(F.col("_amount").isNotNull())
    priced = prices.with_costs(moved, costs).filter(
        F.col("_cost").isNotNull() | F.col("_traded").isNotNull()
    )

    def delta(i: int, resource: str) -> Column:
        market = F.when(type_ == "BUY", F.col("_amount")).otherwise(-F.col("_amount"))
        spent = -F.col("_amount") * F.col("_cost")[resource]
        no_change = F.lit(0).cast("bigint")
        return F.when(trade, F.when(F.col("_traded") == i, market).otherwise(no_change)).otherwise(
            spent
        )

    return priced.select(
        MATCH,
        "seq",
        "player",
        "t_us",
        *[delta(i, resource).alias(resource) for i, resource in enumerate(RESOURCES)],
    )


def _spent(resource: str) -> Column:
    return F.greatest(-F.col(resource), F.lit(0).cast("bigint"))


def resource_spend_timeseries(
    actions: DataFrame, resource: str, window_s=DEFAULT_WINDOW, costs=None
) -> DataFrame:
    """Amount of a resource spent in each window."""
    name = resource_name(resource)
    rows = resource_deltas(actions, costs).filter(F.col(name) < 0)
    rows = rows.select(*KEY, "t_us", (-F.col(name)).alias("v"))
    return series.as_series(series.per_window(series.window_sums(rows, window_s)), window_s)


def resource_balance_timeseries(
    actions: DataFrame, resource: str, window_s=DEFAULT_WINDOW, start_at=0, costs=None
) -> DataFrame:
    """Running balance of a resource, from spending and market trades."""
    name = resource_name(resource)
    rows = resource_deltas(actions, costs).select(*KEY, "t_us", F.col(name).alias("v"))
    sums = series.window_sums(rows, window_s)
    return series.as_series(
        series.running_total(sums), window_s, F.col("v") + _number(start_at)
    )


def _number(value) -> Column:
    return F.lit(int(value)).cast("bigint") if value == int(value) else F.lit(float(value))


def total_spend_timeseries(
    actions: DataFrame, window_s=DEFAULT_WINDOW, cumulative: bool = True, costs=None
) -> DataFrame:
    """Spending over all resources, running or per window."""
    spent = sum((_spent(r) for r in RESOURCES), F.lit(0).cast("bigint"))
    rows = resource_deltas(actions, costs).select(*KEY, "t_us", spent.alias("v"))
    sums = series.window_sums(rows.filter(F.col("v") > 0), window_s)
    filled = series.running_total(sums) if cumulative else series.per_window(sums)
    return series.as_series(filled, window_s)


def approx_total_balance(
    actions: DataFrame, window_s=DEFAULT_WINDOW, start_at=None, costs=None
) -> DataFrame:
    """Running balance over all resources together.

    The balances of the four resources share their windows, so their sum is the
    running sum of the summed changes: one pass instead of four.
    """
    start = sum((START_STOCK if start_at is None else start_at).values())
    change = sum((F.col(r) for r in RESOURCES[1:]), F.col(RESOURCES[0]))
    rows = resource_deltas(actions, costs).select(*KEY, "t_us", change.alias("v"))
    sums = series.window_sums(rows, window_s)
    return series.as_series(series.running_total(sums), window_s, F.col("v") + _number(start))


def spend_has_data(actions: DataFrame, matches: DataFrame, costs=None) -> DataFrame:
    """Whether anything of each resource was spent, for every match.

    The windows of a spend series add up to the spending itself, so the series
    is not built.
    """
    totals = (
        resource_deltas(actions, costs)
        .groupBy(MATCH)
        .agg(*[F.sum(_spent(r)).alias(r) for r in RESOURCES])
    )
    every = matches.select(MATCH).join(totals, MATCH, "left")
    flags = [F.struct(F.lit(r).alias("resource"), F.col(r).alias("total")) for r in RESOURCES]
    return every.select(MATCH, F.inline(F.array(*flags))).select(
        MATCH, "resource", (F.coalesce("total", F.lit(0)) != 0).alias("has_data")
    )


def cost_lookup(actions: DataFrame, costs=None) -> DataFrame:
    """Every distinct priced name of the log with the entry and cost it takes."""
    kind = priced_kind(F.col("type"))
    parsed = with_parsed(actions.filter(kind.isNotNull()))
    names = parsed.select(kind.alias("kind"), priced_name(F.col("type")).alias("name"))
    names = names.filter(F.col("name").isNotNull()).distinct()
    if isinstance(costs, DataFrame):
        names = kept(names, "names")
    keyed = evaluate_once(names, _kind=F.col("kind"), _key=C.normalized(F.col("name")))
    return prices.with_costs(keyed, costs).select(
        "kind",
        "name",
        F.col("_cost.name").alias("matched"),
        *[F.col("_cost")[r].alias(r) for r in RESOURCES],
    )
