"""Prices of names from a cost table, given as rows of Python or as a DataFrame.

A name takes the entry of that name, else the first entry in order that contains the name or is
part of it. A list of entries is searched inside the row. A DataFrame (kind, prio, name, food,
wood, gold, stone) may hold any number of entries: there the distinct names of the log are looked up
by joins on n-grams, and the result is joined to the rows that bear them. The distinct names are
written and counted first: if they are few, joins broadcast them, and never the entries.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.functions import costs as C
from matchlens.functions.barrier import evaluate_once
from matchlens.operators.containment import are_few, contained, containing, kept, placed, short_sizes

KIND, KEY, COST = "_kind", "_key", "_cost"


def first_entries(names: DataFrame, costs: DataFrame, few: bool | None = None) -> DataFrame:
    """(_kind, _key, _cost) of the distinct ``names`` (_kind, _key) that ``costs`` has a price for.

    Entries with the smallest (prio, name) come first; of entries with one name, the first
    counts. Entries without a kind or name are left out; a missing amount is 0. An empty entry is
    part of every name, and an empty name of every entry. ``few``: whether the names are, see
    ``containment.are_few``; they are counted where it is not given.
    """
    few = are_few(names, KEY) if few is None else few
    amounts = [F.coalesce(F.col(r).cast("bigint"), F.lit(0).cast("bigint")).alias(r) for r in C.RESOURCES]
    listed = costs.filter(F.col("kind").isNotNull() & F.col("name").isNotNull()).select(
        F.col("kind").alias(KIND), F.col("name").alias("_entry"), F.col("prio").alias("_prio"),
        F.struct("name", *amounts).alias(COST),
    )
    entries = listed.groupBy(KIND, "_entry").agg(
        F.min("_prio").alias("_prio"), F.min_by(COST, "_prio").alias(COST)
    )
    bare = entries.select(KIND, "_entry", "_prio")
    own = entries.withColumnRenamed("_entry", KEY).select(KIND, KEY, COST)
    # Read in many places below: written, it is planned once and not in each of them.
    exact = kept(placed(names, few).join(own, [KIND, KEY]), "exact")
    others = names.join(placed(exact.select(KIND, KEY), few), [KIND, KEY], "left_anti")
    pairs = containing(others, KEY, bare, "_entry", [KIND], few).unionByName(
        contained(others, KEY, bare, "_entry", [KIND], few, short_sizes(names, KEY))
    )
    first = pairs.groupBy(KIND, KEY).agg(F.min(F.struct("_prio", "_entry"))["_entry"].alias("_entry"))
    loose = placed(first, few).join(entries, [KIND, "_entry"]).select(KIND, KEY, COST)
    return exact.unionByName(loose)


def with_costs(named: DataFrame, costs=None) -> DataFrame:
    """Add ``_cost``, the entry priced for ``_kind`` and ``_key``, or NULL."""
    if not isinstance(costs, DataFrame):
        rows = evaluate_once(named, _row=C.cost_row(F.col(KIND), F.col(KEY), costs))
        return rows.withColumn(COST, C.entry(F.col("_row"), costs)).drop("_row")
    is_named = F.col(KIND).isNotNull() & F.col(KEY).isNotNull()
    names = kept(named.filter(is_named).select(KIND, KEY).distinct(), "names")
    few = are_few(names, KEY)
    return named.join(placed(first_entries(names, costs, few), few), [KIND, KEY], "left")
