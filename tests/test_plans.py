"""Properties of the physical plans that matter at scale."""

import re

import pytest

from golden import golden_tables
from matchlens.catalog import BY_NAME
from matchlens.sources.tables import MatchTables, read_bucketed, read_tables, write_bucketed, write_table


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The hand-worked match as files, so that scans show what reaches them."""
    root = tmp_path_factory.mktemp("tables")
    tables = golden_tables(spark)
    for name in MatchTables.__dataclass_fields__:
        write_table(getattr(tables, name), f"{root}/{name}")
    return read_tables(spark, str(root))


def _plan(spark, df):
    """Plan without broadcasts by size, as for tables that are large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(BY_NAME))
def test_no_query_needs_a_single_task_or_all_pairs(spark, stored, name):
    plan = _plan(spark, BY_NAME[name](stored))
    for bad in ("SinglePartition", "CartesianProduct", "BroadcastNestedLoop", "BroadcastExchange",
                "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan


SERIES = [n for n in BY_NAME if n.startswith(("apm_timeseries", "units_", "resource_spend",
                                              "resource_balance", "total_", "approx_",
                                              "sync_stock"))]


@pytest.mark.parametrize("name", SERIES)
def test_series_spread_a_match_over_blocks(spark, stored, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that reuse shows
    try:
        plan = _plan(spark, BY_NAME[name](stored))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\), ENS", plan)
    exchanges = [[re.sub(r"#\d+L?", "", key) for key in e.split(", ")] for e in exchanges]
    window, block = ["match_id", "player", "block", "bucket"], ["match_id", "player", "block"]
    # Windows are dealt over blocks; only what is left of a block is brought together by match.
    assert exchanges.count(["match_id"]) == 1 and window in exchanges
    assert all(e in (window, block, ["match_id"]) for e in exchanges)
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(match_id#\d+L, \d+\)", line))
    assert re.search(r"keys=\[match_id#\d+L, player#\d+, block#\d+L\]", lines[at + 1])
    # The log is read once, combined before it is shuffled, and both sides of the join share that.
    if name != "sync_stock":
        assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
    below = plan[plan.index("block#", plan.index("bucket#", plan.index("SortMergeJoin"))) :]
    assert "partial_" in below


def test_only_needed_columns_and_types_are_read(spark, stored):
    apm = _plan(spark, BY_NAME["apm_timeseries"](stored))
    assert "ReadSchema: struct<match_id:bigint,player:int,t_us:bigint>" in apm
    assert "PushedFilters: [IsNotNull(player)" in apm
    deltas = _plan(spark, BY_NAME["resource_deltas"](stored))
    assert "In(type, [BUILD," in deltas and "Exchange" not in deltas
    villagers = _plan(spark, BY_NAME["villager_counts"](stored))
    assert "StringContains(type,QUEUE)" in villagers


def test_payloads_are_parsed_once(spark, stored):
    for name in ("villager_gaps", "resource_spend_food", "important_events"):
        plan = _plan(spark, BY_NAME[name](stored))
        scans = plan.count("FileScan parquet [match_id") or plan.count("FileScan")
        assert plan.count("parseJson") == scans


def test_gaps_bound_their_groups(spark, stored):
    plan = _plan(spark, BY_NAME["villager_gaps"](stored))
    # Raw rows are only ever grouped by a bounded range of seq.
    assert re.search(r"Exchange hashpartitioning\(match_id#\d+L, player#\d+, _chunk#\d+L", plan)


def test_samples_are_limited_before_the_shuffle(spark, stored):
    for name in ("action_samples", "unit_string_hits"):
        plan = _plan(spark, BY_NAME[name](stored))
        assert "WindowGroupLimit" in plan[plan.index("Exchange") :]


def test_only_matches_without_stock_are_priced(spark, stored):
    plan = _plan(spark, BY_NAME["stock_total"](stored))
    # Operators are printed from the result down: the parsing of payloads is above the anti join.
    assert plan.count("LeftAnti") == 1
    assert plan.index("parseJson") < plan.index("LeftAnti")
    assert "parseJson" not in plan[plan.index("LeftAnti") :]


def test_player_summary_reads_and_parses_the_log_once(spark, stored):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that reuse shows
    try:
        plan = _plan(spark, BY_NAME["player_summary"](stored))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("parseJson") == 1 and plan.count("FileScan") == 3


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    write_bucketed(golden_tables(spark), "golden", str(tmp_path_factory.mktemp("buckets")), 3)
    yield read_bucketed(spark, "golden")
    for name in MatchTables.__dataclass_fields__:
        spark.sql(f"DROP TABLE golden_{name}")


@pytest.mark.parametrize("name", ["apm_timeseries", "apm_stats", "resource_balance_food", "player_summary"])
def test_actions_of_bucketed_tables_are_not_shuffled(spark, bucketed, stored, name):
    plan = _plan(spark, BY_NAME[name](bucketed))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # What is shuffled are windows of players and what is left of blocks, for a join, and the ranges
    # of gaps. No exchange brings actions together by window or by match.
    assert not any("bucket#" in k or "_window#" in k or re.fullmatch(r"match_id#\d+L, \d+", k) for k in keys)
    assert sorted(map(str, BY_NAME[name](bucketed).collect())) == sorted(map(str, BY_NAME[name](stored).collect()))
