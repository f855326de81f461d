"""One match that holds nearly all actions: many tasks, and the same results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from matchlens import schema
from matchlens.operators import activity, production, resources, series, stock

MINUTE = 60_000_000


def _actions(spark, seed=1):
    rng = random.Random(seed)
    rows, seq = [], 0
    for match, length, n in ((1, 97, 600), (2, 3, 20), (3, 0, 2), (4, 8, 40)):
        for _ in range(n):
            seq += 1
            t = rng.choice([rng.randrange(length * MINUTE + 1), rng.randrange(length + 1) * MINUTE])
            payload = rng.choice(['{"unit":"Knight"}', '{"unit_name":"Villager","count":2}'])
            rows.append((match, rng.choice([1, 1, 1, 2, 3, None]), seq, t, "DE_QUEUE", payload))
        # the end of the match, on the start of a window and of a block of windows
        rows += [(match, p, seq + p, length * MINUTE, "DE_QUEUE", '{"unit":"Knight"}') for p in (1, 4)]
        seq += 9
    return spark.createDataFrame(rows, schema.ACTIONS)


def _snapshots(actions):
    return actions.select("match_id", "player", "seq", "t_us", (F.col("seq") * 1.5).alias("total_res"))


CASES = {
    "apm": lambda a: activity.apm_timeseries(a),
    "apm selected": lambda a: activity.apm_timeseries(a, players=(2, 4), if_none="all"),
    "stats": lambda a: activity.apm_stats(a),
    "units": lambda a: production.units_created_timeseries(a, "Knight"),
    "idle": lambda a: production.tc_idle_cumulative(a),
    "spend": lambda a: resources.resource_spend_timeseries(a, "gold"),
    "balance": lambda a: resources.resource_balance_timeseries(a, "food", start_at=7),
    "total": lambda a: resources.total_spend_timeseries(a),
    "stock": lambda a: stock.sync_stock(_snapshots(a)),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("size", [1, 8])
def test_blocks_of_any_size_give_the_same_series(spark, monkeypatch, name, size):
    actions = _actions(spark)
    wanted = sorted(map(str, CASES[name](actions).collect()))
    monkeypatch.setattr(series, "BLOCK", size)
    assert sorted(map(str, CASES[name](actions).collect())) == wanted and wanted


def test_a_hot_match_uses_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 4)
    plain = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")  # as if it were large
    for setting, value in zip(plain, ("false", "-1"), strict=True):
        spark.conf.set(setting, value)
    try:
        for name in ("apm", "balance", "stock"):
            found = CASES[name](_actions(spark).filter("match_id = 1"))
            tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
            assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
            assert max(t["count"] for t in tasks) < 0.6 * found.count()
    finally:
        for setting in plain:
            spark.conf.unset(setting)


@pytest.mark.parametrize("chunk, levels", [(4, 2), (4, 5), (1, 1), (1 << 20, 2), (3, 0)])
def test_gaps_over_levels_of_ranges(spark, chunk, levels):
    rng = random.Random(3)
    seqs = [*rng.sample(range(64), 50), *rng.sample(range(1 << 40), 30)]
    rows = [(m, p, s, rng.randrange(10**9)) for m in (1, 2) for p in (1, 2) for s in seqs if rng.random() < 0.8]
    frame = spark.createDataFrame(rows, "match_id long, player int, seq long, t_us long").repartition(3)
    found = sorted(map(tuple, production.gaps_in_order(frame, chunk, levels).collect()))
    last, wanted = {}, []
    for m, p, s, t in sorted(rows):
        before = last.get((m, p))
        wanted.append((m, p, s, t, None if before is None else t - before))
        last[m, p] = t
    assert found == wanted


def test_no_group_of_a_hot_player_is_larger_than_a_range(spark):
    frame = spark.range(64).select(F.lit(1).cast("long").alias("match_id"), F.lit(1).alias("player"),
                                   F.col("id").alias("seq"), F.col("id").alias("t_us"))
    plan = production.gaps_in_order(frame, 4)._jdf.queryExecution().analyzed().toString()
    keys = re.findall(r"windowspecdefinition\((.*?), (?:seq|_chunk\d)#\d+L ASC", plan)
    keys = {re.sub(r"#\d+L?", "", k) for k in keys}
    # 64 rows are 16 ranges of 4, and those 4 ranges of 4: the last window holds these
    assert keys == {"match_id, player, _chunk", "match_id, player"}
    levels = [frame.groupBy(F.expr(f"seq div {4 ** k}")).count().groupBy(F.expr(f"`(seq div {4 ** k})` div 4")).count()
              for k in (0, 1, 2)]
    assert [max(r["count"] for r in level.collect()) for level in levels] == [4, 4, 4]
