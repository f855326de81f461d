"""Random matches, one of them hot, against plain numpy and pandas computations."""

import json
import random

import numpy as np
import pandas as pd
import pytest

from matchlens import schema
from matchlens.functions import costs
from matchlens.operators import activity, production, resources, series, stock

W = 60
NAMES = ["Villager", "Aldeano", "Knight", "Monk", "Scout Cavalry"]


def _random_actions(seed):
    rng = random.Random(seed)
    rows = []
    for match in range(6):
        hot = match == 0
        count = 400 if hot else rng.choice([1, 3, 40, 90])
        length = rng.choice([30, 60, 240, 600, 1800])
        for seq in range(count):
            # Whole windows, repeated moments and times out of order all occur.
            t = rng.choice([rng.randrange(0, length + 1) * 1_000_000, rng.randrange(0, length // W + 1) * W * 1_000_000,
                            rng.randrange(0, length * 1_000_000 + 1)])
            player = 1 if hot and rng.random() < 0.8 else rng.choice([1, 2, 3, None])
            kind = rng.choice(["DE_QUEUE", "ORDER", "MULTIQUEUE", "BUILD", "BUY", "MOVE"])
            payload = {
                "BUILD": {"building": rng.choice(["House", "Castle", "Farm"])},
                "BUY": {"resource": rng.choice(["food", "stone"]), "amount": 100},
                "MOVE": {},
            }.get(kind, {"unit_name": rng.choice(NAMES), "count": rng.randrange(1, 5)})
            rows.append((match, player, seq, t, kind, json.dumps(payload)))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return _random_actions(request.param)


@pytest.fixture(scope="module")
def actions(spark, rows):
    return spark.createDataFrame(rows, schema.ACTIONS).repartition(5).cache()


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(series.explode_windows, "__defaults__", (3,))


def _dense(events, reduce):
    """{(match, window, player): value} of (match, player, t_us, value) rows, with numpy."""
    out = {}
    df = pd.DataFrame(events, columns=["m", "p", "t", "v"])
    for m, of_match in df.groupby("m"):
        edges = np.arange(0, of_match.t.max() + W * 10**6, W * 10**6)
        for p, of_player in of_match.groupby("p"):
            sums = np.histogram(of_player.t, bins=edges, weights=of_player.v)[0]
            for i, v in enumerate(reduce(sums)):
                out[m, i * W, p] = v
    return out


def _collected(df):
    rows = df.collect()
    found = {(r["match_id"], r["time_sec"], r["player"]): r["value"] for r in rows}
    assert len(found) == len(rows)
    return found


def _assert_same(found, expected):
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(v) for k, v in expected.items())


def test_apm(actions, rows):
    events = [(m, p, t, 1) for m, p, _, t, *_ in rows if p]
    _assert_same(_collected(activity.apm_timeseries(actions, W)), _dense(events, lambda s: s * 60 / W))
    stats = {(r["match_id"], r["player"]): r for r in activity.apm_stats(actions, W).collect()}
    dense = pd.Series(_dense(events, lambda s: s * 60 / W)).groupby(level=[0, 2])
    for key, values in dense:
        assert stats[key]["apm_mean"] == pytest.approx(values.mean())
        assert stats[key]["apm_peak"] == values.max()
        sd = values.std()
        assert stats[key]["apm_sd"] == (None if np.isnan(sd) else pytest.approx(sd))
    assert stats.keys() == {k for k, _ in dense}


def test_units_created(actions, rows):
    wanted = [
        (m, p, t, json.loads(x)["count"]) for m, p, _, t, kind, x in rows
        if p and kind in ("DE_QUEUE", "ORDER", "MULTIQUEUE") and json.loads(x)["unit_name"] == "Knight"
    ]
    _assert_same(_collected(production.units_created_timeseries(actions, "Knight", W)), _dense(wanted, lambda s: s))


def _idle(rows):
    """(match, player, t_us, idle_us) in list order."""
    last, found = {}, []
    for m, p, _, t, kind, x in sorted(rows, key=lambda r: (r[0], r[2])):
        if p is None or kind not in ("DE_QUEUE", "ORDER", "MULTIQUEUE"):
            continue
        if json.loads(x)["unit_name"] not in ("Villager", "Aldeano"):
            continue
        if (m, p) in last and t - last[m, p] > 27_000_000:
            found.append((m, p, t, t - last[m, p] - 25_000_000))
        last[m, p] = t
    return found


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_idle(spark, actions, rows, chunk):
    increments = pd.DataFrame(_idle(rows), columns=["m", "p", "t", "v"])
    players = spark.createDataFrame(
        [(m, p, None, None, None, None) for m in range(6) for p in (1, 2, 3)], schema.PLAYERS
    )
    totals = increments.groupby(["m", "p"]).v.sum() / 1e6
    rows_found = production.tc_idle_time(actions, players, chunk=chunk).collect()
    assert len(rows_found) == 18
    for r in rows_found:
        assert r["idle_s"] == pytest.approx(totals.get((r["match_id"], r["player"]), 0.0))

    expected = {}
    for m, of_match in increments.groupby("m"):
        edges = np.arange(0, of_match.t.max() + W * 10**6, W * 10**6)
        for p, of_player in of_match.groupby("p"):
            total = of_player.groupby("t").v.sum().cumsum()
            shown = total.reindex(edges, method="ffill").fillna(0.0).values[:-1]
            expected.update({(m, i * W, p): v / 1e6 for i, v in enumerate(shown)})
    _assert_same(_collected(production.tc_idle_cumulative(actions, W, chunk=chunk)), expected)


def test_balances_add_up(actions, rows):
    price = {"House": (0, -25, 0, 0), "Castle": (0, 0, 0, -650), "food": (100, 0, 0, 0), "stone": (0, 0, 0, 100),
             "Villager": (-50, 0, 0, 0), "Knight": (-60, 0, -75, 0), "Scout Cavalry": (-80, 0, 0, 0)}
    deltas = []
    for m, p, _, t, kind, x in rows:
        data = json.loads(x)
        name = data.get("building") or data.get("resource") or data.get("unit_name")
        if p and kind != "MULTIQUEUE" and name in price:
            deltas.append((m, p, t, price[name]))
    for i, resource in enumerate(costs.RESOURCES):
        balance = _dense([(m, p, t, d[i]) for m, p, t, d in deltas], np.cumsum)
        _assert_same(_collected(resources.resource_balance_timeseries(actions, resource, W)), balance)
        spent = _dense([(m, p, t, -d[i]) for m, p, t, d in deltas if d[i] < 0], lambda s: s)
        _assert_same(_collected(resources.resource_spend_timeseries(actions, resource, W)), spent)
    change = [(m, p, t, sum(d)) for m, p, t, d in deltas]
    _assert_same(_collected(resources.approx_total_balance(actions, W)), _dense(change, lambda s: s.cumsum() + 700))
    spending = [(m, p, t, -sum(v for v in d if v < 0)) for m, p, t, d in deltas]
    total = _dense([s for s in spending if s[3]], np.cumsum)
    _assert_same(_collected(resources.total_spend_timeseries(actions, W)), total)


def test_stock(spark, rows):
    snaps = [(m, p, seq, t, float(seq % 97)) for m, p, seq, t, *_ in rows]
    frame = spark.createDataFrame(snaps, schema.SNAPSHOTS).repartition(5)
    expected = {}
    df = pd.DataFrame(snaps, columns=["m", "p", "seq", "t", "v"])
    for m, of_match in df.groupby("m"):
        edges = np.arange(0, of_match.t.max() + W * 10**6, W * 10**6)
        for p, of_player in of_match.groupby("p"):
            known = of_player.sort_values(["t", "seq"]).groupby("t").v.last()
            shown = known.reindex(edges, method="ffill").bfill().fillna(0.0).values[:-1]
            expected.update({(m, i * W, p): v for i, v in enumerate(shown)})
    _assert_same(_collected(stock.sync_stock(frame, W)), expected)
