"""Every metric on the hand-worked match."""

import json

import pytest

from golden import MATCH_ID, by_player, golden_tables
from matchlens.operators import activity, diagnostics, events, production, resources, series
from matchlens.plans import reports


@pytest.fixture(scope="module")
def t(spark):
    return golden_tables(spark)


def test_apm(t):
    assert by_player(activity.apm_timeseries(t.actions)) == {1: [2, 2, 1, 3], 2: [1, 2, 3, 1]}


def test_apm_stats(t):
    rows = {r["player"]: r for r in activity.apm_stats(t.actions).collect()}
    assert rows[1]["apm_mean"] == 2 and rows[1]["apm_peak"] == 3
    assert rows[1]["apm_sd"] == pytest.approx((2 / 3) ** 0.5)
    assert set(rows) == {1, 2}


@pytest.mark.parametrize("mode", ["loose", "strict"])
def test_villager_counts(t, mode):
    rows = production.villager_counts(t.actions, t.players, mode=mode).collect()
    assert {r["player"]: r["villagers"] for r in rows} == {1: 5, 2: 3, 3: 0}


def test_units_created(t):
    assert by_player(production.units_created_timeseries(t.actions)) == {1: [2, 3], 2: [2, 1]}


def test_units_created_keeps_windows_of_all_players(t):
    only_one = production.units_created_timeseries(t.actions, players=[1])
    assert by_player(only_one) == {1: [2, 3]}
    nobody = production.units_created_timeseries(t.actions, players=[8])
    assert nobody.count() == 0
    fallback = production.units_created_timeseries(t.actions, players=[8], if_none="all")
    assert by_player(fallback) == {1: [2, 3], 2: [2, 1]}


def test_unknown_unit_is_an_error(t):
    with pytest.raises(ValueError):
        production.units_created_timeseries(t.actions, "Trebuchet")


@pytest.mark.parametrize("chunk", [1, 2, 4, 1 << 20])
def test_idle(t, chunk):
    rows = production.tc_idle_time(t.actions, t.players, chunk=chunk).collect()
    assert {r["player"]: r["idle_s"] for r in rows} == {1: 10, 2: 40, 3: 0}
    assert by_player(production.tc_idle_cumulative(t.actions, chunk=chunk)) == {
        1: [0, 10],
        2: [0, 0],
    }


SPEND = {
    "food": {1: [100, 0, 0, 175], 2: [0, 0, 100, 0]},
    "wood": {1: [0, 0, 50, 50], 2: [0, 25, 0, 0]},
    "gold": {1: [0, 50, 90]},
    "stone": {1: [0, 0, 0, 1300]},
}
BALANCE = {
    "food": {1: [-100, -100, -100, -275], 2: [0, 0, -100, -100]},
    "wood": {1: [0, 0, -50, -100], 2: [0, -25, -25, -25]},
    "gold": {1: [0, -50, -140, -140], 2: [0, 0, 0, 0]},
    "stone": {1: [0, 0, 0, -1300], 2: [0, 0, 100, 100]},
}


@pytest.mark.parametrize("resource", SPEND)
def test_spend_and_balance(t, resource):
    spend = resources.resource_spend_timeseries(t.actions, resource)
    assert by_player(spend) == SPEND[resource]
    balance = resources.resource_balance_timeseries(t.actions, resource)
    assert by_player(balance) == BALANCE[resource]


def test_totals(t):
    cumulative = resources.total_spend_timeseries(t.actions)
    assert by_player(cumulative) == {1: [100, 150, 290, 1815], 2: [0, 25, 125, 125]}
    stock = resources.approx_total_balance(t.actions)
    assert by_player(stock) == {1: [600, 550, 410, -1115], 2: [700, 675, 675, 675]}


def test_stock_falls_back_to_estimate(t):
    assert by_player(reports.stock_total(t)) == {1: [600, 550, 410, -1115], 2: [700, 675, 675, 675]}


def test_milestones(t):
    rows = events.in_time_order(events.important_events(t.actions)).collect()
    assert [(r["t_us"] // 10**6, r["player"], r["label"], r["kind"], r["code"]) for r in rows] == [
        (120, 2, "Feudal Age", "age", "F"),
        (180, 1, "Castle", "castle", "C"),
        (200, 2, "Elite Skirmisher", "elite", "E"),
        (240, 1, "Wheelbarrow", "tech", "T"),
    ]
    kinds = events.important_events(t.actions, kinds=["age"]).collect()
    assert [r["label"] for r in kinds] == ["Feudal Age"]


def test_player_summary(t):
    rows = {r["player"]: r for r in reports.player_summary(t).collect()}
    one, two, three = rows[1], rows[2], rows[3]
    assert (one["name"], one["civ"], one["villagers_trained"]) == ("Ana", 5, 5)
    assert (one["tc_idle_s"], one["apm_mean"], one["apm_peak"]) == (10, 2, 3)
    assert one["tc_idle_pct"] == pytest.approx(100 * 10 / 300)
    assert (two["villagers_trained"], two["tc_idle_s"], two["apm_mean"]) == (3, 40, 1.75)
    assert (three["villagers_trained"], three["tc_idle_s"], three["apm_mean"]) == (0, 0, None)
    assert {r["tc_idle_pct"] for r in reports.rounded(reports.player_summary(t)).collect()} == {
        3.3, 13.3, 0.0,
    }


def test_match_summary(t, tmp_path, spark):
    from matchlens.sources.tables import write_json

    summary = reports.match_summary(t)
    row = summary.collect()[0].asDict(recursive=True)
    assert (row["version"], row["duration_s"], row["map_id"], row["map_name"]) == (
        "VER 9.4", 300.0, 9, "Arabia",
    )
    assert [p["name"] for p in row["players"]] == ["Ana", "Beto", "Cira"]
    write_json(summary, str(tmp_path / "out"))
    text = [line for f in (tmp_path / "out").glob("*.json") for line in open(f)]
    assert json.loads(text[0])["players"][1] == {
        "name": "Beto", "civilization": 9, "winner": False, "eapm": None,
    }


def test_resource_views(t):
    assert by_player(reports.resource_view(t, "spend", "Food")) == SPEND["food"]
    balance = by_player(reports.resource_view(t, "balance", "gold"))
    assert balance == {p: [v + 100 for v in b] for p, b in BALANCE["gold"].items()}
    ramp = by_player(reports.resource_view(t, "postgame", "food"))
    assert ramp == {1: [0, 25, 50, 75, 100], 2: [0] * 5, 3: [0] * 5}
    assert reports.resource_view(t, "stock", "wood").count() == 0
    for arguments in [("income",), ("spend", "iron")]:
        with pytest.raises(ValueError):
            reports.resource_view(t, *arguments)


def test_has_data(t):
    rows = resources.spend_has_data(t.actions, t.matches).collect()
    assert {r["resource"]: r["has_data"] for r in rows} == dict.fromkeys(SPEND, True)
    ramp = reports.resource_view(t, "postgame", "gold")
    assert [r["has_data"] for r in series.has_data(ramp).collect()] == [False]


def test_names_minutes_and_wide_form(t):
    apm = activity.apm_timeseries(t.actions)
    named = series.with_minutes(series.with_names(apm, t.players)).collect()
    assert {(r["player"], r["name"]) for r in named} == {(1, "Ana"), (2, "Beto")}
    assert {r["time_min"] for r in named} == {0, 1, 2, 3}
    wide = series.to_wide(apm, [1, 2]).orderBy("time_sec").collect()
    assert [(r["1"], r["2"]) for r in wide] == [(2, 1), (2, 2), (1, 3), (3, 1)]


def test_diagnostics(t):
    counts = diagnostics.by_frequency(diagnostics.action_type_counts(t.actions)).collect()
    assert (counts[0]["type"], counts[0]["n"]) in {("DE_QUEUE", 4), ("RESEARCH", 4)}
    assert sum(r["n"] for r in counts) == 16
    samples = diagnostics.action_samples(t.actions, limit=2).collect()
    assert sorted((r["kind"], r["rn"], r["seq"]) for r in samples) == [
        ("BUILD", 1, 5), ("BUILD", 2, 13), ("DE_QUEUE", 1, 1), ("DE_QUEUE", 2, 2),
        ("ORDER", 1, 6), ("RESEARCH", 1, 8), ("RESEARCH", 2, 9),
    ]
    hits = {r["unit"]: (r["n"], r["items"]) for r in diagnostics.unit_pattern_hits(t.actions).collect()}
    assert hits == {"Villager": (5, 8), "Archer": (1, 2), "Cavalry Archer": (1, 2)}
    names = {r["seq"]: r["name"] for r in diagnostics.unit_names(t.actions).collect()}
    assert names == {1: None, 2: "Aldeano", 3: "Villager", 4: "Villager", 6: "Villager",
                     7: None, 10: None}
    assert {r["match_id"] for r in diagnostics.prod_events(t.actions).collect()} == {MATCH_ID}
