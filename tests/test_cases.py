"""Single-operator cases: payload reading, prices, windows, stock, post-game documents."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from golden import actions_frame, by_player
from matchlens import schema
from matchlens.functions import costs, payload, units
from matchlens.operators import activity, diagnostics, postgame, production, resources, series, stock
from matchlens.sources import tables

VILLAGER = units.VILLAGER


def _read(spark, payloads, column):
    rows = [(i, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)]
    df = payload.with_parsed(spark.createDataFrame(rows, "i int, payload string"))
    out = df.select("i", column(F.col(payload.PARSED)).alias("out")).orderBy("i").collect()
    return [r["out"] for r in out]


def test_item_count(spark):
    cases = [
        ({"count": "3"}, 3), ({"count": 3.7}, 3), ({"count": True}, 1), ({"count": "3.7", "n": 2}, 2),
        ({"amount": 0}, 1), ({}, 1), ({"n": -4}, 1), ({"count": None, "num": 6}, 6),
        ({"quantity": " 4 "}, 4), ({"count": 5_000_000_000}, 5_000_000_000), ("no json", 1), (None, 1),
    ]
    assert _read(spark, [c for c, _ in cases], payload.item_count) == [n for _, n in cases]


def test_unit_name(spark):
    cases = [
        ({"unit": "Archer", "unit_name": "Villager"}, "Villager"),
        ({"unit": {"name": "Knight"}, "unit_name": "Monk"}, "Knight"),
        ({"unit": {"name": ""}, "unit_name": "", "object_name": "Monk"}, "Monk"),
        ({"unit": "Archer"}, None), ({"unit_name": 0, "item": "Ram"}, "Ram"),
        ({"unit_name": "0", "item": "Ram"}, "0"), ({"unit_name": False, "object_name": {}, "item": ""}, ""),
    ]
    assert _read(spark, [c for c, _ in cases], payload.unit_name) == [n for _, n in cases]


@pytest.mark.parametrize("mode,expected", [
    ("loose", [True, True, False, False, True, False, True, False]),
    ("strict", [False, True, False, False, True, False, True, False]),
])
def test_payload_match(spark, mode, expected):
    cases = [
        {"unit_name": "Archer", "note": "villager"},
        {"a": {"b": "villager"}},
        {"a": {"b": {"c": "villager"}}},
        {"a": ["villager"]},
        {"unit": "ALDEANO"},
        {"villager": 1},
        '{"unit_name": "vill\\u0061ger"}',
        {"n": 5},
    ]
    found = _read(spark, cases, lambda v: payload.payload_matches(v, VILLAGER, mode))
    assert found == expected
    # The same through the operator, which tests the unparsed text first.
    actions = actions_frame(spark, [(i, i, 1, "TRAIN", c) for i, c in enumerate(cases)])
    got = payload.matching_actions(actions, VILLAGER, mode).collect()
    assert sorted(r["seq"] for r in got) == [i for i, hit in enumerate(expected) if hit]


def test_variant_payloads(spark):
    text = actions_frame(spark, [(1, 0, 1, "TRAIN", {"unit_name": "Villager", "n": 2})])
    variant = text.withColumn("payload", F.try_parse_json("payload"))
    assert payload.matching_actions(variant, VILLAGER).collect()[0]["items"] == 2


def test_patterns_that_depend_on_position(spark):
    assert _read(spark, [{"unit_name": "villager x"}, {"unit_name": "a villager"}],
                 lambda v: payload.payload_matches(v, r"^villager\b")) == [True, False]
    actions = actions_frame(spark, [(1, 0, 1, "TRAIN", {"unit_name": "villager"})])
    assert payload.matching_actions(actions, re.compile("^villager$")).count() == 1
    assert payload.matching_actions(actions, re.compile("^Villager$")).count() == 0
    with pytest.raises(ValueError):
        payload.matching_actions(actions, VILLAGER, "fuzzy")


def test_regex_folds_accents(spark):
    names = spark.createDataFrame([("ÁGUILA",), ("Espadón",), ("CAÑONERO DE MANO",)], "n string")
    found = [
        names.filter(F.col("n").rlike(payload.regex(units.UNIT_PATTERNS[u]))).count()
        for u in ("Eagle", "Long Swordsman", "Hand Cannoneer")
    ]
    assert found == [1, 1, 1]


def test_production_types_and_villager_names(spark):
    types = ["TRAIN", "DE_CREATE", "MULTIQUEUE", "ORDER", "ORDERS", "queue", "BUILD", None]
    df = spark.createDataFrame([(t,) for t in types], "t string")
    kept = df.filter(payload.is_production(F.col("t"))).collect()
    assert [r["t"] for r in kept] == types[:4]
    names = spark.createDataFrame([("Aldeana",), ("",), (None,)], "n string")
    assert [r[0] for r in names.select(units.is_villager(F.col("n"))).collect()] == [True, False, False]


def test_augmented_patterns(spark):
    merged = units.augment_unit_patterns({"Villager": "serf", "Ram": "ram"})
    assert (merged["Villager"], merged["Ram"]) == ("serf", "ram")
    assert len(merged) == len(units.UNIT_PATTERNS) + 1 == 18
    assert units.unit_patterns_frame(spark, {"Ram": re.compile("ram")}).collect()[0]["pattern"] == "ram"
    actions = actions_frame(spark, [(1, 0, 1, "TRAIN", {"unit_name": "serf"})])
    assert production.units_created_timeseries(actions, "Villager", patterns=merged).count() == 0
    later = actions_frame(spark, [(1, 5, 1, "TRAIN", {"unit_name": "serf"})])
    assert by_player(production.units_created_timeseries(later, "Villager", patterns=merged)) == {1: [1]}


def _costs_of(spark, kind, names, table=None):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    row = costs.cost_row(kind, costs.normalized(F.col("n")), table)
    return [r[0] for r in df.select("i", row.alias("r")).orderBy("i").select(costs.entry_name(F.col("r"), table)).collect()]


def test_cost_lookup(spark):
    names = ["Cavalry Archer", "Heavy Cavalry Archer", "ram", "Monk", " ", " KNIGHT\t", "scout cav"]
    assert _costs_of(spark, "unit", names) == [
        "cavalry archer", "archer", "battering ram", None, "villager", "knight", "scout",
    ]
    assert _costs_of(spark, "building", ["Castle", "Town Center", "Farm"]) == ["castle", "town center", None]
    assert _costs_of(spark, "tech", ["Stone Shaft Mining", "mining", "Feudal Age"]) == [
        "stone shaft mining", "gold mining", None,
    ]
    own = [("unit", "monk", 0, 0, 100, 0)]
    assert _costs_of(spark, "unit", ["Monk", "Knight"], own) == ["monk", None]
    assert _costs_of(spark, "tech", ["Loom"], own) == [None]


def test_cost_tables(spark):
    frame = costs.costs_frame(spark)
    assert {r["kind"]: r["count"] for r in frame.groupBy("kind").count().collect()} == {
        "unit": 29, "building": 17, "tech": 30,
    }


def test_resource_deltas(spark):
    rows = [
        (1, 0, 1, "TRAIN", {"unit": "Villager", "amount": "3"}),
        (2, 0, 1, "TRAIN", {"unit": "Villager", "amount": 0}),
        (3, 0, 1, "TRAIN", {"unit": "Villager", "amount": "x"}),
        (4, 0, 1, "TRAIN", {"item": "Villager"}),
        (5, 0, 1, "MULTIQUEUE", {"unit": "Villager"}),
        (6, 0, 1, "TRAIN", {"unit": {"name": "Knight"}}),
        (7, 0, 1, "TRAIN", {"unit": "Siege Ram"}),
        (8, 0, 1, "BUILD", {"building_name": "House", "amount": 5}),
        (9, 0, 1, "RESEARCH", {"tech": "Loom"}),
        (10, 0, 1, "BUY", {"resource": "GOLD and food", "amount": 100}),
        (11, 0, 1, "SELL", {"resource": "stone"}),
        (12, 0, 1, "SELL", {"resource": "stone", "amount": -5}),
        (13, 0, None, "BUY", {"resource": "gold", "amount": 100}),
        (14, 0, 1, "TRAIN", {"unit": "Villager", "amount": -2}),
        (15, 0, 1, "CREATE", None),
    ]
    got = resources.resource_deltas(actions_frame(spark, rows)).collect()
    assert {r["seq"]: (r["food"], r["wood"], r["gold"], r["stone"]) for r in got} == {
        1: (-150, 0, 0, 0), 2: (-50, 0, 0, 0), 6: (-60, 0, -75, 0), 7: (0, 0, 0, 0),
        8: (0, -25, 0, 0), 9: (0, 0, -50, 0), 10: (100, 0, 0, 0), 12: (0, 0, 0, 5),
        14: (100, 0, 0, 0),
    }


def test_free_units_extend_the_balance(spark):
    rows = [(1, 10, 1, "TRAIN", {"unit": "Villager"}), (2, 130, 2, "TRAIN", {"unit": "Siege Ram"})]
    actions = actions_frame(spark, rows)
    assert by_player(resources.resource_balance_timeseries(actions, "food")) == {
        1: [-50, -50, -50], 2: [0, 0, 0],
    }
    assert by_player(resources.resource_spend_timeseries(actions, "food")) == {1: [50]}


def test_windows_fold_the_last_edge(spark):
    actions = actions_frame(spark, [(i, t, 1, "MOVE", None) for i, t in enumerate([0, 59.9, 60, 119.999, 120])])
    assert by_player(activity.apm_timeseries(actions)) == {1: [2, 3]}
    half = activity.apm_timeseries(actions, 0.5).orderBy("time_sec").collect()
    assert (len(half), half[0]["value"], half[-1]["time_sec"]) == (240, 120.0, 119.5)
    assert half[-1]["value"] == 240.0
    with pytest.raises(ValueError):
        activity.apm_timeseries(actions, 0)


def test_a_match_of_no_length_has_no_windows(spark):
    assert activity.apm_timeseries(actions_frame(spark, [(1, 0, 1, "MOVE", None)])).count() == 0


def test_one_window_has_no_deviation(spark):
    row = activity.apm_stats(actions_frame(spark, [(1, 5, 1, "MOVE", None)])).collect()[0]
    assert (row["apm_mean"], row["apm_sd"], row["apm_peak"]) == (1, None, 1)


def _snapshots(spark, rows):
    return spark.createDataFrame(
        [(1, p, i, round(t * 1e6), v) for i, (p, t, v) in enumerate(rows)], schema.SNAPSHOTS
    )


def test_stock_fills_back_from_the_first_edge(spark):
    rows = [(1, 70, 5.0), (1, 100, 6.0), (1, 130, 9.0)]
    assert by_player(stock.sync_stock(_snapshots(spark, rows))) == {1: [6, 6, 6]}
    # The closing edge shows a value no window starts after.
    assert by_player(stock.sync_stock(_snapshots(spark, [(1, 70, 5.0)]))) == {1: [5, 5]}
    # A packet without players still lengthens the match; a missing value is 0.
    rows = [(1, 60, 4.0), (1, 60, 8.0), (2, 61, None), (None, 200, 0.0)]
    assert by_player(stock.sync_stock(_snapshots(spark, rows))) == {1: [8, 8, 8, 8], 2: [0, 0, 0, 0]}


def test_snapshots_from_packets(spark):
    packets = spark.createDataFrame(
        [
            (1, 1, 70_000.0, {"1": (5.0,), "x": (1.0,), " 2 ": None}),
            (1, 2, None, {"1": (9.0,)}),
            (1, 3, 130_500.0, {}),
        ],
        schema.SYNC_PACKETS,
    )
    rows = tables.explode_snapshots(packets).collect()
    assert sorted((r["seq"], r["player"] or 0, r["t_us"], r["total_res"]) for r in rows) == [
        (1, 0, 70_000_000, 1.0), (1, 1, 70_000_000, 5.0), (1, 2, 70_000_000, 0.0),
        (3, 0, 130_500_000, 0.0),
    ]
    assert by_player(stock.sync_stock(tables.explode_snapshots(packets))) == {
        1: [5, 5, 5], 2: [0, 0, 0],
    }


@pytest.mark.parametrize("doc,header,expected", [
    ({"players": [{"player_id": 1, "food": 10, "wood": 5}]}, None, {1: (10, 5, 0, 0)}),
    ({"players": [{"id": 2, "gold": 7}]}, None, {2: (0, 0, 7, 0)}),
    ({"players": [{"id": 2, "gold": 0}]}, None, {}),
    ({"achievements": {"3": {"economy": {"food_collected": "9", "total_stone": 4}}, "x": {"food": 1, "wood": 1}}},
     None, {3: (9, 0, 0, 4)}),
    ({"players": [{"id": 1, "food": 1, "wood": 1}], "summary": {"1": {"gold": 5}}}, None, {1: (0, 0, 5, 0)}),
    ({"player": [{"player_id": 0, "player": "4", "Food": 2, "GOLD": 3}]}, None, {4: (2, 0, 3, 0)}),
    ({"player": [{"id": 1, "total_collected": {"Food": 9, "wood": 8, "gold": 7, "stone": "x"}}]}, None,
     {1: (0, 8, 7, 0)}),
    ({"players": [{"id": 1, "FOOD": 2, "food": 1, "total_wood": 4, "wood_collected": 3}]}, None, {1: (1, 3, 0, 0)}),
    # anywhere in the document, at any depth
    ({"a": {"b": {"c": {"d": {"e": [{"profile_id": 5, "wood": 1, "stone": 2}]}}}}}, None, {5: (0, 1, 0, 2)}),
    ({"a": {"id": 1, "food": 1, "wood": 1, "z": {"id": 1, "food": 2, "wood": 2}}}, None, {1: (2, 2, 0, 0)}),
    ([{"id": 6, "food": 1, "wood": 1}], None, {6: (1, 1, 0, 0)}),
    # header, then list order
    ({"x": 1}, [{"number": 2, "achievements": {"economy": {"food_collected": 3}}}, {"number": 1}],
     {2: (3, 0, 0, 0)}),
    ({"players": [{"food": 1, "wood": 2}, {"food": 0, "wood": 0}, {"name": "n"}, {"gold": 4}]}, None,
     {1: (1, 2, 0, 0), 4: (0, 0, 4, 0)}),
    # what comes later in the document wins, whatever its key
    ({"players": [{"food": 1, "wood": 2}], "late": {"rows": [{"food": 7, "wood": 7}]}}, None,
     {1: (7, 7, 0, 0)}),
    ({"z": {"id": 1, "food": 1, "wood": 1}, "a": {"id": 1, "food": 2, "wood": 2}}, None, {1: (2, 2, 0, 0)}),
    ("broken", None, {}),
])
def test_postgame_totals(spark, doc, header, expected):
    text = doc if isinstance(doc, str) else json.dumps(doc)
    row = (1, text, json.dumps(header) if header else None)
    rows = postgame.postgame_totals(spark.createDataFrame([row], schema.POSTGAME)).collect()
    found = {r["player"]: (r["food"], r["wood"], r["gold"], r["stone"]) for r in rows}
    assert found == expected


def test_ramp(spark):
    players = spark.createDataFrame([(1, 1, "A", None, None, None)], schema.PLAYERS)
    totals = spark.createDataFrame([(1, 1, 100.0)], "match_id long, player int, food double")

    def ramp(duration_s):
        matches = spark.createDataFrame([(1, duration_s * 10**6, None, None, None)], schema.MATCHES)
        return by_player(postgame.resource_ramp(players, matches, totals, "food"))

    assert ramp(300) == {1: [0, 25, 50, 75, 100]}
    assert ramp(50) == {1: [0]}
    assert ramp(0) == {}


def test_unit_string_hits(spark):
    rows = [
        (1, 0, 1, "QUEUE", {"a": ["Archer", {"b": {"c": {"d": "Scout \"x\" é"}}}], "archer": 1, "z": "militia"}),
        (2, 0, 1, "MOVE", {"a": "archer"}),
        (3, 0, None, "BUILD", {"a": "Skirm"}),
    ]
    hits = diagnostics.unit_string_hits(actions_frame(spark, rows)).collect()
    assert [(r["seq"], r["hit"]) for r in hits] == [
        (1, "militia"), (1, 'Scout "x" é'), (1, "Archer"), (3, "Skirm"),
    ]
    many = actions_frame(spark, [(i, 0, 1, "ORDER", {"a": ["archer"] * 9}) for i in range(5)])
    kept = diagnostics.unit_string_hits(many).groupBy("seq").count().collect()
    assert {r["seq"]: r["count"] for r in kept} == {0: 9, 1: 9, 2: 2}


def test_tables_round_trip(spark, tmp_path):
    actions = actions_frame(spark, [(2, 0, 1, "TRAIN", {"unit": "Villager"}), (1, 1, None, "BUILD", None)])
    tables.write_table(actions, str(tmp_path / "a" / "actions"))
    tables.write_json(actions, str(tmp_path / "j" / "actions"))
    for folder, fmt in (("a", "parquet"), ("j", "json")):
        back = tables.read_table(spark, "actions", f"{tmp_path}/{folder}/act*", fmt, lineage=True)
        assert sorted(r["seq"] for r in back.drop("source_file").collect()) == [1, 2]
        assert back.drop("source_file").exceptAll(actions).count() == 0
        assert back.select("source_file").distinct().count() >= 1


def test_interval_times(spark):
    df = spark.sql("SELECT INTERVAL '1 02:03:04.000005' DAY TO SECOND AS timestamp")
    assert tables.with_time(df).collect()[0]["t_us"] == ((26 * 60 + 3) * 60 + 4) * 10**6 + 5


def test_series_of_several_matches_are_independent(spark):
    first = actions_frame(spark, [(1, 10, 1, "MOVE", None), (2, 250, 2, "MOVE", None)], match_id=1)
    second = actions_frame(spark, [(1, 20, 1, "MOVE", None)], match_id=2)
    apm = activity.apm_timeseries(first.union(second)).groupBy("match_id").count().collect()
    assert {r["match_id"]: r["count"] for r in apm} == {1: 10, 2: 1}
    assert series.has_data(activity.apm_timeseries(first)).collect()[0]["has_data"] is True


# -- post-game documents ------------------------------------------------------


@pytest.mark.parametrize(
    ("doc", "rows"),
    [
        # an economy five objects down, and one behind white space
        (
            '{"a":{"player":1,"economy":{"economy":{"economy":{"economy":{"economy":'
            '{"food":4,"wood":2}}}}}}}',
            [(1, 4.0, 2.0, 0.0, 0.0)],
        ),
        ('\n\t {"x":{"player":1,"food":3,"wood":1}}', [(1, 3.0, 1.0, 0.0, 0.0)]),
        # text is not looked into
        (
            '{"x":{"player":1,"food":3,"wood":1},"raw":"{\\"player\\":7,\\"food\\":1,\\"wood\\":1}"}',
            [(1, 3.0, 1.0, 0.0, 0.0)],
        ),
        # long ids, repeated keys, a broken document
        (
            '{"players":[{"player_id":76561198000000001,"food":2,"wood":1}]}',
            [(76561198000000001, 2.0, 1.0, 0.0, 0.0)],
        ),
        ('{"x":{"player":1,"food":1,"food":9,"wood":2}}', [(1, 9.0, 2.0, 0.0, 0.0)]),
        ('{"players":[', []),
        (None, []),
        ("[" * 100_000, []),
    ],
    ids=["nested", "space", "text", "long id", "repeated key", "broken", "null", "too deep"],
)
def test_postgame_documents(spark, doc, rows):
    frame = spark.createDataFrame([(1, doc, None)], "match_id long, doc string, header string")
    found = postgame.postgame_totals(frame).drop("match_id").collect()
    assert [tuple(row) for row in found] == rows


def test_a_header_with_text_for_an_amount_does_not_count(spark):
    header = '[{"number":1,"achievements":{"economy":{"food_collected":%s}}}]'
    rows = [(1, "{}", header % 5), (2, "{}", header % '"many"')]
    frame = spark.createDataFrame(rows, "match_id long, doc string, header string")
    assert [row.match_id for row in postgame.postgame_totals(frame).collect()] == [1]


def test_a_long_document_is_read_in_linear_time(spark):
    many = json.dumps([{"a": {"z": i, "player": i, "food": i, "wood": 1}} for i in range(1, 8001)])
    frame = spark.createDataFrame([(1, many, None)], "match_id long, doc string, header string")
    started = time.monotonic()
    assert postgame.postgame_totals(frame).count() == 8000
    assert time.monotonic() - started < 30


def test_the_last_of_a_repeated_key_counts(spark):
    row = (1, 1, 1, 0, "DE_QUEUE", '{"unit_name":"Monk","unit_name":"Villager","n":2}')
    names = "match_id long, player int, seq long, t_us long, type string, payload string"
    found = payload.matching_actions(spark.createDataFrame([row], names), VILLAGER).collect()
    assert [row["items"] for row in found] == [2]


def test_payloads_may_be_stored_as_variant(spark, tmp_path):
    rows = [(1, 1, 1, 0, "DE_QUEUE", '{"unit_name":"Villager","n":2}')]
    frame = spark.createDataFrame(rows, schema.ACTIONS)
    stored = frame.withColumn("payload", F.parse_json("payload"))
    tables.write_table(stored, str(tmp_path / "actions"))
    again = tables.read_table(spark, "actions", str(tmp_path / "actions"), variant=True)
    assert [r["items"] for r in payload.matching_actions(again, VILLAGER).collect()] == [2]


def test_names_are_stripped_of_any_white_space(spark):
    frame = spark.createDataFrame([("\u00a0\u2003 Archer\u3000",)], "name string")
    assert frame.select(costs.normalized(F.col("name"))).first()[0] == "archer"
