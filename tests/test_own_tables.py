"""Costs and unit patterns given as DataFrames, against plain loops over them."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from matchlens import schema
from matchlens.functions import costs
from matchlens.operators import containment, diagnostics, patterns, prices, resources
from matchlens.operators.containment import contained, containing
from matchlens.plans import variants
from golden import golden_tables


def _words(rng, n, most, letters="abc d"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("way", [containing, contained])
def test_containment(spark, way):
    rng = random.Random(1)
    texts = sorted({(rng.choice("xy"), w) for w in _words(rng, 150, 14)})
    parts = sorted({(rng.choice("xy"), w) for w in _words(rng, 150, 8)})
    a, b = spark.createDataFrame(texts, "g string, t string"), spark.createDataFrame(parts, "g string, p string")
    args = (a, "t", b, "p") if way is containing else (b, "p", a, "t")
    found = way(*args, ["g"]).select("g", "t", "p").collect()
    assert sorted(map(tuple, found)) == sorted((g, t, p) for g, t in texts for h, p in parts if g == h and p in t)


def _first(kind, key, table):
    of_kind = [r for r in sorted(table, key=lambda r: (r[1], r[2])) if r[0] == kind]
    for test in (lambda n: n == key, lambda n: n in key or key in n):
        for row in of_kind:
            if test(row[2]):
                return row[2:]
    return None


def test_first_entries(spark):
    rng = random.Random(2)
    table = [(rng.choice(costs.KINDS[:2]), rng.randrange(500), w, rng.randrange(9), 0, 1, 2)
             for w in _words(rng, 120, 9, "abcdé ")]
    table.append(("unit", 9999, "", 7, 7, 7, 7))
    names = sorted({(rng.choice(costs.KINDS), w) for w in _words(rng, 200, 12, "abcdé ")} | {("unit", "")})
    frame = spark.createDataFrame(table + [(None, 1, "x", 1, 1, 1, 1), ("unit", 1, None, 1, 1, 1, 1)], schema.COSTS)
    found = prices.first_entries(spark.createDataFrame(names, "_kind string, _key string"), frame)
    got = {(r["_kind"], r["_key"]): tuple(r["_cost"]) for r in found.collect()}
    wanted = {n: _first(*n, table) for n in names}
    assert got == {n: e for n, e in wanted.items() if e}
    assert found.count() == len(got)


def test_table_of_costs_prices_like_the_list(spark):
    actions = golden_tables(spark).actions
    frame = costs.costs_frame(spark)
    for of in (resources.resource_deltas, resources.cost_lookup):
        one, other = of(actions), of(actions, frame)
        assert one.schema.simpleString() == other.schema.simpleString()
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_many_entries_are_joined_on_grams(spark):
    n = 100_000
    name = F.concat(F.lit("thing "), F.hex(F.xxhash64("id")))
    known = spark.range(n).select(
        F.lit("unit").alias("kind"), F.col("id").cast("int").alias("prio"), F.lower(name).alias("name"),
        *[F.col("id").alias(r) for r in costs.RESOURCES],
    )
    sought = known.filter("prio % 9973 = 7").select("kind", F.expr("substring(name, 9, 9)").alias("name"), "food")
    keys = sought.select(F.col("kind").alias("_kind"), F.col("name").alias("_key"))
    found = prices.first_entries(keys, known)
    assert {r["_cost"]["food"] for r in found.collect()} == {r["food"] for r in sought.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("rows", [10_000, -1])
def test_entries_are_never_broadcast(spark, monkeypatch, rows):
    """Whatever their size is taken for: names are, if they are few by count."""
    monkeypatch.setattr(containment, "FEW_ROWS", rows, raising=False)
    table = [("unit", i, f"thing {i:05d}", i, 0, 0, 0) for i in range(3000)] + [("unit", 1, "ring", 7, 0, 0, 0)]
    names = spark.createDataFrame([("unit", n) for n in ("thing 00042", "hing 0010", "a ring", "none")], "_kind string, _key string")
    found = prices.first_entries(names, spark.createDataFrame(table, schema.COSTS))
    assert {r["_key"]: r["_cost"]["food"] for r in found.collect()} == {"thing 00042": 42, "hing 0010": 100, "a ring": 7}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and ("Broadcast" in plan) == (rows > 0)


def test_prices_of_many_names_are_shuffled(spark, monkeypatch):
    actions, frame = golden_tables(spark).actions, costs.costs_frame(spark)
    wanted = sorted(map(str, resources.resource_deltas(actions).collect()))
    monkeypatch.setattr(containment, "FEW_ROWS", -1, raising=False)
    found = resources.resource_deltas(actions, frame)
    assert sorted(map(str, found.collect())) == wanted and wanted
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def _broadcast_rows(node):
    """The rows of every broadcast of a plan that ran."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _broadcast_rows(node.executedPlan())
    if name.endswith("QueryStage"):
        return _broadcast_rows(node.plan())
    own = [node.metrics().apply("numOutputRows").value()] if name == "BroadcastExchange" else []
    below = node.children()
    return own + [n for i in range(below.size()) for n in _broadcast_rows(below.apply(i))]


def test_what_the_driver_broadcasts_does_not_grow_with_the_entries(spark):
    actions, most = golden_tables(spark).actions, []
    for n in (3000, 30_000):
        part = spark.range(n).select(
            F.col("id").alias("p_partkey"), F.concat(F.lit("old bolt"), "id").alias("p_name"),
            F.lit(5).alias("p_size"),
        )
        found = resources.resource_deltas(actions, variants.own_costs(part))
        assert found.collect()
        most.append(max(_broadcast_rows(found._jdf.queryExecution().executedPlan())))
    assert most[0] == most[1] < 500


TEXTS = ["Villager", "aldeano", "Man-at-Arms", "MAN AT ARMS", "Long  Swordsman", "longsword", "İstanbul", "straße",
         "STRASSE", "ΣΊΣΥΦΟΣ", "σίσυφος", "x", "", "a.b", "camel rider", "10%", "Kelvin K"]
PATTERNS = [r"villager|aldean", r"man.?at.?arms", r"long\s*sword", "istanbul", "straße", "σίσυφος", r"^x$", "(a|b)c?",
            r"\d+", "a.b", "[cd]amel+", "ka*m", "cam.l r", "lo+ng", "", "kelvin k", "x|", r"a\.b", "q?x", "sword+s"]


def test_factors_lose_no_match(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "_text string")
    table = spark.createDataFrame([(f"u{i}", p) for i, p in enumerate(PATTERNS)] + [(None, "x"), ("u", None)],
                                  "unit string, pattern string")
    found = {tuple(r) for r in patterns.matches_of(texts, table).collect()}
    every = texts.crossJoin(table.filter("unit IS NOT NULL AND pattern IS NOT NULL"))
    plain = every.filter(F.regexp_like("_text", F.concat(F.lit("(?iU)"), "pattern"))).select("_text", "unit")
    assert found == {tuple(r) for r in plain.collect()}
    factors = {r.pattern: r["_factor"] for r in patterns.with_factors(table).collect()}
    assert factors["man.?at.?arms"] == "arms" and factors[r"\d+"] == "" and factors["cam.l r"] == "l r"


def test_table_of_patterns_hits_like_the_dict(spark):
    actions = golden_tables(spark).actions
    table = patterns.augmented(spark.createDataFrame([("Villager", "villager|aldean")], "unit string, pattern string"))
    one, other = (diagnostics.unit_pattern_hits(actions, p).collect() for p in (None, table))
    assert sorted(map(str, one)) == sorted(map(str, other)) and one


def test_units_are_counted_by_class(spark, monkeypatch):
    """Actions are not multiplied by the units that their texts have, however many those are."""
    monkeypatch.setattr(diagnostics, "BLOCK", 2, raising=False)
    rng = random.Random(3)
    words = ["archer", "knight", "scout", "ring", "bolt"]
    rows = [(rng.randrange(3), i, json.dumps({"unit_name": rng.choice(words), "more": rng.choice(words), "n": i % 4}))
            for i in range(200)]
    rows.append((1, 900, "{}"))
    actions = spark.createDataFrame(rows, "match_id long, seq long, payload string").select(
        "*", F.lit(1).alias("player"), F.lit("QUEUE").alias("type"))
    units = {f"Line {i}": rng.choice([*words, "ar.her", "ring|bolt", "arch|knig", "t$", "none"]) for i in range(90)}
    table = spark.createDataFrame(list(units.items()) + [("Line 0", "ring")], "unit string, pattern string")
    units["Line 0"] += "|ring"
    wanted = diagnostics.unit_pattern_hits(actions, units).collect()
    found = diagnostics.unit_pattern_hits(actions, table)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted)) and wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(?:hashpartitioning|keys=)[(\[][^()\[\]]*match_id[^()\[\]]*(?:seq|unit)#", plan)


def test_defaults_come_by_anti_join(spark):
    part = spark.createDataFrame([(i, f"old bolt{i}", "Brand#1") for i in range(1000)],
                                 "p_partkey long, p_name string, p_brand string")
    table = patterns.augmented(variants.own_patterns(part))
    names = [r.unit for r in table.collect()]
    assert len(names) == len(set(names)) == 1016 and names.count("Villager") == 1
    plan = diagnostics.unit_pattern_hits(golden_tables(spark).actions, table)
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert re.search(r"regexp_like|RLIKE", plan)


def test_long_payloads_stay_whole(spark):
    payload = '{"unit_name":"Villager","more":"' + "x" * (1 << 20) + '"}'
    rows = spark.createDataFrame([("QUEUE", 1, payload)], "type string, seq long, payload string")
    found = variants._prefixed(rows, F.lit(True), '"note":"x"').first().payload
    assert found == '{"note":"x",' + payload[1:]
