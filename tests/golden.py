"""A small match worked out by hand; see FIXTURES.md, section 3."""

import json

from matchlens import schema
from matchlens.sources.tables import MatchTables

MATCH_ID = 7
ACTIONS = [
    (1, 0, 1, "DE_QUEUE", {"unit": "Villager", "amount": 1}),
    (2, 5, 2, "DE_QUEUE", {"unit_name": "Aldeano", "count": 2}),
    (3, 25, 1, "QUEUE", {"unit": {"name": "Villager"}, "n": 1}),
    (4, 60, 1, "MULTIQUEUE", {"object_name": "Villager", "quantity": 3}),
    (5, 60, 2, "BUILD", {"building": "House"}),
    (6, 70, 2, "ORDER", {"item": "Villager"}),
    (7, 90, None, "DE_QUEUE", {"unit": "Villager", "amount": 1}),
    (8, 100, 1, "RESEARCH", {"technology": "Loom"}),
    (9, 120, 2, "RESEARCH", {"technology": "Feudal Age"}),
    (10, 130, 1, "DE_QUEUE", {"unit": "Heavy Cavalry Archer", "amount": 2}),
    (11, 150, 2, "SELL", {"resource": "food", "amount": 100}),
    (12, 160, 2, "BUY", {"resource": "stone", "amount": 100}),
    (13, 180, 1, "BUILD", {"building": "Castle"}),
    (14, 185, 1, "BUILD", {"building": "Castle"}),
    (15, 200, 2, "RESEARCH", {"technology": "Elite Skirmisher"}),
    (16, 240, 1, "RESEARCH", {"technology": "Wheelbarrow"}),
]


def actions_frame(spark, rows, match_id=MATCH_ID):
    """Rows (seq, t in s, player, type, payload) as an actions table."""
    return spark.createDataFrame(
        [
            (match_id, player, seq, round(t * 1_000_000), type_,
             payload if payload is None or isinstance(payload, str) else json.dumps(payload))
            for seq, t, player, type_, payload in rows
        ],
        schema.ACTIONS,
    )


def golden_tables(spark) -> MatchTables:
    players = [
        (MATCH_ID, 1, "Ana", 5, True, 60),
        (MATCH_ID, 2, "Beto", 9, False, None),
        (MATCH_ID, 3, "Cira", 11, False, None),
    ]
    doc = {"players": [{"player_id": 1, "total_collected":
                        {"food": 100, "wood": 50, "gold": 0, "stone": 0}}]}
    return MatchTables(
        matches=spark.createDataFrame(
            [(MATCH_ID, 300_000_000, 9, "Arabia", "VER 9.4")], schema.MATCHES
        ),
        players=spark.createDataFrame(players, schema.PLAYERS),
        actions=actions_frame(spark, ACTIONS),
        snapshots=spark.createDataFrame([], schema.SNAPSHOTS),
        postgame=spark.createDataFrame([(MATCH_ID, json.dumps(doc), None)], schema.POSTGAME),
    )


def by_player(series) -> dict:
    """{player: [value of each window in order]}, checking that windows are complete."""
    found = {}
    for row in sorted(series.collect(), key=lambda r: (r["player"], r["time_sec"])):
        found.setdefault(row["player"], []).append((row["time_sec"], row["value"]))
    for windows in found.values():
        assert [t for t, _ in windows] == [i * 60 for i in range(len(windows))]
    return {player: [v for _, v in windows] for player, windows in found.items()}
