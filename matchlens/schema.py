"""Schemas of the match tables.

Only ``payload``, ``doc`` and ``header`` are dynamic (JSON text or VARIANT);
everything filtered, grouped or joined on is a real column, so that filters and
column pruning reach the scan.
"""

from pyspark.sql import types as T

_LONG, _INT, _STR = T.LongType(), T.IntegerType(), T.StringType()


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


MATCHES = _struct(
    ("match_id", _LONG),
    ("duration_us", _LONG),
    ("map_id", _INT),
    ("map_name", _STR),
    ("version", _STR),
)

PLAYERS = _struct(
    ("match_id", _LONG),
    ("player", _INT),
    ("name", _STR),
    ("civilization", _INT),
    ("winner", T.BooleanType()),
    ("eapm", _INT),
)

# seq is the position of the action in the list of its match and is unique there.
ACTIONS = _struct(
    ("match_id", _LONG),
    ("player", _INT),
    ("seq", _LONG),
    ("t_us", _LONG),
    ("type", _STR),
    ("payload", _STR),
)

# One row per sync packet, as decoded.
SYNC_PACKETS = _struct(
    ("match_id", _LONG),
    ("seq", _LONG),
    ("current_time", T.DoubleType()),
    ("players", T.MapType(_STR, _struct(("total_res", T.DoubleType())))),
)

# One row per packet and player; player is NULL for a packet naming no player.
SNAPSHOTS = _struct(
    ("match_id", _LONG),
    ("player", _INT),
    ("seq", _LONG),
    ("t_us", _LONG),
    ("total_res", T.DoubleType()),
)

# One row per match; header holds the player list of the replay header, if any.
POSTGAME = _struct(("match_id", _LONG), ("doc", _STR), ("header", _STR))

COSTS = _struct(
    ("kind", _STR),
    ("prio", _INT),
    ("name", _STR),
    ("food", _LONG),
    ("wood", _LONG),
    ("gold", _LONG),
    ("stone", _LONG),
)

UNIT_PATTERNS = _struct(("unit", _STR), ("pattern", _STR))

TABLES = {
    "matches": MATCHES,
    "players": PLAYERS,
    "actions": ACTIONS,
    "sync_packets": SYNC_PACKETS,
    "snapshots": SNAPSHOTS,
    "postgame": POSTGAME,
}

DYNAMIC = ("payload", "doc", "header")


def with_variants(table: T.StructType) -> T.StructType:
    """The same table with its dynamic columns as VARIANT."""
    return _struct(
        *((f.name, T.VariantType() if f.name in DYNAMIC else f.dataType) for f in table.fields)
    )
