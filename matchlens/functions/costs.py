"""Resource costs and their lookup by (fuzzy) name."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens import schema
from matchlens.functions.constants import constant_array, constant_map, constant_structs

RESOURCES = ("food", "wood", "gold", "stone")
KINDS = ("unit", "building", "tech")

# Kind, name, food, wood, gold, stone. The order within a kind matters: a name
# that is no entry takes the first entry that contains it or is part of it. Any list of this
# form can replace it.
COSTS = [
    ("unit", "villager", 50, 0, 0, 0),
    ("unit", "militia", 60, 0, 20, 0),
    ("unit", "man-at-arms", 60, 0, 20, 0),
    ("unit", "spearman", 35, 25, 0, 0),
    ("unit", "pikeman", 35, 25, 0, 0),
    ("unit", "halberdier", 35, 25, 0, 0),
    ("unit", "archer", 0, 25, 45, 0),
    ("unit", "crossbowman", 0, 25, 45, 0),
    ("unit", "skirmisher", 25, 35, 0, 0),
    ("unit", "elite skirmisher", 25, 35, 0, 0),
    ("unit", "hand cannoneer", 45, 0, 50, 0),
    ("unit", "cavalry archer", 0, 40, 60, 0),
    ("unit", "scout", 80, 0, 0, 0),
    ("unit", "scout cavalry", 80, 0, 0, 0),
    ("unit", "light cavalry", 80, 0, 0, 0),
    ("unit", "hussar", 80, 0, 0, 0),
    ("unit", "knight", 60, 0, 75, 0),
    ("unit", "cavalier", 60, 0, 75, 0),
    ("unit", "paladin", 60, 0, 75, 0),
    ("unit", "camel", 55, 0, 60, 0),
    ("unit", "camel rider", 55, 0, 60, 0),
    ("unit", "eagle", 20, 0, 50, 0),
    ("unit", "eagle scout", 20, 0, 50, 0),
    ("unit", "eagle warrior", 20, 0, 50, 0),
    ("unit", "battering ram", 0, 160, 75, 0),
    ("unit", "mangonel", 0, 160, 135, 0),
    ("unit", "onager", 0, 160, 135, 0),
    ("unit", "scorpion", 0, 75, 75, 0),
    ("unit", "siege ram", 0, 0, 0, 0),
    ("building", "house", 0, 25, 0, 0),
    ("building", "lumber camp", 0, 100, 0, 0),
    ("building", "mill", 0, 100, 0, 0),
    ("building", "mining camp", 0, 100, 0, 0),
    ("building", "barracks", 0, 175, 0, 0),
    ("building", "archery range", 0, 175, 0, 0),
    ("building", "stable", 0, 175, 0, 0),
    ("building", "blacksmith", 0, 150, 0, 0),
    ("building", "market", 0, 175, 0, 0),
    ("building", "monastery", 0, 175, 0, 0),
    ("building", "siege workshop", 0, 200, 0, 0),
    ("building", "university", 0, 200, 0, 0),
    ("building", "town center", 0, 275, 0, 100),
    ("building", "watch tower", 0, 25, 0, 125),
    ("building", "guard tower", 0, 25, 0, 125),
    ("building", "keep", 0, 25, 0, 125),
    ("building", "castle", 0, 0, 0, 650),
    ("tech", "loom", 0, 0, 50, 0),
    ("tech", "double-bit axe", 0, 100, 0, 0),
    ("tech", "bow saw", 100, 150, 0, 0),
    ("tech", "two-man saw", 300, 300, 0, 0),
    ("tech", "horse collar", 75, 75, 0, 0),
    ("tech", "heavy plow", 125, 125, 0, 0),
    ("tech", "crop rotation", 250, 250, 0, 0),
    ("tech", "wheelbarrow", 175, 50, 0, 0),
    ("tech", "hand cart", 300, 200, 0, 0),
    ("tech", "gold mining", 100, 75, 0, 0),
    ("tech", "gold shaft mining", 200, 150, 0, 0),
    ("tech", "stone mining", 100, 75, 0, 0),
    ("tech", "stone shaft mining", 200, 150, 0, 0),
    ("tech", "town watch", 75, 0, 0, 0),
    ("tech", "town patrol", 300, 0, 100, 0),
    ("tech", "fletching", 50, 0, 100, 0),
    ("tech", "bodkin arrow", 200, 0, 100, 0),
    ("tech", "bracer", 300, 0, 200, 0),
    ("tech", "forging", 150, 0, 0, 0),
    ("tech", "iron casting", 220, 0, 120, 0),
    ("tech", "blast furnace", 275, 0, 225, 0),
    ("tech", "scale mail armor", 100, 0, 0, 0),
    ("tech", "chain mail armor", 200, 0, 0, 0),
    ("tech", "plate mail armor", 300, 0, 0, 0),
    ("tech", "scale barding armor", 150, 0, 0, 0),
    ("tech", "chain barding armor", 250, 0, 0, 0),
    ("tech", "plate barding armor", 350, 0, 0, 0),
    ("tech", "leather archer armor", 100, 0, 0, 0),
    ("tech", "chain archer armor", 150, 0, 0, 0),
    ("tech", "ring archer armor", 250, 0, 0, 0),
]


def costs_frame(spark: SparkSession, costs=None) -> DataFrame:
    """The cost table as a (small, constant) DataFrame; prio is the lookup order."""
    table = COSTS if costs is None else costs
    rows = [(row[0], prio, *row[1:]) for prio, row in enumerate(table)]
    return spark.createDataFrame(rows, schema.COSTS)


# What counts as white space around a name (that of Unicode, and four separators).
_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)


def normalized(name: Column) -> Column:
    """Lower case without surrounding white space."""
    return F.lower(F.btrim(name, F.lit(_SPACE)))


def _by_kind(kind: str | Column, value) -> Column:
    """``value(kind)`` for the kind of the row, or for the one given."""
    if isinstance(kind, str):
        return value(kind)
    found = F
    for k in KINDS:
        found = found.when(kind == k, value(k))
    return found.otherwise(F.lit(None))


def cost_row(kind: str | Column, key: Column, costs=None) -> Column:
    """Position in the cost table of the entry priced for ``key``, or NULL.

    For a table that is a list the lookup stays inside the row: no join and no shuffle on names,
    of which one may dominate the data. Exact names are found in a constant map; only other
    names are compared, with the entries of their kind.
    """
    table = COSTS if costs is None else costs
    entries = {k: [(i, row[1]) for i, row in enumerate(table) if row[0] == k] for k in KINDS}
    if isinstance(kind, str):
        entries = {kind: entries.get(kind, [])}
    if not any(entries.values()):
        return F.lit(None).cast("int")
    # The first of entries that share a name is the one found.
    exact = {f"{k}:{name}": i for k, of in entries.items() for i, name in reversed(of)}
    full = F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), key)

    def names(k: str) -> Column:
        return constant_array([n for _, n in entries[k]]).cast("array<string>")

    def rows(k: str) -> Column:
        return constant_array([i for i, _ in entries[k]]).cast("array<bigint>")

    is_loose = F.transform(_by_kind(kind, names), lambda n: F.contains(key, n) | F.contains(n, key))
    first = F.array_position(is_loose, F.lit(True))
    loose = F.get(_by_kind(kind, rows), (F.when(first > 0, first) - 1).cast("int"))
    return F.coalesce(F.try_element_at(constant_map(exact), full), loose).cast("int")


def entry(row: Column, costs=None) -> Column:
    """The entry at position ``row``: struct<name, food, wood, gold, stone>, or NULL."""
    table = COSTS if costs is None else costs
    return F.get(constant_structs(("name", *RESOURCES), [r[1:] for r in table]), row)


def entry_name(row: Column, costs=None) -> Column:
    return entry(row, costs)["name"]


def resource_name(resource: str) -> str:
    """Checked, lower-cased resource name."""
    name = resource.lower()
    if name not in RESOURCES:
        raise ValueError(f"unknown resource: {resource!r}")
    return name
