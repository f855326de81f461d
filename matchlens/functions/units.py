"""Unit patterns: which payload names belong to which unit line."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens import schema
from matchlens.functions.payload import regex

# Unit lines and the names they go by (English and Spanish).
UNIT_PATTERNS = {
    "Villager": r"villager|aldean",
    "Archer": r"archer|arquero",
    "Crossbowman": r"crossbow|ballestero",
    "Skirmisher": r"skirm|guerrillero|hostigador",
    "Militia": r"militia|milicia|man.?at.?arms|hombre.?de.?armas",
    "Long Swordsman": r"long\s*sword|espad[oó]n|longsword",
    "Spearman": r"spearman|lancero",
    "Pikeman": r"pike|piquero",
    "Scout": r"scout|explorador|light\s*cav",
    "Knight": r"knight|caballero",
    "Cavalier": r"cavalier|caballero\s*mejorado",
    "Paladin": r"paladin|palad[ií]n",
    "Camel": r"camel|camello",
    "Eagle": r"eagle|[áa]guila",
    "Cavalry Archer": r"cavalry\s*archer|arquero\s*a\s*caballo",
    "Hand Cannoneer": r"hand\s*cannoneer|arcabucero|ca[ñn]onero\s*de\s*mano",
    "Hussar": r"hussar|husar",
}

VILLAGER = UNIT_PATTERNS["Villager"]


def augment_unit_patterns(patterns: dict) -> dict:
    """User patterns plus the defaults for units the user did not name."""
    return {**patterns, **{u: p for u, p in UNIT_PATTERNS.items() if u not in patterns}}


def unit_pattern(unit: str, patterns: dict | None = None):
    """Pattern of a unit; an unknown unit is an error before any plan is built."""
    known = UNIT_PATTERNS if patterns is None else patterns
    if unit not in known:
        raise ValueError(f"unknown unit: {unit!r}")
    return known[unit]


def unit_patterns_frame(spark: SparkSession, patterns: dict | None = None) -> DataFrame:
    """The pattern table as a (small, constant) DataFrame."""
    known = UNIT_PATTERNS if patterns is None else patterns
    return spark.createDataFrame(
        [(unit, getattr(p, "pattern", p)) for unit, p in known.items()], schema.UNIT_PATTERNS
    )


def is_villager(name: Column) -> Column:
    return F.coalesce(name.rlike(regex(VILLAGER)), F.lit(False))
