"""Unit patterns given as a DataFrame (unit, pattern), any number of them.

Each alternative of a pattern has a literal piece that every match contains. Texts are searched
for all pieces at once, by joins on n-grams; a regex is only tried on texts that contain a piece
of its own. Patterns with an alternative without such a piece are tried on every distinct text.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions.units import unit_patterns_frame
from matchlens.operators.containment import containing, kept, shuffled

# What the pieces of a pattern are read from: alternatives of literals, wildcards, classes and
# repeats. Patterns with groups, anchors or other escapes have no piece.
_PLAIN = r"^(?:[\p{L}\p{N} #_\-+?*.|]|\\s|\[[^\]\[\\|]*\])*$"
_ATOM = r"(?:\\s|\.|\[[^\]]*\]|[\p{L}\p{N} #_\-])"
_GAP = rf"{_ATOM}[?*]|(?:\\s|\.|\[[^\]]*\])\+?|[+?*]"


def folded(text: Column) -> Column:
    """Equal for any two texts that a search ignoring case holds equal."""
    return F.translate(F.lower(F.upper(text)), "ς̇", "σ")


def with_factors(patterns: DataFrame) -> DataFrame:
    """(unit, pattern, _factor): a row for each alternative, with its longest literal piece."""
    plain = F.when(F.col("pattern").rlike(_PLAIN), F.col("pattern")).otherwise(F.lit(""))
    alternatives = patterns.select("unit", "pattern", F.explode(F.split(plain, r"\|")).alias("_one"))
    pieces = F.transform(F.split("_one", _GAP), folded)
    sized = F.transform(pieces, lambda p: F.struct(F.char_length(p).alias("n"), p.alias("piece")))
    return alternatives.select("unit", "pattern", F.array_max(sized)["piece"].alias("_factor")).distinct()


def matches_of(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(_text, unit): the units whose pattern occurs in each of the distinct ``texts`` (_text).

    The texts are written and counted first. Pieces are looked up once, whatever the number of
    patterns that have them."""
    known = patterns.filter(F.col("unit").isNotNull() & F.col("pattern").isNotNull())
    sought = kept(texts.select("_text", folded(F.col("_text")).alias("_folded")), "texts")
    pieces = with_factors(known)
    met = containing(sought, "_folded", pieces.select("_factor").distinct(), "_factor", [])
    tried = shuffled(met.select("_text", "_factor")).join(pieces, "_factor")
    java = F.concat(F.lit("(?iU)"), F.col("pattern"))
    return tried.filter(F.regexp_like("_text", java)).select("_text", "unit").distinct()


def augmented(patterns: DataFrame) -> DataFrame:
    """User patterns plus the defaults for units the user did not name."""
    defaults = unit_patterns_frame(patterns.sparkSession)
    named = patterns.select("unit").join(F.broadcast(defaults.select("unit")), "unit", "left_semi")
    others = defaults.join(shuffled(named.distinct()), "unit", "left_anti")
    return patterns.select("unit", "pattern").unionByName(others)
