"""Reading action payloads: names, strings, counts and pattern tests.

A payload is a JSON object, given as text or as VARIANT. All functions below
take the parsed VARIANT column that ``with_parsed`` adds.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from matchlens.functions.barrier import evaluate_once
from matchlens.functions.constants import constant_array

PARSED = "_payload"

# Keys read for an item count, in order of preference.
COUNT_KEYS = ("count", "amount", "quantity", "num", "n")

# Variant text of JSON values that count as absent although they are present.
_EMPTY_TEXTS = ("0", "-0", "0.0", "-0.0", "false", "{}", "[]")

MATCH_MODES = ("loose", "strict")


def with_parsed(df: DataFrame, source: str = "payload", when: Column | None = None) -> DataFrame:
    """Add the parsed payload, evaluated once; NULL where ``when`` does not hold.

    Of a key that is repeated the last value counts: a setting of the session, which the parser
    reads when it is planned.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    raw = F.col(source)
    if not isinstance(df.schema[source].dataType, VariantType):
        raw = F.try_parse_json(raw)
    return evaluate_once(df, **{PARSED: raw if when is None else F.when(when, raw)})


# -- types of actions ---------------------------------------------------------


def is_production(type_: Column) -> Column:
    return (
        F.contains(type_, F.lit("TRAIN"))
        | F.contains(type_, F.lit("CREATE"))
        | F.contains(type_, F.lit("QUEUE"))
        | (type_ == "ORDER")
    )


# -- values -------------------------------------------------------------------


def text(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "string")


def is_kind(variant: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(variant), F.lit(kind))


def truthy_text(variant: Column, path: str) -> Column:
    """Text at ``path``, or NULL if it is missing, empty, zero or false."""
    value = text(variant, path)
    is_string = is_kind(F.try_variant_get(variant, path, "variant"), "STRING")
    may_be_empty = F.array_contains(constant_array(("", *_EMPTY_TEXTS)), value)
    return F.when(~may_be_empty, value).when((value != "") & is_string, value)


def unit_name(variant: Column) -> Column:
    """The named unit of a payload; a plain-string ``unit`` is not a name."""
    return F.coalesce(
        truthy_text(variant, "$.unit.name"),
        truthy_text(variant, "$.unit_name"),
        truthy_text(variant, "$.object_name"),
        text(variant, "$.item"),
    )


def item_count(variant: Column) -> Column:
    """First count key holding a positive whole number, else 1."""
    candidates = []
    for key in COUNT_KEYS:
        number = F.try_variant_get(variant, f"$.{key}", "bigint")
        candidates.append(F.when(number > 0, number))
    return F.coalesce(*candidates, F.lit(1).cast("bigint"))


def _children(variant: Column) -> Column:
    values = F.map_values(F.try_variant_get(variant, "$", "map<string,variant>"))
    return F.coalesce(values, F.array().cast("array<variant>"))


def payload_strings(variant: Column) -> Column:
    """Strings at the first two levels of objects; lists are not entered."""
    top = _children(variant)
    values = F.concat(top, F.flatten(F.transform(top, _children)))
    return F.transform(
        F.filter(values, lambda x: is_kind(x, "STRING")), lambda x: text(x, "$")
    )


def match_texts(variant: Column, mode: str = "loose") -> Column:
    """Texts of a payload that a unit pattern is searched in.

    loose: the name and all payload strings. strict: the name, and the strings
    only where there is no name.
    """
    if mode not in MATCH_MODES:
        raise ValueError(f"match mode must be one of {MATCH_MODES}: {mode!r}")
    name, strings = unit_name(variant), payload_strings(variant)
    if mode == "strict":
        return F.when(name.isNotNull(), F.array(name)).otherwise(strings)
    is_new = name.isNotNull() & ~F.array_contains(strings, name)
    return F.when(is_new, F.array_append(strings, name)).otherwise(strings)


# -- patterns -----------------------------------------------------------------


def regex(pattern: str | re.Pattern) -> str:
    """A Java regex for a pattern; plain strings are searched ignoring case.

    ``U`` gives ``\\s``, ``\\b`` and case folding their Unicode meaning.
    """
    if isinstance(pattern, re.Pattern):
        flags = "iU" if pattern.flags & re.IGNORECASE else "U"
        return f"(?{flags}){pattern.pattern}"
    return f"(?iU){pattern}"


# Patterns without anchors, groups or look-around: where such a pattern occurs in
# a string, it also occurs in any text that contains the string.
_CONTEXT_FREE = re.compile(r"(?:[^\W\d]|[ \-.?*|\[\]]|\\s)+")


def may_match(actions: DataFrame, pattern: str | re.Pattern) -> Column:
    """Cheap necessary condition for a match, tested on unparsed JSON text.

    Texts with escapes always pass, as do all texts for patterns that could
    depend on where a string starts or ends.
    """
    if isinstance(actions.schema["payload"].dataType, VariantType):
        return F.lit(True)
    payload = F.col("payload")
    source = pattern.pattern if isinstance(pattern, re.Pattern) else pattern
    if not _CONTEXT_FREE.fullmatch(source):
        return F.lit(True)
    return F.contains(payload, F.lit("\\")) | payload.rlike(regex(pattern))


def any_match(texts: Column, pattern: str | re.Pattern) -> Column:
    java = regex(pattern)
    return F.coalesce(F.exists(texts, lambda s: s.rlike(java)), F.lit(False))


def payload_matches(variant: Column, pattern: str | re.Pattern, mode: str = "loose") -> Column:
    """Whether a payload has a match; the strings are only listed if the name has none."""
    in_texts = any_match(match_texts(variant, mode), pattern)
    if mode == "strict":
        return in_texts
    return F.coalesce(unit_name(variant).rlike(regex(pattern)), F.lit(False)) | in_texts


def matching_actions(
    actions: DataFrame, pattern: str | re.Pattern, mode: str = "loose"
) -> DataFrame:
    """Production actions of a player whose payload matches, with their item count."""
    possible = is_production(F.col("type")) & F.col("player").isNotNull()
    parsed = with_parsed(actions.filter(possible & may_match(actions, pattern)))
    found = parsed.filter(payload_matches(F.col(PARSED), pattern, mode))
    return found.select(
        "match_id", "player", "seq", "t_us", item_count(F.col(PARSED)).alias("items")
    )
