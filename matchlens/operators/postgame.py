"""Per-player resource totals from post-game documents of varying shape.

Documents nest to any depth and their order counts, which neither JSON functions nor VARIANT
keep, so each is decoded in a task and flattened into records. What counts among the records
is decided by Spark.
"""

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from matchlens.functions.costs import RESOURCES, resource_name
from matchlens.functions.timing import DEFAULT_WINDOW, ceil_div, window_micros
from matchlens.functions.workers import ship
from matchlens.operators import series
from matchlens.operators.series import KEY, MATCH

# Where player records are looked for, and how fields are spelled.
CONTAINERS = ("players", "player", "achievements", "postgame", "summary")
PLAYER_IDS = ("player_id", "player", "id", "profile_id")
ALIASES = (("", ""), ("", "_collected"), ("total_", ""))
NESTED_TOTALS = "total_collected"
NESTED_RECORD = "economy"

# Sources of records, the first that gives any counts.
KNOWN, ANYWHERE, HEADER, SLOT = range(4)

_LONGEST = 1 << 63
_AMOUNTS = ", ".join(f"{r} double" for r in RESOURCES)
_RECORDS = f"match_id long, source int, place long, player long, {_AMOUNTS}"


def _number(value) -> float:
    try:
        return float(value)
    except (TypeError, ValueError, OverflowError):
        return 0.0


def _whole(value) -> int | None:
    """A player number of 64 bits, or None."""
    try:
        number = int(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return number if -_LONGEST <= number < _LONGEST else None


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|-?Infinity|[a-zA-Z]+")


def _read_deep(text: str):
    """The value of a JSON text that nests to any depth: containers that are still open are kept in
    a list instead of on the stack of calls."""
    root: list = []
    open_, names = [root], [None]
    at, wants_value = _SPACE.match(text).end(), True
    while True:
        within = open_[-1]
        if not wants_value:
            if within is root:
                if at != len(text):
                    raise ValueError("text after the end")
                return root[0]
            mark = text[at : at + 1]
            closing = "}" if isinstance(within, dict) else "]"
            if mark == closing:
                open_.pop()
                names.pop()
                at = _SPACE.match(text, at + 1).end()
                continue
            if mark != ",":
                raise ValueError("neither a comma nor an end")
            at = _SPACE.match(text, at + 1).end()
        if isinstance(within, dict):
            if text[at : at + 1] != '"':
                raise ValueError("a name is missing")
            name, at = scanstring(text, at + 1)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("a colon is missing")
            names[-1] = name
            at = _SPACE.match(text, at + 1).end()
        mark = text[at : at + 1]
        if mark == "{" or mark == "[":
            value, closing = ({}, "}") if mark == "{" else ([], "]")
            at = _SPACE.match(text, at + 1).end()
            empty = text[at : at + 1] == closing
        else:
            empty = None
            if mark == '"':
                value, at = scanstring(text, at + 1)
            else:
                found = _SCALAR.match(text, at)
                value, at = json.loads(found[0]) if found else json.loads(""), found.end()
        if isinstance(within, dict):
            within[names[-1]] = value
        else:
            within.append(value)
        if empty is False:
            open_.append(value)
            names.append(None)
            wants_value = True
            continue
        at = _SPACE.match(text, at + (empty is True)).end()
        wants_value = False


def _decoded(text: str | None):
    """The document; None if there is none or it is broken. Of a repeated key the last value
    counts."""
    try:
        return json.loads(text) if text else None
    except RecursionError:
        pass  # too deep for the library
    except ValueError:
        return None
    try:
        return _read_deep(text)
    except ValueError:
        return None


def _flat(record: dict) -> list[float] | None:
    """Amounts in fields of the record itself: two resources, or one above 0. The first alias
    present counts, its exact spelling before any other case."""
    lower: dict[str, object] = {}
    for key, value in record.items():
        lower.setdefault(key.lower(), value)
    amounts: list[float | None] = []
    for resource in RESOURCES:
        names = [f"{before}{resource}{after}" for before, after in ALIASES]
        name = next((n for n in names if n in lower), None)
        amounts.append(None if name is None else _number(record.get(name, lower[name])))
    present = [a for a in amounts if a is not None]
    enough = len(present) >= 2 or any(a > 0 for a in present)
    return [a or 0.0 for a in amounts] if enough else None


def _own_amounts(record: dict) -> list[float] | None:
    """Food, wood, gold and stone in the fields of a record."""
    totals = record.get(NESTED_TOTALS)
    if isinstance(totals, dict) and {k.lower() for k in totals}.issuperset(RESOURCES):
        return [_number(totals.get(r, 0.0)) for r in RESOURCES]
    return _flat(record)


def read_amounts(record, known: dict[int, list[float] | None] | None = None) -> list[float] | None:
    """Amounts of a record, or of the nearest record nested in it. ``known`` holds what was found
    for records of the same document, so that a chain of records is followed once."""
    chain, amounts = [], None
    while isinstance(record, dict):
        if known and id(record) in known:
            amounts = known[id(record)]
            break
        chain.append(id(record))
        if (amounts := _own_amounts(record)) is not None:
            break
        record = record.get(NESTED_RECORD)
    if known is not None:
        known.update(dict.fromkeys(chain, amounts))
    return amounts


def read_player(record: dict) -> int | None:
    """Player number of a record: its first id that is set, if that is a whole number."""
    return _whole(next(filter(None, map(record.get, PLAYER_IDS)), None))


def from_containers(doc) -> Iterator[tuple[int, list[float]]]:
    """Records of the known containers: lists by record id, objects by their keys."""
    for container in (doc.get(name) for name in CONTAINERS) if isinstance(doc, dict) else ():
        if isinstance(container, list):
            pairs = [(read_player(x), x) for x in container if isinstance(x, dict)]
        elif isinstance(container, dict):
            pairs = [(_whole(k), x) for k, x in container.items() if isinstance(x, dict)]
        else:
            continue
        for player, record in pairs:
            if player is not None and (amounts := read_amounts(record)) is not None:
                yield player, amounts


def from_anywhere(doc) -> Iterator[tuple[int | None, int | None, list[float]]]:
    """(player, position in its list, amounts) of every record, in order of the document. Each
    value is visited once, with a stack of what is left."""
    left, known = [(doc, None)], {}
    while left:
        value, position = left.pop()
        if isinstance(value, dict):
            if (amounts := read_amounts(value, known)) is not None:
                yield read_player(value), position, amounts
            left.extend((x, None) for x in reversed(value.values()))
        elif isinstance(value, list):
            left.extend((x, i) for i, x in reversed(list(enumerate(value))))


def from_header(players) -> list[tuple[int, list[float]]]:
    """Players of a replay header who collected anything. A header with an amount or a number
    that is none does not count at all."""
    found = []
    try:
        for player in players or ():
            economy = (player.get("achievements") or {}).get("economy") or {}
            amounts = [float(economy.get(f"{r}_collected") or 0.0) for r in RESOURCES]
            number = player.get("number")
            if number is not None and any(a > 0 for a in amounts):
                found.append((int(number), amounts))
    except (AttributeError, TypeError, ValueError, OverflowError):
        return []
    return [(n, amounts) for n, amounts in found if _whole(n) is not None]


def _records(doc, header) -> Iterator[tuple]:
    """(source, player, amounts); walks a document only if its containers give nothing."""
    known = list(from_containers(doc))
    for player, amounts in known:
        yield KNOWN, player, amounts
    if known:
        return
    for player, position, amounts in from_anywhere(doc):
        if player is not None:
            yield ANYWHERE, player, amounts
        elif position is not None:
            yield SLOT, position + 1, amounts
    for player, amounts in from_header(header):
        yield HEADER, player, amounts


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split(" ")[0] for field in _RECORDS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * len(RESOURCES)]
    for batch in batches:
        rows = []
        for match, doc, header in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = _records(_decoded(doc), _decoded(header))
            rows += [(match, s, i, p, *amounts) for i, (s, p, amounts) in enumerate(found)]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def postgame_records(postgame: DataFrame) -> DataFrame:
    """Every record found: its source, its place in the document, player and amounts."""
    ship(postgame.sparkSession)

    def as_text(name: str):
        if name not in postgame.columns:
            return F.lit(None).cast("string").alias(name)
        variant = isinstance(postgame.schema[name].dataType, VariantType)
        return (F.to_json(name) if variant else F.col(name)).alias(name)

    texts = postgame.select(F.col(MATCH).cast("bigint"), as_text("doc"), as_text("header"))
    return texts.mapInArrow(_flatten, _RECORDS)


def postgame_totals(postgame: DataFrame) -> DataFrame:
    """Food, wood, gold and stone each player collected, one row per player found.

    Known containers win over records anywhere, those over the header, and that over records
    without ids taken in list order. Of several records of a player the last counts. A document
    is one row; its records are combined by player before they are shuffled.
    """
    last = (
        postgame_records(postgame)
        .groupBy(MATCH, "source", "player")
        .agg(F.max_by(F.struct(*RESOURCES), "place").alias("amounts"))
    )
    # At most one row per player and source by now.
    first = F.min("source").over(Window.partitionBy(MATCH))
    chosen = last.withColumn("first", first).filter(F.col("source") == F.col("first"))
    # Slots that hold only zeros are filled but not reported.
    some = F.greatest(*[F.col(f"amounts.{r}") for r in RESOURCES]) > 0
    kept = chosen.filter((F.col("source") != SLOT) | some)
    return kept.select(*KEY, "amounts.*")


def resource_ramp(
    players: DataFrame,
    matches: DataFrame,
    totals: DataFrame,
    resource: str,
    window_s=DEFAULT_WINDOW,
) -> DataFrame:
    """Straight line from 0 to a player's total over the windows of the match."""
    name = resource_name(resource)
    width = window_micros(window_s)
    n = ceil_div(F.col("duration_us"), width).alias("n")
    lined_up = (
        players.select(*KEY)
        .join(totals.select(*KEY, F.col(name).alias("total")), KEY, "left")
        .join(matches.select(MATCH, n), MATCH)
        .select(*KEY, "n", F.coalesce("total", F.lit(0.0)).alias("total"))
    )
    zero = F.lit(0).cast("bigint")
    filled = series.explode_windows(lined_up, zero, F.col("n") - 1)
    last = F.col("n") - 1
    value = (
        F.when(F.col("bin") == 0, 0.0)
        .when(F.col("bin") == last, F.col("total"))
        .otherwise(F.col("bin") * (F.col("total") / last))
    )
    return series.as_series(filled, window_s, value)
