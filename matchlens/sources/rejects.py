"""Reading tables of which some records or files cannot be read: good rows, and what is wrong.

Text formats (a record a line) are parsed once; each line becomes a row or a reject. Parquet has
no readable records in a broken file, so there a reject is a file.
"""

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens import schema
from matchlens.functions.barrier import evaluate_once
from matchlens.functions.workers import ship

MALFORMED = "malformed"


@dataclass(frozen=True)
class SplitRead:
    """``rows`` in the form of the table, with ``source_file``; ``rejects`` (source_file, record,
    reason). Both are lazy and may be used alone."""

    rows: DataFrame
    rejects: DataFrame


def _lines(spark: SparkSession, path) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    return lines.filter(F.trim("value") != "")


def _first_missing(record: Column, required) -> Column:
    """The reason of a record that lacks a required column, or NULL."""
    reason = F
    for name in required:
        reason = reason.when(record[name].isNull(), F.lit(f"no {name}"))
    return reason.otherwise(F.lit(None).cast("string")) if required else F.lit(None).cast("string")


def _split_lines(lines: DataFrame, kinds, fmt: str, required) -> SplitRead:
    # The parser fills the column of the corrupt record; with options it reads all columns always.
    bad = "_bad"
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.fields)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    parse = F.from_json if fmt == "json" else F.from_csv
    parsed = parse(F.col("value"), f"{fields}, {bad} string", options)
    read = evaluate_once(lines, _record=parsed)
    record = F.col("_record")
    broken = record.isNull() | record[bad].isNotNull()
    reason = F.when(broken, F.lit(MALFORMED)).otherwise(_first_missing(record, required))
    told = evaluate_once(read, _reason=reason)
    rows = told.filter(F.col("_reason").isNull())
    return SplitRead(
        rows.select(*[record[f.name].alias(f.name) for f in kinds.fields], "source_file"),
        told.filter(F.col("_reason").isNotNull()).select(
            "source_file", F.col("value").alias("record"), F.col("_reason").alias("reason")
        ),
    )


def _why_unreadable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for batch in batches:
        reasons = []
        for content in batch["content"]:
            try:
                pq.read_table(io.BytesIO(content))
                reasons.append(None)
            except Exception as error:  # whatever the reader finds is what is reported
                reasons.append(f"{MALFORMED}: {type(error).__name__}")
        yield pd.DataFrame({"source_file": batch["source_file"], "reason": reasons})


def _split_files(spark: SparkSession, path, kinds, required) -> SplitRead:
    """A file that gives no row is read whole, to tell an empty one from a broken one. Of a file
    that breaks off later, Spark gives the rows up to there."""
    ship(spark)
    read = spark.read.schema(kinds).option("ignoreCorruptFiles", "true").parquet(path)
    read = read.select("*", F.col("_metadata.file_path").alias("source_file"))
    files = spark.read.format("binaryFile").load(path)
    files = files.select(F.col("_metadata.file_path").alias("source_file"), "content")
    silent = files.join(read.select("source_file").distinct(), "source_file", "left_anti")
    why = silent.mapInPandas(_why_unreadable, "source_file string, reason string")
    record = F.struct(*[F.col(f.name) for f in kinds.fields])
    told = evaluate_once(read, _reason=_first_missing(record, required))
    missing = told.filter(F.col("_reason").isNotNull())
    rejects = missing.select("source_file", F.to_json(record).alias("record"), F.col("_reason").alias("reason"))
    broken = why.filter(F.col("reason").isNotNull())
    broken = broken.select("source_file", F.lit(None).cast("string").alias("record"), "reason")
    return SplitRead(told.filter(F.col("_reason").isNull()).drop("_reason"), rejects.unionByName(broken))


def read_rejecting(
    spark: SparkSession, table: str, path, fmt: str = "json", required=("match_id",)
) -> SplitRead:
    """Read one table (a key of ``schema.TABLES``) and report what cannot be read.

    ``fmt`` is json or csv (a record a line, blank lines do not count) or parquet. A record is a
    reject if it is malformed, has a value of another type, or lacks a ``required`` column; an
    unreadable parquet file is one as a whole.
    """
    kinds = schema.TABLES[table]
    if fmt in ("json", "csv"):
        return _split_lines(_lines(spark, path), kinds, fmt, required)
    if fmt == "parquet":
        return _split_files(spark, path, kinds, required)
    raise ValueError(f"fmt must be json, csv or parquet: {fmt!r}")
