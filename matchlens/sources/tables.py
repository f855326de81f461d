"""Reading and writing match tables."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens import schema
from matchlens.functions.timing import interval_micros


@dataclass(frozen=True)
class MatchTables:
    """The tables that the reports read. All are lazy."""

    matches: DataFrame
    players: DataFrame
    actions: DataFrame
    snapshots: DataFrame
    postgame: DataFrame


def read_table(
    spark: SparkSession,
    table: str,
    path,
    fmt: str = "parquet",
    lineage: bool = False,
    variant: bool = False,
) -> DataFrame:
    """Read one table (a key of ``schema.TABLES``) from files of any Spark format.

    ``path`` may be a glob or a list: all files are read. ``lineage`` adds the file
    each row came from. ``variant``: payloads and documents are stored as VARIANT.
    """
    kinds = schema.with_variants(schema.TABLES[table]) if variant else schema.TABLES[table]
    df = spark.read.schema(kinds).format(fmt).load(path)
    return df.select("*", F.col("_metadata.file_path").alias("source_file")) if lineage else df


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> MatchTables:
    """Read all tables stored under one directory, one subdirectory each."""
    names = MatchTables.__dataclass_fields__
    return MatchTables(**{name: read_table(spark, name, f"{root}/{name}", fmt) for name in names})


def with_time(df: DataFrame, source: str = "timestamp") -> DataFrame:
    """Replace an interval column with microseconds ``t_us``."""
    return df.withColumn("t_us", interval_micros(F.col(source))).drop(source)


def explode_snapshots(packets: DataFrame) -> DataFrame:
    """Sync packets as one row per player.

    Packets without a time are skipped. A packet that names no player still
    counts for the length of the match: it gives a row without player.
    """
    timed = packets.filter(F.col("current_time").isNotNull())
    named = timed.select(
        "match_id",
        "seq",
        F.round(F.col("current_time") * 1000).cast("bigint").alias("t_us"),
        F.explode_outer("players").alias("_key", "_state"),
    )
    return named.select(
        "match_id",
        F.col("_key").try_cast("int").alias("player"),
        "seq",
        "t_us",
        F.coalesce("_state.total_res", F.lit(0.0)).alias("total_res"),
    )


def record_json(record: Column) -> Column:
    """A nested record as JSON text; missing fields are written as null."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row, in files written in parallel."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a fact table for repeated use.

    Rows are sorted by type within files, so that the type filters of the
    operators skip row groups on later scans.
    """
    by_type = df.sortWithinPartitions("type") if "type" in df.columns else df
    by_type.write.mode(mode).parquet(path)


def write_bucketed(
    tables: MatchTables, prefix: str, root: str, buckets: int, mode: str = "errorifexists"
) -> None:
    """Store all tables dealt over ``buckets`` by match, as catalog tables ``<prefix>_<name>``.

    Series of such tables shuffle no actions, only the windows that are left of them: all rows
    of a match are in one bucket already. In return both sides of the join on blocks scan the log. A
    match is then one task's work, so this suits logs in which no match holds a large share of the
    rows. The catalog must outlive the session for use in later ones.
    """
    for name in MatchTables.__dataclass_fields__:
        dealt = getattr(tables, name).repartition(buckets, "match_id")
        writer = dealt.write.mode(mode).bucketBy(buckets, "match_id").sortBy("match_id")
        writer.option("path", f"{root}/{name}").saveAsTable(f"{prefix}_{name}")


def read_bucketed(spark: SparkSession, prefix: str) -> MatchTables:
    """The tables stored by ``write_bucketed``."""
    names = MatchTables.__dataclass_fields__
    return MatchTables(**{name: spark.table(f"{prefix}_{name}") for name in names})
