"""Written intermediate tables, and column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlens.functions.workers import ship
from matchlens.sources.scratch import fresh_path

__all__ = [
    "drop", "free_name", "fresh_path", "numbered", "partitions", "passing", "row_key", "ship", "written",
]

#: Spark then removes the shuffle files of a query as it ends; else they stay on the disks of the
#: executors until the driver happens to collect its garbage. Unknown, and without effect, before 4.1.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables written since the innermost ``passing`` began.
_passing: ContextVar[list[DataFrame] | None] = ContextVar("passing", default=None)


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """The rows of ``df`` from a table written in the shared folder.

    Cuts the lineage: a lost executor costs a re-read, and rows do not change when a
    task is repeated. Shuffle files of the writing go when it ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    if (tables := _passing.get()) is not None:
        tables.append(table)
    return table


def drop(*tables: DataFrame) -> None:
    """Delete ``tables``, as ``written`` returned them, that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written within are dropped at the end, but for those that went through the function
    given. What is still read later must not depend on the others."""
    outer, kept = _passing.get(), []
    token = _passing.set(tables := [])
    try:
        yield lambda table: kept.append(table) or table
    finally:
        _passing.reset(token)
    if outer is not None:
        outer += kept
    drop(*(t for t in tables if all(t is not k for k in kept)))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: str | Column, text: str | Column) -> Column:
    """Tells rows with the same ``doc_id`` (or none) but another text apart."""
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(doc_id, text, text.isNull())


def numbered(df: DataFrame, key: str, by: list[str], out: str) -> DataFrame:
    """Add ``out``, a gapless number from 0 within each ``key``.

    Rows of a key are dealt over hash buckets of ``by`` and numbered there; a bucket starts
    where the buckets before it end. So no key, however large, is numbered in one task. The
    order is that of (bucket, ``by``). ``df`` should be a written table: it is read twice.
    """
    bucket, base = free_name(df, "bucket"), free_name(df, "base")
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*by), F.lit(partitions(df.sparkSession))))
    earlier = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(base).over(earlier) - F.col(base)
    place = F.row_number().over(Window.partitionBy(key, bucket).orderBy(*by))
    starts = (
        dealt.groupBy(key, bucket)
        .agg(F.count(F.lit(1)).alias(base))
        .select(key, bucket, before.alias(base))
    )
    return (
        dealt.withColumn(out, place)
        .join(starts, [key, bucket])
        .withColumn(out, F.col(base) + F.col(out) - 1)
        .drop(bucket, base)
    )

