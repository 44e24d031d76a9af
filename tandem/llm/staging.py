"""Written intermediate tables in the shared folder of ``spark.checkpoint.dir``.

A staged table cuts lineage (a lost executor costs a re-read, not a recompute)
and fixes what a later stage relies on, such as row numbers. Tables lie in a folder
of their application, the same at every call, in the scope that was set when they were
written: ``drop_staged`` removes a scope, or all, once the results are written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.session import checkpoint_dir

_scope: ContextVar[str] = ContextVar("scope", default="query")


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tandem-staged-{spark.sparkContext.applicationId}"


@contextmanager
def staging_scope(name: str) -> Iterator[None]:
    """Tables staged inside belong to this scope."""
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)


def stage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back."""
    path = f"{_folder(df.sparkSession)}/{_scope.get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, scope: str | None = None) -> None:
    """Remove the tables this application has staged, in one scope or all."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_folder(spark) + (f"/{scope}" if scope else ""))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(name: str, *frames: DataFrame) -> str:
    """A column name that no column of the frames has, whatever its case."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_summary(rows: DataFrame, summary: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows with an aggregate of theirs on its keys, which must not be null.

    A redundant second key gives the aggregate an exchange of its own; with both
    sides exchanged for the join AQE may split a key that very many rows share.
    """
    again = F.hash(*keys).alias("_again")
    return (rows.select("*", again).join(summary.select("*", again), [*keys, "_again"], how).drop("_again"))


def in_order(df: DataFrame, columns: list[str]) -> tuple[DataFrame, tuple[str, ...]]:
    """These columns with columns that sort the rows as they lie in the table, and the names of the latter.

    A table just read from Parquet has the order in which it was written: by the number of the task
    and of its file, then within the file (Spark's scan deals files by size). One made without files has
    that of its partitions.
    """
    at = tuple(fresh_name(x, df) for x in ("_at_part", "_at_file", "_at_row"))
    try:
        meta = df.metadataColumn("_metadata")
        name = meta.getField("file_name")
        number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))
        read = df.select(*columns, number(r"^part-([0-9]+)-").alias(at[0]), number(r"-c([0-9]+)\.").alias(at[1]),
                         meta.getField("row_index").alias(at[2]))
        read.schema
    except AnalysisException:
        zero = F.lit(0).cast("long")
        return df.select(*columns, zero.alias(at[0]), zero.alias(at[1]), F.monotonically_increasing_id().alias(at[2])), at
    return read, at


def numbered(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Add a gapless 0-based number of every row within its group, in the given order.

    No group is gathered: rows are range-partitioned by (group, order), so a hot
    group spans many partitions, sorted there and staged with their running ids;
    only one row for each (partition, group) is then summed up to offsets.
    """
    at, part, p, g, first, n, base = (fresh_name(x, df) for x in ("_at", "_part", "_p", "_g", "_first", "_n", "_base"))
    keys = [F.col(group).asc_nulls_first(), *order]
    placed = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .withColumn(at, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(at, 33))
    spans = placed.groupBy(part, group).agg(F.min(at).alias(first), F.count("*").alias(n))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first))
    spans = spans.select(F.col(part).alias(p), F.col(group).alias(g), base)
    # a partition holds few groups and a group few partitions: one row each
    return (placed.join(spans, F.col(part).eqNullSafe(F.col(p)) & F.col(group).eqNullSafe(F.col(g)))
            .withColumn(name, F.col(at) + F.col(base)).drop(at, part, p, g, base))
