"""Structured Streaming versions of ingest, dedupe, trailing features,
settlement and periodic performance (T1-T5).

The original is a daily batch poll; these run the same operators on files
landing in a folder. Every query keeps its checkpoint beside its sink
(``<sink>_checkpoint``, or a given folder) and uses ``trigger(availableNow=True)``
(process what is there, then stop), so a scheduler runs them like batch jobs and a
later run into the same sink resumes where the last one stopped. ``seen``, a dict
where given, gets the rows dropped behind the watermark (``late``) and those in state at
the end (``state_rows``).

State of the stream operators (T2, T4, T5) lies in RocksDB on the executors' disks, backed up in the
checkpoint; T1, T3 and T5 keep theirs in versioned tables, where a batch and the number of the last
batch applied are one commit, so that a batch that is run again applies once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.sources.store import scratch_path
from tandem.sources.versions import VersionedTable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; a provider that the session names stays."""
    given = spark.conf.get(_PROVIDER, None)
    ours = given is None or given.endswith("HDFSBackedStateStoreProvider")
    if ours:
        spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if ours:
            spark.conf.unset(_PROVIDER) if given is None else spark.conf.set(_PROVIDER, given)


def _run(spark: SparkSession, writer, name: str, seen: dict | None = None) -> None:
    with _rocksdb(spark):
        q = writer.trigger(availableNow=True).queryName(name).start()
        q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if seen is not None:
        progress = q.recentProgress
        seen["late"] = seen.get("late", 0) + sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
        if progress:
            seen["state_rows"] = sum(op["numRowsTotal"] for op in progress[-1]["stateOperators"])


def _checkpoint(sink: str, given: str | None) -> str:
    return given or sink.rstrip("/") + "_checkpoint"


def _files(stream, max_files: int | None):
    return stream if max_files is None else stream.option("maxFilesPerTrigger", max_files)


# --------------------------------------------------------------------------- landing helpers
def time_slices(df: DataFrame, time_col: str, slices: int) -> list[DataFrame]:
    """The rows cut into equal spans of time, oldest first; rows without a time come first."""
    lo, hi = df.agg(F.min(time_col), F.max(time_col)).first()
    if lo is None:
        return [df]
    cuts = [F.lit(lo + (hi - lo) * i / slices) for i in range(1, slices)]
    t = F.col(time_col)
    parts = []
    for i in range(slices):
        part = df if i == 0 else df.filter(t >= cuts[i - 1])
        if i < slices - 1:
            part = part.filter((t < cuts[i]) | t.isNull() if i == 0 else t < cuts[i])
        parts.append(part)
    return parts


def land(df: DataFrame, folder: str, time_col: str) -> str:
    """Append the rows to a folder, as files that each hold a span of time."""
    df.repartitionByRange(time_col).write.mode("append").parquet(folder)
    return folder


# --------------------------------------------------------------------------- T1
def stream_upsert(spark: SparkSession, box_folder: str, scoreboard: DataFrame, dim: DataFrame,
                  table_path: str, max_files: int | None = None, checkpoint: str | None = None) -> str:
    """Box scores arriving as JSON files -> completed events (joined to
    the scoreboard) -> latest-wins upsert into the versioned games table, one
    micro-batch at a time. The version that holds a batch names it, so a batch that is
    retried after its commit is skipped, and one that was killed before has left no trace."""
    from tandem.plans.jobs import feed_delta
    from tandem.sources.feeds import BOXSCORE_SCHEMA, boxscore_rows
    from tandem.sources.store import GAME_DEFAULTS, GAME_KEY, upsert_into

    ckpt = _checkpoint(table_path, checkpoint)
    tag = f"stream:{ckpt}"
    table = VersionedTable(spark, table_path)

    def apply(batch: DataFrame, batch_id: int) -> None:
        if table.tag(tag, -1) < batch_id:
            upsert_into(spark, table_path, feed_delta(scoreboard, boxscore_rows(batch), dim), GAME_KEY,
                        order_col="game_id", defaults=GAME_DEFAULTS, tags={tag: batch_id})

    stream = _files(spark.readStream.schema(BOXSCORE_SCHEMA), max_files).json(box_folder)
    _run(spark, stream.writeStream.foreachBatch(apply).option("checkpointLocation", ckpt), "t1_upsert")
    return table_path


# --------------------------------------------------------------------------- T2
def stream_dedupe(spark: SparkSession, folder: str, schema: T.StructType, key: list[str],
                  time_col: str, delay: str = "7 days", out: str | None = None, checkpoint: str | None = None,
                  max_files: int | None = None, seen: dict | None = None) -> str:
    """Drop re-delivered rows by key within the watermark delay. A key's state goes once the
    watermark passes it; copies that come later still are behind the watermark and dropped as late rows, so no
    key is emitted twice as long as first deliveries are no more than the delay behind the newest row."""
    out = out or scratch_path(spark, "t2-out")
    s = (_files(spark.readStream.schema(schema), max_files).parquet(folder)
         .withColumn("_event_time", F.col(time_col).cast("timestamp"))
         .withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(key).drop("_event_time"))
    _run(spark, s.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", _checkpoint(out, checkpoint)), "t2_dedupe", seen)
    return out


# --------------------------------------------------------------------------- T3
def stream_trailing(spark: SparkSession, folder: str, schema: T.StructType, spec, out: str | None = None,
                    checkpoint: str | None = None, max_files: int | None = None, buckets: int = 64,
                    keep: list[str] | None = None, derive=lambda rows: rows) -> tuple[str, str]:
    """Trailing, rest and season features (W1, W2, W5-W7) of arriving rows, per entity.

    State is that of :class:`~tandem.operators.incremental.FeatureState`: the last max(w) + 1 rows of an entity
    with their season counters. Each micro-batch runs the batch windows over state and new rows, so the features
    are those of the batch operator, a hot entity is split as there, and nothing is gathered in Python. Rows not
    after their entity's newest row are late: their features could not be repaired, and they go to a
    side table. Returns (features folder, late rows folder); both hold a folder for each batch,
    overwritten if the batch is run again before its state was committed."""
    from tandem.operators.incremental import FeatureState

    out = out or scratch_path(spark, "t3-out")
    late_out = out.rstrip("/") + "_late"
    ckpt = _checkpoint(out, checkpoint)
    state = FeatureState(spark, out.rstrip("/") + "_state", spec, buckets)
    keep = keep or [spec.entity]
    columns = list(dict.fromkeys([*keep, *spec.columns]))

    def apply(batch: DataFrame, batch_id: int) -> None:
        if state.table.tag("batch", -1) >= batch_id:
            return
        rows = derive(batch).select(*columns)
        features, late = state.advance(rows, {"batch": batch_id}, before_commit=lambda f, l: (
            f.write.mode("overwrite").parquet(f"{out}/batch={batch_id}"),
            l.write.mode("overwrite").parquet(f"{late_out}/batch={batch_id}")))

    stream = _files(spark.readStream.schema(schema), max_files).parquet(folder)
    _run(spark, stream.writeStream.foreachBatch(apply).option("checkpointLocation", ckpt), "t3_trailing")
    return out, late_out


# --------------------------------------------------------------------------- T4
def stream_settle(spark: SparkSession, pred_folder: str, pred_schema: T.StructType,
                  result_folder: str, result_schema: T.StructType, bound_days: int = 3,
                  out: str | None = None, checkpoint: str | None = None, seen: dict | None = None) -> str:
    """T4: stream-stream LEFT OUTER join of predictions to final results on
    (game_date, away, home) with watermarks on both sides and a time bound
    (a result within ``bound_days`` after the prediction's event time). Rows the
    join still holds open are shown by :func:`settled_view`."""
    out = out or scratch_path(spark, "t4-out")
    p = (spark.readStream.schema(pred_schema).parquet(pred_folder)
         .withColumn("p_ts", F.col("game_date").cast("timestamp"))
         .withWatermark("p_ts", f"{bound_days} days").alias("p"))
    r = (spark.readStream.schema(result_schema).parquet(result_folder)
         .withColumn("r_ts", F.col("date").cast("timestamp"))
         .withWatermark("r_ts", f"{bound_days} days").alias("r"))
    cond = ((F.col("p.game_date") == F.col("r.date")) & (F.col("p.away") == F.col("r.away"))
            & (F.col("p.home") == F.col("r.home"))
            & (F.col("r.r_ts") >= F.col("p.p_ts"))
            & (F.col("r.r_ts") <= F.col("p.p_ts") + F.expr(f"INTERVAL {bound_days} DAYS")))
    j = p.join(r, cond, "leftOuter").select(
        "p.game_date", "p.away", "p.home", "p.predicted_total",
        (F.col("r.score_home") + F.col("r.score_away")).cast("double").alias("actual_total"))
    j = j.withColumn("prediction_error", F.col("predicted_total") - F.col("actual_total"))
    _run(spark, j.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", _checkpoint(out, checkpoint)), "t4_settle", seen)
    return out


def settled_view(spark: SparkSession, out: str, predictions: DataFrame) -> DataFrame:
    """The sink of T4 plus every landed prediction it has not emitted yet (behind the
    watermark, a result may still come), with NULL results. Rows are matched as often as they
    occur: of a repeated prediction of which one is emitted, the other is still shown."""
    done = spark.read.parquet(out)
    row = ["game_date", "away", "home", "predicted_total"]
    still = predictions.select(*row).exceptAll(done.select(*row))
    return done.unionByName(still, allowMissingColumns=True)


# --------------------------------------------------------------------------- T5
def stream_period_perf(spark: SparkSession, folder: str, schema: T.StructType, time_col: str = "ts",
                       period: str = "1 day", group: list[str] | None = None, delay: str = "1 day",
                       table: str | None = None, checkpoint: str | None = None, max_files: int | None = None,
                       seen: dict | None = None) -> str:
    """T5: tumbling-window aggregates with a watermark, emitted in update mode
    and merged per micro-batch into a versioned table by the window's
    day (latest value per window and group wins): only the days a batch touches
    are read and replaced, and the table is final whatever the trigger cadence."""
    from tandem.sources.store import upsert_into

    group = group or []
    table = table or scratch_path(spark, "t5-table")
    keys = ["window_start", "window_end", *group]
    ckpt = _checkpoint(table, checkpoint)
    stored = VersionedTable(spark, table, "window_day")

    def merge(batch: DataFrame, batch_id: int) -> None:
        if stored.tag("batch", -1) >= batch_id:
            batch.write.format("noop").mode("overwrite").save()  # the stream's own state still has to move on
            return
        rows = batch.withColumns({"_batch": F.lit(batch_id).cast("long"), "window_day": F.to_date("window_start")})
        if stored.current() is None:
            stored.commit(rows.limit(0))
        upsert_into(spark, table, rows, keys, "window_day", order_col="_batch", tags={"batch": batch_id})

    ntz = isinstance(schema[time_col].dataType, T.TimestampNTZType)
    s = (_files(spark.readStream.schema(schema), max_files).parquet(folder)
         .withColumn("_event_time", F.col(time_col).cast("timestamp"))
         .withWatermark("_event_time", delay)
         .groupBy(F.window("_event_time", period), *group)
         .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum"))
         .select(F.col("window.start").cast("timestamp_ntz" if ntz else "timestamp").alias("window_start"),
                 F.col("window.end").cast("timestamp_ntz" if ntz else "timestamp").alias("window_end"),
                 *group, "events", "value_sum"))
    _run(spark, s.writeStream.outputMode("update").foreachBatch(merge)
         .option("checkpointLocation", ckpt), "t5_period", seen)
    return table


__all__ = ["land", "time_slices", "stream_upsert", "stream_dedupe", "stream_trailing", "stream_settle",
           "settled_view", "stream_period_perf"]
