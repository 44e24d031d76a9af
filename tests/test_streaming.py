"""Streams equal their batch counterparts on the same, time-ordered input."""

from pyspark.sql import functions as F

from conftest import SF


def _rows(df, cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_stateful_trailing_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    cols = ["event_id", "user_id"] + [f"value_{k}_{w}" for w in (3, 5, 10, 15) for k in ("roll", "std")]
    assert _rows(q["T3_stream_trailing_features"](spark, SF), cols) == _rows(q["W1_W2_events_trailing"](spark, SF), cols)


def test_streamed_upsert_equals_batch_ingest(spark):
    import __spark_entry__ as E
    q = E.queries()
    a, b = q["T1_stream_upsert"](spark, SF), q["D2_S4_ingest_feed"](spark, SF)
    assert _rows(a, a.columns) == _rows(b, a.columns)


def test_dedupe_keeps_one_copy(spark):
    import __spark_entry__ as E
    from tandem.sources.tables import read_table
    out = E.queries()["T2_stream_dedupe"](spark, SF)
    ev = read_table(spark, SF, "events")
    assert out.count() == ev.select("event_id").distinct().count()
    assert out.groupBy("event_id").count().filter(F.col("count") > 1).count() == 0


def test_dedupe_state_is_bounded(spark):
    """Keys behind the watermark leave the state, and copies that come after are counted as late."""
    from tandem.plans.queries_stream import dedupe_run
    from tandem.sources.tables import read_table
    seen = {}
    out = dedupe_run(spark, SF, seen=seen)
    ev = read_table(spark, SF, "events")
    total = ev.count()
    span = ev.agg(F.max("ts").alias("hi")).first()["hi"]
    import datetime as dt
    recent = ev.filter(F.col("ts") >= F.lit(span - dt.timedelta(days=15))).count()
    assert out.count() == total
    assert 0 < seen["state_rows"] <= recent < total
    assert seen["late"] >= ev.count() // 5


def test_late_rows_go_to_a_side_table(spark, tmp_path):
    from tandem.plans.queries_stream import EVENT_SPEC, with_week
    from tandem.sources.tables import read_table
    from tandem.streaming import streams as T
    ev = read_table(spark, SF, "events")
    folder, out = str(tmp_path / "land"), str(tmp_path / "out")
    parts = T.time_slices(ev, "ts", 3)
    for part in (parts[0], parts[2], parts[1]):   # the middle comes last
        T.land(part, folder, "ts")
        _, late = T.stream_trailing(spark, folder, ev.schema, EVENT_SPEC, out=out, keep=["event_id", "user_id"], derive=with_week)
    newest = parts[2].select("user_id").distinct()
    expected = {r["event_id"] for r in parts[1].join(newest, "user_id", "left_semi").select("event_id").collect()}
    assert {r["event_id"] for r in spark.read.parquet(late).select("event_id").collect()} == expected
    assert spark.read.parquet(out).count() + len(expected) == ev.count()


def test_batch_that_runs_again_applies_once(spark, tmp_path):
    """The checkpoint is lost after the commit: the same batch comes again and is skipped."""
    import shutil
    from tandem.sources.tables import read_table
    from tandem.sources.versions import VersionedTable
    from tandem.streaming import streams as T
    ev = read_table(spark, SF, "events")
    folder, table = str(tmp_path / "land"), str(tmp_path / "table")
    T.land(ev, folder, "ts")
    T.stream_period_perf(spark, folder, ev.schema, group=["event_type"], table=table)
    stored = VersionedTable(spark, table, "window_day")
    number, total = stored.current().number, stored.read().agg(F.sum("events")).first()[0]
    shutil.rmtree(table + "_checkpoint")
    T.stream_period_perf(spark, folder, ev.schema, group=["event_type"], table=table)
    assert stored.current().number == number and stored.read().agg(F.sum("events")).first()[0] == total == ev.count()


def test_repeated_prediction_is_not_hidden(spark, tmp_path):
    import datetime as dt
    from tandem.streaming import streams as T
    schema = "game_date date, away string, home string, predicted_total double"
    rows = [(dt.date(2000, 1, 1), "a", "b", 200.0)] * 2 + [(dt.date(2000, 1, 1), "a", "b", 201.0)]
    preds = spark.createDataFrame(rows, schema)
    out = str(tmp_path / "out")
    spark.createDataFrame([(*rows[0], 190.0, 10.0)], schema + ", actual_total double, prediction_error double").write.parquet(out)
    seen = T.settled_view(spark, out, preds).collect()
    assert sorted((r["predicted_total"], r["actual_total"]) for r in seen if r["actual_total"]) == [(200.0, 190.0)]
    assert sorted(r["predicted_total"] for r in seen if r["actual_total"] is None) == [200.0, 201.0]
