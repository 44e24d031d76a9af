"""Commits are all or nothing: a killed writer leaves the old table, NULL partitions survive."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import games_df
from tandem.plans import jobs as J
from tandem.sources import store as S
from tandem.sources import versions as V

SCHEMA = "k long, season int, v string"


def table_of(spark, tmp_path, rows):
    return S.create_table(spark, str(tmp_path / "t"), spark.createDataFrame(rows, SCHEMA))


def content(table, number=None):
    return sorted((tuple(r) for r in table.read(number).collect()), key=str)


def test_null_partition_survives(spark, tmp_path):
    t = table_of(spark, tmp_path, [(1, 2000, "a"), (2, None, "b"), (3, None, "c")])
    delta = spark.createDataFrame([(4, None, "d"), (5, 2001, "e")], SCHEMA)
    done = S.upsert_into(spark, t.path, delta, ["k"])
    assert content(t) == sorted([(1, 2000, "a"), (2, None, "b"), (3, None, "c"), (4, None, "d"), (5, 2001, "e")], key=str)
    assert done["from_delta"] == 2 and done["rows"] == 4 and set(done["partitions"]) == {None, 2001}


def test_key_moves_between_partitions(spark, tmp_path):
    t = table_of(spark, tmp_path, [(1, 2000, "a"), (2, None, "b"), (3, None, "c"), (6, 1999, "f")])
    S.upsert_into(spark, t.path, spark.createDataFrame([(2, 2001, "B")], SCHEMA), ["k"])      # its season became known
    S.upsert_into(spark, t.path, spark.createDataFrame([(1, None, "A")], SCHEMA), ["k"])      # not known in the delta
    assert content(t) == sorted([(1, None, "A"), (2, 2001, "B"), (3, None, "c"), (6, 1999, "f")], key=str)


def test_killed_upsert_leaves_the_old_table(spark, tmp_path, monkeypatch):
    t = table_of(spark, tmp_path, [(1, 2000, "a"), (2, 2001, "b")])
    delta = spark.createDataFrame([(1, 2000, "A"), (3, None, "c")], SCHEMA)
    before = content(t)
    monkeypatch.setattr(V.VersionedTable, "_publish", lambda self, m: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):          # rows are written, the version is not
        S.upsert_into(spark, t.path, delta, ["k"])
    assert content(t) == before
    monkeypatch.undo()
    # killed while it wrote the manifest: half of a file
    V._create_text(spark, f"{t.path}/versions/{2:012d}.json", '{"schema": {"type"')
    assert content(t) == before and t.current().number == 1
    S.upsert_into(spark, t.path, delta, ["k"])
    assert content(t) == sorted([(1, 2000, "A"), (2, 2001, "b"), (3, None, "c")], key=str)
    assert t.current().number == 3 and content(t, 1) == before


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    t = table_of(spark, tmp_path, [(1, 2000, "a"), (2, 2001, "b")])
    first = t.current().folders
    S.upsert_into(spark, t.path, spark.createDataFrame([(3, 2001, "c")], SCHEMA), ["k"])
    assert t.current().folders["season=2000"] == first["season=2000"]
    assert t.current().folders["season=2001"] != first["season=2001"]
    S.upsert_into(spark, t.path, spark.createDataFrame([(4, 2001, "d")], SCHEMA), ["k"])
    assert len(t.vacuum(keep=1)) == 1               # the first commit still holds season 2000
    assert content(t) == sorted([(1, 2000, "a"), (2, 2001, "b"), (3, 2001, "c"), (4, 2001, "d")], key=str)
    assert S.upsert_into(spark, t.path, spark.createDataFrame([], SCHEMA), ["k"])["version"] is None


def test_two_writers(spark, tmp_path):
    t = table_of(spark, tmp_path, [(1, 2000, "a")])
    other = V.VersionedTable(spark, t.path)
    stale = other.current()
    t.commit(spark.createDataFrame([(2, 2001, "b")], SCHEMA), [])
    calls = iter([stale, t.current()])
    other.current = lambda number=None: next(calls)  # it read before the other committed
    with pytest.raises(V.ConcurrentCommit):
        other.commit(spark.createDataFrame([(3, 2001, "c")], SCHEMA), [])
    with pytest.raises(V.ConcurrentCommit):
        t._publish(t.current())                      # the number is taken
    assert content(t) == [(1, 2000, "a"), (2, 2001, "b")]


def test_empty_table_and_pruning(spark, tmp_path):
    t = S.create_table(spark, str(tmp_path / "e"), spark.createDataFrame([], SCHEMA))
    assert content(t) == [] and t.read().columns == ["k", "season", "v"]
    t.commit(spark.createDataFrame([(1, 2000, "a"), (2, None, "b")], SCHEMA), [])
    plan = t.read().filter("season = 2000")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    assert t.read().filter("season is null").collect()[0]["k"] == 2


def landing(spark, path, games):
    from tandem.sources.feeds import landing_from_games, read_boxscore, read_scoreboard
    paths = landing_from_games(games, path, ("scoreboard", "boxscore"))
    return read_scoreboard(spark, paths["scoreboard"]), read_boxscore(spark, paths["boxscore"])


def test_backfill_takes_open_days_only(spark, tmp_path):
    rows = [(1, "1999-01-01", "t1", "t2", 90, 100), (2, "1999-01-02", "t2", "t3", 80, 70), (3, "1999-01-02", "t4", "t5", None, None),
            (4, "2001-02-01", "t1", "t3", 60, 50)]
    games = games_df(spark, rows)
    dim = spark.createDataFrame([(f"T{i}", f"t{i}", i, f"n{i}") for i in range(9)],
                                "external_code string, code string, feed_id long, full_name string")
    sb, bx = landing(spark, str(tmp_path / "one"), games)
    table = S.create_table(spark, str(tmp_path / "games"), games.limit(0))
    ledger = str(tmp_path / "ledger")
    first = {str(r["date"]): (r["games_added"], r["pending"]) for r in
             J.backfill(spark, table.path, ledger, sb, bx, dim, "1998-12-31", "1999-01-02").collect()}
    assert first == {"1998-12-31": (0, True), "1999-01-01": (1, True), "1999-01-02": (1, True)}
    files = table.current().folders["season=1999"]
    # the open game of the second day is over now; the first day's feed changes, but that day is done
    sb, bx = landing(spark, str(tmp_path / "two"), games_df(spark, [
        (1, "1999-01-01", "t1", "t2", 1, 1), *rows[1:2], (3, "1999-01-02", "t4", "t5", 7, 8), rows[3]]))
    second = {str(r["date"]): r["games_added"] for r in
              J.backfill(spark, table.path, ledger, sb, bx, dim, "1999-01-01", "1999-01-02").collect()}
    assert second == {"1999-01-01": 0, "1999-01-02": 2}
    got = {r["game_id"]: (r["score_away"], r["score_home"]) for r in table.read().collect()}
    assert got == {1: (90, 100), 2: (80, 70), 3: (7, 8)}
    files2 = table.current().folders["season=1999"]
    assert files2 != files
    J.backfill(spark, table.path, ledger, sb, bx, dim, "1999-01-01", "2001-02-01")
    assert table.current().folders["season=1999"] == files2 and table.read().count() == 4


def test_settlement_counts(spark, tmp_path):
    games = games_df(spark, [(1, "1999-01-01", "t1", "t2", 90, 100), (2, "1999-01-05", "t1", "t2", 80, 70),
                             (3, "1999-02-05", "t1", "t2", None, None), (4, "1999-03-01", "t1", "t2", 1, 2)])
    day = lambda s: dt.date.fromisoformat(s)
    preds = spark.createDataFrame([(day("1999-01-01"), "t1", "t2", 200.0), (day("1999-01-01"), "t1", "t2", 201.0),
                                   (day("1999-01-05"), "t1", "t2", 150.0), (day("1999-02-05"), "t1", "t2", 9.0),
                                   (day("1999-03-01"), "t1", "t2", 9.0)],
                                  "game_date date, away string, home string, predicted_total double")
    log = str(tmp_path / "log")
    S.log_predictions(spark, log, preds)
    table = V.VersionedTable(spark, log, "game_month")
    march = table.current().folders["game_month=1999-03"]
    assert J.settle_into(spark, log, games, "1999-01-01", "1999-02-10") == {"games_settled": 2, "predictions_updated": 3}
    assert table.current().folders["game_month=1999-03"] == march
    assert table.read().filter(F.col("actual_total").isNotNull()).count() == 3
    assert J.settle_into(spark, log, games, "1999-03-01", None) == {"games_settled": 1, "predictions_updated": 1}
    assert table.read().agg(F.sum("prediction_error")).first()[0] == 10 + 11 + 0 + 6


def test_evaluation_is_one_scan(spark):
    """All breakdowns from one scan of the scored rows."""
    rows = [(2000, dt.date(2000, 1, 1 + i % 28), 200.0 + i % 13, 190.0 + i % 30, 195.0 + i % 7) for i in range(100)]
    path_rows = spark.createDataFrame(rows, "season int, date date, prediction double, actual_total double, total double")
    plan = J.evaluate_job(path_rows, [2000])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1, plan
    empty = {(r["part"], r["key"]): r["bets"] for r in J.evaluate_job(path_rows, [1990]).collect()}
    assert empty == {("all", None): 0, ("side", "OVER"): 0, ("side", "UNDER"): 0}
