"""Steps that wide rows pass once: scored logs, fold tags, column sums, state rows."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from conftest import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prediction_log_is_scored_once(spark):
    from tandem.plans.queries_eval import scored_frame
    from tandem.plans.queries_sources import _prediction_log
    log, scored = _prediction_log(spark, SF), scored_frame(spark, SF)
    assert "Window" not in _plan(log)
    latest = scored.agg(F.max("season")).first()[0]
    assert log.count() == scored.count() + scored.filter(F.col("season") == latest).count()


def test_daily_update_lands_the_feeds_it_reads(spark, monkeypatch):
    from tandem.plans import queries_jobs, queries_sources
    landed, land = [], queries_sources.landing_from_games
    monkeypatch.setattr(queries_sources, "landing_from_games",
                        lambda games, path, feeds: landed.append(feeds) or land(games, path, feeds))
    assert queries_jobs.q_daily(spark, SF).count() == 1
    assert landed == [("scoreboard", "boxscore")]


def _events(spark, n, ids=None):
    rows = [(i if ids is None else ids[i], dt.date(2000, 1, 1) + dt.timedelta(days=i * 7 % 11), float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "game_id long, date date, v double").repartition(3)


def test_fold_tags_leave_the_rows_where_they_are(spark):
    from tandem.operators.windows import ts_folds
    from tandem.plans.ml import with_folds
    from tandem.sources.store import written
    for ids in (None, [None, 3, 3] + list(range(3, 40)), [None] * 5 + list(range(35))):
        df = written(_events(spark, 40, ids), "fold-test")
        tags = ts_folds(df, order=[("date", True), ("game_id", True)], keep=["game_id", "date"])
        want = df.join(tags.select("game_id", "fold"), "game_id").select("game_id", "v", "fold")
        got = with_folds(df)
        assert got.select("game_id", "v", "fold").exceptAll(want).isEmpty() and got.count() == want.count()
        assert "Exchange" not in _plan(got)
    few = with_folds(_events(spark, 3))
    assert [r["fold"] for r in few.collect()] == [None] * 3


def test_column_sums_and_boosted_fit(spark):
    from tandem.plans import ml
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    rows = [(i % 3 if i % 4 else None, *(None if rng.random() < 0.2 else float(v) for v in r), None, float(r[0] * 3 + r[1]))
            for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, f"fold int, a double, b double, c double, d double, {ml.TARGET} double").repartition(4).cache()
    cols = ["a", "b", "c", "d"]
    got = ml.column_sums(df, cols, "fold")
    for r in df.groupBy("fold").agg(*[f(c) for f in (F.sum, F.count) for c in cols]).collect():
        sums, counts = got[r["fold"]]
        assert np.allclose(sums, [v or 0.0 for v in r[1:5]]) and list(counts) == list(r[5:])
    assert ml.column_sums(df.limit(0), cols) == {}
    assert ml.usable_features(df, cols) == ["a", "b", "c"]
    params = {"n_estimators": 3, "max_depth": 3, "subsample": 1.0, "colsample_bytree": "all"}
    new, old = ml.fit_boosted(df, cols, params), ml.gbt_pipeline(["a", "b", "c"], params).fit(df)
    assert new.stages[0].getInputCols() == ["a", "b", "c"]
    each = [m.transform(df).orderBy(ml.TARGET).toPandas()["prediction"] for m in (new, old)]
    assert np.allclose(*each)


def test_state_rows_stay_dealt_by_entity(spark, tmp_path):
    from tandem.operators.incremental import FeatureSpec, FeatureState
    spec = FeatureSpec(stats=["v"], rest=False, season_stats={"season_v": "v"})
    rows = spark.range(60).select(F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("team"), F.lit(2000).alias("season"),
                                  F.date_add(F.lit(dt.date(2000, 1, 1)), F.col("id").cast("int")).alias("date"),
                                  (F.col("id") % 2).cast("int").alias("is_home"), F.col("id").alias("game_id"), F.col("id").alias("v"))
    state = FeatureState(spark, str(tmp_path / "state"), spec)
    assert _plan(state._marked(spec.features(rows))).count("Exchange hash") == 1
