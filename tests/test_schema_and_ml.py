"""Feature schema arithmetic; ridge mapping vs closed form; bad numbers; restarts."""

import numpy as np

from conftest import SF
from tandem.functions.names import matchup_feature_columns, model_feature_columns, side_feature_columns


def test_feature_names_add_up():
    side, matchup = side_feature_columns(), matchup_feature_columns()
    assert (len(side), len(matchup)) == (125, 40)
    names = ["home_" + c for c in side] + ["away_" + c for c in side] + matchup
    assert len(set(names)) == 290


def test_pipeline_has_288_model_features(spark):
    from tandem.plans.pipeline import process_events
    from tandem.sources.games import load_games
    cols = process_events(load_games(spark, SF)).columns
    assert len(model_feature_columns(cols)) == 288


def test_fold_means_and_vectors_match_brute_force(spark):
    from tandem.plans.ml import TARGET, fold_means, fold_vectors
    rng = np.random.default_rng(11)
    fold = np.repeat([None, 0, 1, 2], 10)
    x = rng.normal(size=(40, 2))
    x[rng.random((40, 2)) < 0.3] = np.nan
    x[:10, 1] = np.nan  # no value before fold 0
    rows = [(None if f is None else int(f), *(None if np.isnan(v) else float(v) for v in r), float(i))
            for i, (f, r) in enumerate(zip(fold, x))]
    df = spark.createDataFrame(rows, f"fold int, a double, b double, {TARGET} double").repartition(3)
    means = fold_means(df, ["a", "b"])
    assert sorted(means) == [0, 1, 2]
    for f in means:
        before = x[:10 * (f + 1)]
        expect = [0.0 if np.isnan(c).all() else np.nanmean(c) for c in before.T]
        assert np.allclose(means[f], expect)
    for f, train, val in fold_vectors(df, ["a", "b"]):
        for part, span in ((train, slice(0, 10 * (f + 1))), (val, slice(10 * (f + 1), 10 * (f + 2)))):
            got = {r[TARGET]: r["features"].toArray() for r in part.collect()}
            assert sorted(got) == [float(i) for i in range(40)[span]]
            for i, v in got.items():
                assert np.allclose(v, np.where(np.isnan(x[int(i)]), means[f], x[int(i)]))


def test_ridge_matches_closed_form(spark):
    from tandem.plans.ml import ridge_pipeline
    rng = np.random.default_rng(7)
    n, k, alpha = 200, 4, 1.0
    X = rng.normal(size=(n, k)) * [1, 3, 0.5, 2]
    y = X @ [1.5, -2, 0.3, 0.7] + rng.normal(size=n) * 2 + 100
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(X, y)],
                               ", ".join(f"f{i} double" for i in range(k)) + ", actual_total double")
    cols = [f"f{i}" for i in range(k)]
    model = ridge_pipeline(cols, alpha, n, float(np.std(y))).fit(df)
    pred = np.array([r["prediction"] for r in model.transform(df).select("prediction").collect()])
    # sklearn-style ridge: population-std scaling, centred, (Z'Z + alpha I) w = Z'(y - mean)
    Z = (X - X.mean(0)) / X.std(0)
    w = np.linalg.solve(Z.T @ Z + alpha * np.eye(k), Z.T @ (y - y.mean()))
    expect = Z @ w + y.mean()
    assert np.allclose(pred, expect, atol=1e-8), np.abs(pred - expect).max()


def test_staged_prediction_equals_separate_fits(spark):
    """The tree-count axis of the grid from one fit is what separate fits give."""
    import random

    from pyspark.ml.linalg import Vectors
    from tandem.plans import ml
    rng = random.Random(1)
    rows = [(Vectors.dense([rng.random(), rng.random(), rng.random()]), 10 * rng.random()) for _ in range(160)]
    made = [(v, float(3 * v[0] + v[1] * v[2] + 0.1 * y)) for v, y in rows]
    train, val = (spark.createDataFrame(part, ["features", ml.TARGET]).persist() for part in (made[:120], made[120:]))
    point = {"learning_rate": 0.2, "max_depth": 3, "subsample": 0.8, "colsample_bytree": "0.7"}
    staged = ml.staged_maes({**point, "n_estimators": 6}, [2, 4, 6], train, val)
    for k, mae in staged.items():
        assert abs(ml._mae(ml.boosted_trees({**point, "n_estimators": k}).fit(train), val) - mae) < 1e-9
    combos = [{"n_estimators": n, "max_depth": d} for n in (4, 2) for d in (3, 5)]
    assert ml.staged_groups(combos) == [({"max_depth": 3, "n_estimators": 4}, [2, 4]), ({"max_depth": 5, "n_estimators": 4}, [2, 4])]
    assert sum(1 for _ in ml.staged_groups([r.asDict() for r in ml.param_grid(spark, ml.FULL_GRID).collect()])) == 128
