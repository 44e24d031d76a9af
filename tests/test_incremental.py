"""Features from stored state equal those over the whole history, whatever the deltas."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tandem.operators.incremental import FeatureSpec, FeatureState
from tandem.operators.windows import SplitPolicy

SCHEMA = "team string, date date, is_home int, game_id long, season int, x long, y double"


def rows_of(seed, n=240):
    """Rows of few entities, one of them NULL and one with most rows; some without season or value."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        team = rng.choice(["a", "a", "a", "b", None])
        day = dt.date(2000, 1, 1) + dt.timedelta(days=i // 3)
        out.append((team, day, i % 2, i, rng.choice([None, 2000]) if team == "b" else 2000 + (i > n // 2),
                    None if rng.random() < 0.1 else rng.randint(0, 50), rng.random()))
    return out


def spec(force=False):
    return FeatureSpec(stats=["x"], std_stats=["y"], windows=[3, 5], season_stats={"season_x": "x"},
                       split=SplitPolicy(force=force, force_rows=4))


def values(df):
    cols = ["game_id", "x_roll_3", "x_roll_5", "y_std_5", "days_rest", "is_b2b", "game_num", "season_x", "season_rows"]
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_equal_to_the_whole(spark, tmp_path):
    for seed, force in ((1, False), (2, True)):
        rows = rows_of(seed)
        whole = values(spec().features(spark.createDataFrame(rows, SCHEMA)))
        state = FeatureState(spark, str(tmp_path / f"s{seed}"), spec(force), buckets=4)
        got = []
        for lo, hi in ((0, 100), (100, 101), (101, 180), (180, 240)):
            features, late = state.advance(spark.createDataFrame(rows[lo:hi], SCHEMA))
            assert late.isEmpty()
            got += values(features)
        assert sorted(got) == whole
        assert state.rows().groupBy("team").count().agg(F.max("count")).first()[0] <= 7
        counts = {r["team"]: r["n"] for r in state.rows().groupBy("team").agg(F.max("entity_rows").alias("n")).collect()}
        assert counts == {t: sum(r[0] == t for r in rows) for t in ("a", "b", None)}


def test_late_rows_apart_and_rebuilt(spark, tmp_path):
    rows = rows_of(3)
    state = FeatureState(spark, str(tmp_path / "late"), spec(), buckets=4)
    held = [r for r in rows[:120] if r[0] == "a"][5]
    state.advance(spark.createDataFrame([r for r in rows[:120] if r != held], SCHEMA))
    features, late = state.advance(spark.createDataFrame([held, *rows[120:180]], SCHEMA))
    assert [r["game_id"] for r in late.collect()] == [held[3]]
    state.rebuild(spark.createDataFrame(rows[:180], SCHEMA), late.select("team"))
    features, late = state.advance(spark.createDataFrame(rows[180:], SCHEMA))
    assert late.isEmpty()
    whole = values(spec().features(spark.createDataFrame(rows, SCHEMA)).filter("game_id >= 180"))
    assert values(features) == whole
    newest = {r["team"]: r["game_id"] for r in state.newest().collect()}
    assert newest == {t: max((r[1], -r[2], r[3]) for r in rows if r[0] == t)[2] for t in ("a", "b", None)}


def test_killed_between(spark, tmp_path):
    """A step that dies before its commit leaves the state as it was."""
    import pytest
    rows = rows_of(4)
    state = FeatureState(spark, str(tmp_path / "kill"), spec(), buckets=4)
    state.advance(spark.createDataFrame(rows[:100], SCHEMA), {"batch": 0})

    def die(features, late):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        state.advance(spark.createDataFrame(rows[100:], SCHEMA), {"batch": 1}, before_commit=die)
    assert state.table.tag("batch") == 0
    features, _ = state.advance(spark.createDataFrame(rows[100:], SCHEMA), {"batch": 1})
    assert values(features) == values(spec().features(spark.createDataFrame(rows, SCHEMA)).filter("game_id >= 100"))
    assert state.table.tag("batch") == 1
