"""The hot-entity path (day buckets + halo + season prefix) equals the plain
per-entity windows; mixed hot / not-hot entities in one plan."""

from pyspark.sql import functions as F

from conftest import SF
from tandem.operators.longform import team_games, two_sided_long
from tandem.operators.windows import SplitPolicy, asof_latest, hot_entities, trailing_features
from tandem.sources.games import load_games

KEY = ["game_id", "is_home"]


def _rows(df, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_split_equals_plain(spark):
    long = team_games(load_games(spark, SF))
    plain = trailing_features(long)
    cols = KEY + [c for c in plain.columns if c.endswith(("_roll_3", "_roll_15", "_std_10"))] + [
        "days_rest", "game_num", "season_ppg", "season_win_pct", "season_phase"]
    # a policy under which some entities are hot and others are not
    mixed = SplitPolicy(hot_rows=22, max_hot=100000, bucket_rows=3)
    hot = hot_entities(long, "team", mixed)
    assert 0 < len(hot) < long.select("team").distinct().count()
    assert max(hot.values()) > 1          # multi-day buckets
    for policy in (mixed, SplitPolicy(force=True)):
        assert _rows(trailing_features(long, split=policy), cols) == _rows(plain, cols)


def test_hot_list_is_bounded(spark):
    long = team_games(load_games(spark, SF))
    assert len(hot_entities(long, "team", SplitPolicy(hot_rows=0, max_hot=7))) < 7


def test_asof_split_equals_plain(spark):
    long = two_sided_long(load_games(spark, SF), keep=["game_id", "date"], measures=["points"])
    left = long.select("team", F.date_add("date", 1).alias("date"), F.col("game_id").alias("lid"))
    plain = asof_latest(left, long, "team", ["game_id", "points_scored"])
    forced = asof_latest(left, long, "team", ["game_id", "points_scored"], split=SplitPolicy(force=True))
    get = lambda d: sorted((r["lid"], r["team"], r["asof"]["game_id"] if r["asof"] else None) for r in d.collect())
    assert get(plain) == get(forced)


def test_chunked_windows_equal_sliding_frames(spark):
    """Means and deviations put together from chunks equal Spark's own frames, by NULLs, repeats and odd windows."""
    from pyspark.sql import Window

    from tandem.functions.names import roll_name, std_name

    rows = [("a", i, None if i % 5 == 2 else (i * 37) % 101, 1e9 + (i * 13) % 7 if i % 4 else None) for i in range(60)]
    rows += [("b", i, 7, 0.1) for i in range(9)] + [(None, i, None, None) for i in range(5)] + [("c", 1, 3, 2.5)]
    df = spark.createDataFrame(rows, "team string, n int, x long, y double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), "n"))
    order, windows = [("date", True)], [1, 2, 3, 5, 10, 15, 17]
    for inclusive in (False, True):
        got = trailing_features(df, order=order, stats=["x", "y"], std_stats=["x", "y"], windows=windows, season_col=None,
                                rest=False, pace=False, trend=False, inclusive=inclusive)
        w = Window.partitionBy("team").orderBy("date")
        frame = lambda k: w.rowsBetween(1 - k, 0) if inclusive else w.rowsBetween(-k, -1)
        want = df.select("team", "n", *[c for k in windows for s in ("x", "y") for c in (
            F.avg(s).over(frame(k)).alias(roll_name(s, k)), F.stddev_samp(s).over(frame(k)).alias(std_name(s, k)))])
        expected = {(r.team, r.n): r.asDict() for r in want.collect()}
        assert got.count() == len(rows)
        for r in got.collect():
            for name, value in expected[r.team, r.n].items():
                here = r[name]
                assert here == value if value is None or isinstance(value, str) else abs(here - value) <= 1e-6 * max(1, abs(value)), (name, here, value)


def test_means_fetch_earlier_rows_once(spark):
    """No frame slides over the rows of a window for each statistic: longer windows cost no more aggregates."""
    long = team_games(load_games(spark, SF))
    plan = trailing_features(long)._jdf.queryExecution().executedPlan().toString()
    assert "avg(" not in plan and "stddev" not in plan


def test_split_features_meet_season_sums_where_they_are(spark):
    """The wide rows are not shuffled for the season sums, nor the hot rows for their numbers, whatever the size."""
    long = team_games(load_games(spark, SF))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = trailing_features(long, split=SplitPolicy(force=True))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin [_part" in plan
    below = plan[plan.index("SortMergeJoin [_ek"):]
    assert 0 < below.index("Window [") < below.index("Exchange ")


def test_split_equals_plain_with_repeated_rows(spark):
    """A row that comes twice may lie on both sides of a bucket's edge."""
    rows = [("a", i, i * 37 % 101) for i in range(40)] * 2
    df = spark.createDataFrame(rows, "team string, n int, x long").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), "n"))
    get = lambda split: _rows(trailing_features(df, order=[("date", True)], stats=["x"], std_stats=[], windows=[3, 5], season_col=None,
                                                pace=False, trend=False, split=split),
                              ["team", "n", "days_rest", "x_roll_3", "x_roll_5"])
    assert get(SplitPolicy(force=True)) == get(SplitPolicy())
