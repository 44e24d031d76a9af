"""Plan shape: shared exchange for all trailing windows, no single-partition
window over row-level data, pushdown and pruning reach the scan."""

from conftest import SF
from tandem.operators.longform import team_games
from tandem.operators.windows import trailing_features, ts_folds
from tandem.sources.games import load_games


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_for_all_windows(spark):
    f = trailing_features(team_games(load_games(spark, SF)), season_col=None)
    plan = _plan(f)
    assert plan.count("Exchange hashpartitioning(team") == 1, plan


def test_season_windows_reuse_partitioning(spark):
    f = trailing_features(team_games(load_games(spark, SF)))
    assert _plan(f).count("Exchange hashpartitioning(team") == 1


def test_folds_no_single_partition_rows(spark):
    f = ts_folds(load_games(spark, SF), keep=["game_id", "date"])
    plan = _plan(f)
    # rows come from the checkpointed, range-partitioned sort; no global
    # row_number; the only single-partition step is over per-partition counts
    assert "row_number" not in plan
    assert "Scan ExistingRDD" in plan
    assert plan.count("SinglePartition") <= 1, plan


def test_scan_prunes_columns(spark):
    from tandem.operators.longform import two_sided_long
    long = two_sided_long(load_games(spark, SF), keep=["game_id"], measures=["points"])
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and "o_orderstatus" not in plan


def test_season_filter_pushed_to_partitioned_scan(spark, tmp_path):
    from pyspark.sql import functions as F
    from tandem.sources.store import scan_season, write_games
    path = str(tmp_path / "games")
    write_games(load_games(spark, SF), path)
    df = scan_season(spark.read.parquet(path), 1996)
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(season" in plan and "(season#" in plan
    assert df.count() == load_games(spark, SF).filter(F.col("season") == 1996).count()


def test_flagship_plan_shape(spark):
    """Flagship: one exchange by entity for the windows, one by event id for
    pairing, one by season for the result; no sort-based aggregation."""
    import __spark_entry__ as E
    df = E.entry(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(team") == 1
    assert plan.count("Exchange hashpartitioning(game_id") == 1
    assert plan.count("Exchange hashpartitioning(season") == 1
    assert "SortAggregate" not in plan


def test_derived_features_are_made_after_pairing(spark):
    """Both pairings give the same rows with the pace and trend features made anew, by NULL and repeated keys."""
    from pyspark.sql import functions as F

    from conftest import games_df
    from tandem.functions.names import ROLLING_STATS, ROLLING_WINDOWS
    from tandem.operators.matchup import matchup_by_event, matchup_join
    from tandem.operators.windows import derived_features
    from tandem.plans.pipeline import team_features

    rows = [(i, f"2020-11-{1 + i // 2:02d}", "ab"[i % 2], "cd"[i % 3 % 2], 100 + i, None if i == 5 else 90 + 2 * i) for i in range(12)]
    games = games_df(spark, rows).withColumn("home", F.when(F.col("game_id") != 7, F.col("home")))
    feats = team_features(games)
    derived = lambda side: derived_features(ROLLING_STATS, ROLLING_WINDOWS, side=side)
    assert {"pace_diff_15", "off_pace_3", "scoring_trend"} <= set(derived(""))
    for pair in (matchup_join, matchup_by_event):
        plain, anew = pair(games, feats), pair(games, feats, derived=derived)
        assert anew.schema.names == plain.schema.names
        assert sorted(map(repr, anew.collect())) == sorted(map(repr, plain.collect()))


def test_two_phase_serving_moves_only_rows_near_a_match(spark, monkeypatch):
    """Of the whole history, rows that no match needs are left out before the wide rows are joined."""
    from tandem.operators.longform import team_games
    from tandem.operators.windows import SplitPolicy
    from tandem.plans import jobs as J
    from tandem.plans.pipeline import team_features
    from tandem.plans.queries_sources import _slate

    games, slate = _slate(spark, SF)
    long, moved, real = team_games(games), [], J.marked_rows

    def spy(rows, cols, *marks):
        moved.append(real(rows, cols, *marks))
        return moved[-1]
    monkeypatch.setattr(J, "marked_rows", spy)
    forced = SplitPolicy(force=True)
    out = ["game_id", "home_points_scored_roll_10", "away_game_num", "home_days_rest"]
    get = lambda df: sorted(map(repr, df.select(*out).collect()))
    served = J.serve_from_history(slate, long, split=forced)
    assert len(moved) == 1 and moved[0].count() < long.count() / 2
    assert get(served) == get(J.serve_features(slate, team_features(games)))
