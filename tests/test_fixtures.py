"""Hand-computed micro fixtures (NULL, tie, rest, season, push and upsert rules)."""

import math

from pyspark.sql import functions as F

from conftest import games_df
from tandem.operators.evaluate import bet_outcomes
from tandem.operators.longform import team_games
from tandem.operators.windows import ts_folds, trailing_features


def _team(spark, rows, team="a", **kw):
    f = trailing_features(team_games(games_df(spark, rows)), **kw)
    return [r.asDict() for r in f.filter(F.col("team") == team).orderBy("date", F.desc("is_home"), "game_id").collect()]


def test_first_and_second_event(spark):
    rows = [(1, "2020-01-01", "b", "a", 100, 110), (2, "2020-01-03", "c", "a", 90, 95)]
    r = _team(spark, rows)
    assert r[0]["points_scored_roll_3"] is None and r[0]["total_points_std_3"] is None
    assert (r[0]["days_rest"], r[0]["is_b2b"], r[0]["long_rest"], r[0]["game_num"]) == (3, 0, 0, 1)
    assert r[1]["points_scored_roll_3"] == 110.0 and r[1]["total_points_std_3"] is None


def test_null_inside_window(spark):
    # team a scores 1, NULL, 5, 7 (a NULL score = unplayed event)
    rows = [(1, "2020-01-01", "b", "a", 0, 1), (2, "2020-01-02", "b", "a", None, None),
            (3, "2020-01-03", "b", "a", 0, 5), (4, "2020-01-04", "b", "a", 0, 7)]
    r = _team(spark, rows, windows=[3])
    assert [x["points_scored_roll_3"] for x in r] == [None, 1.0, 1.0, 3.0]
    assert [x["points_scored_std_3"] for x in r][:3] == [None, None, None]
    assert math.isclose(r[3]["points_scored_std_3"], 2.828427, abs_tol=1e-6)
    # unplayed event: win 0, counted in game_num
    assert r[1]["win"] == 0 and r[1]["game_num"] == 2


def test_rest_days(spark):
    rows = [(1, "2020-01-01", "b", "a", 1, 2), (2, "2020-01-02", "b", "a", 1, 2), (3, "2020-01-06", "b", "a", 1, 2)]
    r = _team(spark, rows)
    assert [x["days_rest"] for x in r] == [3, 1, 4]
    assert [x["is_b2b"] for x in r] == [0, 1, 0]
    assert [x["long_rest"] for x in r] == [0, 0, 1]


def test_season_switch(spark):
    rows = [(1, "2020-09-30", "b", "a", 1, 10), (2, "2020-10-01", "b", "a", 1, 20)]
    r = _team(spark, rows)
    assert r[1]["season"] == r[0]["season"] + 1
    assert r[1]["game_num"] == 1 and r[1]["season_ppg"] is None
    assert r[1]["points_scored_roll_3"] == 10.0  # trailing windows cross seasons


def test_phase(spark):
    import datetime as dt
    base = dt.date(2020, 10, 20)
    rows = [(i, (base + dt.timedelta(days=i)).isoformat(), "b", "a", 1, 2) for i in range(1, 102)]
    r = _team(spark, rows)
    phase = {x["game_num"]: x["season_phase"] for x in r}
    assert [phase[n] for n in (25, 26, 55, 56, 100, 101)] == ["early", "mid", "mid", "late", "late", None]


def test_same_date_home_first(spark):
    rows = [(2, "2020-01-01", "a", "c", 10, 11), (1, "2020-01-01", "b", "a", 20, 30), (3, "2020-01-02", "d", "a", 1, 2)]
    r = _team(spark, rows)
    assert [x["is_home"] for x in r[:2]] == [1, 0]      # home row first on a tie
    assert r[2]["points_scored_roll_3"] == (30 + 10) / 2


def test_push_and_null_line_rules(spark):
    df = spark.createDataFrame([(201.0, 200.0, 200.0), (199.0, 200.0, 200.0), (190.0, 180.0, None)],
                               "prediction double, actual_total double, total double")
    ref = bet_outcomes(df).first()
    # push with OVER pick: neither; push with UNDER pick: win; NULL line: win
    assert (ref["bets"], ref["wins"], ref["pushes"], ref["losses"]) == (3, 2, 2, -1)
    void = bet_outcomes(df, push_policy="void").first()
    assert (void["bets"], void["wins"], void["pushes"], void["losses"]) == (2, 0, 2, 0)


def test_rounding_half_even(spark):
    from tandem.functions.scalars import round1
    v = spark.range(1).select(round1(F.lit(2.25)).alias("r")).first()["r"]
    assert v == 2.2


def test_upsert_modes(spark):
    from tandem.sources.store import upsert_latest
    base = spark.createDataFrame([("2020-01-01", "a", "b", 1, 200.0)], "date string, away string, home string, game_id long, total double")
    delta = spark.createDataFrame([("2020-01-01", "a", "b", 2, None)], "date string, away string, home string, game_id long, total double")
    ref = upsert_latest(base, delta, ["date", "away", "home"]).first()
    keep = upsert_latest(base, delta, ["date", "away", "home"], coalesce_old=True).first()
    assert ref["total"] is None and ref["game_id"] == 2
    assert keep["total"] == 200.0 and keep["game_id"] == 2


def test_folds_n20(spark):
    import datetime as dt
    df = spark.createDataFrame([(i, dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(20)], "game_id long, date date")
    f = {r["game_id"]: r["fold"] for r in ts_folds(df).collect()}
    starts = [min(g for g, k in f.items() if k == i) for i in range(5)]
    assert starts == [5, 8, 11, 14, 17]
    assert all(f[g] is None for g in range(5))


def test_serving_modes(spark):
    """Reference mode uses the latest row's pre-game features; post-game mode
    includes that game and counts rest to the scheduled date."""
    import datetime as dt
    from tandem.plans.jobs import serve_features
    rows = [(1, "2020-01-01", "b", "a", 90, 100), (2, "2020-01-03", "a", "b", 110, 95)]
    games = games_df(spark, rows)
    slate = spark.createDataFrame([("g9", dt.date(2020, 1, 6), "b", "a")], "game_id string, game_date date, away string, home string")
    ref = serve_features(slate, trailing_features(team_games(games))).first()
    post = serve_features(slate, trailing_features(team_games(games), inclusive=True), post_game=True).first()
    assert (ref["home_points_scored_roll_3"], ref["home_days_rest"], ref["home_game_num"]) == (100.0, 2, 2)
    assert (post["home_points_scored_roll_3"], post["home_days_rest"], post["home_game_num"]) == (105.0, 3, 3)
    assert post["home_season_ppg"] == 105.0 and post["home_is_b2b"] == 0


def test_edge_sweep_brute_force(spark):
    """Suffix sums over edge levels equal a direct count per threshold."""
    import random
    from tandem.operators.evaluate import edge_sweep
    rnd = random.Random(3)
    rows = [(200 + rnd.uniform(-14, 14), float(rnd.randint(180, 230)), rnd.choice([None, 200.0, 205.5, 199.0]))
            for _ in range(400)]
    df = spark.createDataFrame(rows, "prediction double, actual_total double, total double")
    for ths in ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [2, 5, 9]):
        got = {r["min_edge"]: (r["bets"], r["wins"]) for r in edge_sweep(df, thresholds=ths).collect()}
        want = {}
        for t in ths:
            sel = [(p, y, l) for p, y, l in rows if l is not None and abs(p - l) >= t]
            wins = sum(1 for p, y, l in sel if (p > l) == (y > l))
            if sel:
                want[t] = (len(sel), wins)
        assert got == want, (ths, got, want)
