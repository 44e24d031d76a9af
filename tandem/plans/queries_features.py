"""Queries for per-entity features (W1-W12), pairing (J1, J2), matchup
features (M1-M12) and the D6 pipeline with P7/P8/P9/S16."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions.names import (ROLLING_STATS, ROLLING_WINDOWS, VOLATILITY_STATS,
                                    matchup_feature_columns, model_feature_columns, roll_name,
                                    side_feature_columns, std_name)
from tandem.operators.longform import team_games, two_sided_long, two_sided_union
from tandem.operators.matchup import matchup_join, side_feature_columns_of
from tandem.operators.windows import (SplitPolicy, latest_per_entity, recent_n, trailing_features,
                                      ts_folds)
from tandem.plans.catalog import register
from tandem.plans.oracle import (FEAT_CTE, GAME_COLUMNS, TEAM_ORDER, feature_select, is_noisy,
                                 pair_cte, processed_ctes, project, with_ctes)
from tandem.plans.pipeline import process_events, team_features
from tandem.sources.games import load_games

KEY = ["game_id", "is_home", "team"]
LONG_COLS = ["game_id", "season", "date", "total", "team", "opponent", "is_home",
             "points_scored", "points_allowed"] + [f"{m}_{k}" for m in ("q1", "q2", "q3", "q4", "ot")
                                                   for k in ("scored", "allowed")]
DERIVED = ["total_points", "point_diff", "win", "went_to_ot", "reg_points_scored", "reg_points_allowed",
           "reg_total", "first_half_scored", "second_half_scored", "first_half_allowed", "second_half_allowed"]


def rounded(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if is_noisy(c) else F.col(c) for c in cols])


# --------------------------------------------------------------------------- P1, P2, U1
@register("P1_two_sided_long", with_ctes() + "SELECT * FROM long0")
def q_p1(spark, sf):
    return two_sided_long(load_games(spark, sf))


@register("U1_union_sides", with_ctes() + "SELECT * FROM long0")
def q_u1(spark, sf):
    return two_sided_union(load_games(spark, sf))


@register("P2_P3_row_stats", with_ctes() + f"SELECT {', '.join(KEY + DERIVED)} FROM long")
def q_p2(spark, sf):
    return team_games(load_games(spark, sf)).select(*KEY, *DERIVED)


# --------------------------------------------------------------------------- W1-W9
ROLL_COLS = [roll_name(s, w) for w in ROLLING_WINDOWS for s in ROLLING_STATS]
STD_COLS = [std_name(s, w) for w in ROLLING_WINDOWS for s in VOLATILITY_STATS]
PACE_COLS = [f"{p}_{w}" for w in ROLLING_WINDOWS for p in ("off_pace", "def_pace", "pace", "pace_diff")]
TREND_COLS = ["scoring_trend", "defense_trend", "total_trend", "win_trend"]
REST_COLS = ["days_rest", "is_b2b", "long_rest"]
SEASON_COLS = ["game_num", "season_ppg", "season_papg", "season_total_avg", "season_win_pct", "season_phase"]


def _feat_sql(cols, **kw):
    return with_ctes(f"f AS (SELECT game_id, is_home, team, {feature_select(**kw)} FROM long)") + project(KEY + cols, "f")


@register("W1_trailing_mean", _feat_sql(ROLL_COLS, std_stats=[], rest=False, season=False, pace=False, trend=False))
def q_w1(spark, sf):
    f = trailing_features(team_games(load_games(spark, sf)), std_stats=[], season_col=None,
                          rest=False, pace=False, trend=False)
    return f.select(*KEY, *ROLL_COLS)


@register("W2_trailing_std", _feat_sql(STD_COLS, stats=[], rest=False, season=False, pace=False, trend=False))
def q_w2(spark, sf):
    f = trailing_features(team_games(load_games(spark, sf)), stats=[], season_col=None,
                          rest=False, pace=False, trend=False)
    return rounded(f, KEY + STD_COLS)


@register("W3_W4_pace_trend", _feat_sql(PACE_COLS + TREND_COLS, stats=[], std_stats=[], rest=False, season=False))
def q_w3(spark, sf):
    f = trailing_features(team_games(load_games(spark, sf)),
                          stats=["points_scored", "points_allowed", "total_points", "win"], std_stats=[],
                          season_col=None, rest=False)
    return f.select(*KEY, *PACE_COLS, *TREND_COLS)


@register("W5_W6_days_rest_flags", _feat_sql(REST_COLS, stats=[], std_stats=[], season=False, pace=False, trend=False))
def q_w5(spark, sf):
    f = trailing_features(team_games(load_games(spark, sf)), stats=[], std_stats=[], windows=[],
                          season_col=None, pace=False, trend=False)
    return f.select(*KEY, *REST_COLS)


@register("W7_W8_W9_season_features", _feat_sql(SEASON_COLS, stats=[], std_stats=[], rest=False, pace=False, trend=False))
def q_w7(spark, sf):
    f = trailing_features(team_games(load_games(spark, sf)), stats=[], std_stats=[], windows=[],
                          rest=False, pace=False, trend=False)
    return f.select(*KEY, *SEASON_COLS)


SIDE = side_feature_columns()


@register("P8_side_features_all", _feat_sql(SIDE))
def q_side_all(spark, sf):
    """All 125 per-side features, selected by name pattern."""
    f = team_features(load_games(spark, sf))
    return rounded(f, KEY + side_feature_columns_of(f))


@register("W1_W9_split_forced", _feat_sql(SIDE))
def q_side_split(spark, sf):
    """Same as P8_side_features_all but every entity is split into day buckets
    with halo rows and season prefix sums (the hot-entity path)."""
    f = team_features(load_games(spark, sf), split=SplitPolicy(force=True))
    return rounded(f, KEY + side_feature_columns_of(f))


EVENT_ORDER = [("ts", True), ("event_id", True)]
EV_COLS = [f"value_roll_{w}" for w in ROLLING_WINDOWS] + [f"value_std_{w}" for w in ROLLING_WINDOWS]


@register("W1_W2_events_trailing", "WITH e AS (SELECT event_id, user_id, "
          + ", ".join([f"avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS value_roll_{w}"
                       for w in ROLLING_WINDOWS]
                      + [f"stddev_samp(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS value_std_{w}"
                         for w in ROLLING_WINDOWS]) + " FROM events) "
          + "SELECT event_id, user_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in EV_COLS) + " FROM e")
def q_events_trailing(spark, sf):
    """The same trailing operator on another table: per user over ``events``."""
    from tandem.sources.tables import read_table
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    f = trailing_features(ev, entity="user_id", order=EVENT_ORDER, stats=["value"], std_stats=["value"],
                          season_col=None, rest=False, pace=False, trend=False, date_col="ts")
    return f.select("event_id", "user_id", *[F.round(c, 6).alias(c) for c in EV_COLS])


# --------------------------------------------------------------------------- W10-W12
LATEST = ["team", "game_id", "date", "is_home", "points_scored_roll_10", "days_rest", "game_num"]


@register("W10_latest_per_entity", with_ctes(FEAT_CTE, f"r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date DESC, is_home ASC, game_id DESC) AS rn FROM feat)")
          + f"SELECT {', '.join(LATEST)} FROM r WHERE rn = 1")
def q_w10(spark, sf):
    f = trailing_features(team_games(load_games(spark, sf)), stats=["points_scored"], windows=[10],
                          std_stats=[], pace=False, trend=False)
    return latest_per_entity(f.select(*LATEST))


@register("W11_recent_n", with_ctes(f"r AS (SELECT team, game_id, date, is_home, CAST(row_number() OVER (PARTITION BY team ORDER BY date DESC, is_home ASC, game_id DESC) AS INTEGER) AS recent_rank FROM long)")
          + "SELECT * FROM r WHERE recent_rank <= 15")
def q_w11(spark, sf):
    long = two_sided_long(load_games(spark, sf), keep=["game_id", "date"], measures=["points"])
    return recent_n(long, 15).select("team", "game_id", "date", "is_home", "recent_rank")


@register("W12_ts_folds", with_ctes("p AS (SELECT game_id, date, row_number() OVER (ORDER BY date, game_id) AS position, count(*) OVER () AS n FROM games)",
                                    "f AS (SELECT *, n // 6 AS block FROM p)")
          + "SELECT game_id, date, position, CASE WHEN block > 0 AND position - 1 >= n - 5 * block "
            "THEN CAST((position - 1 - (n - 5 * block)) // block AS INTEGER) END AS fold FROM f")
def q_w12(spark, sf):
    return ts_folds(load_games(spark, sf), keep=["game_id", "date"])


# --------------------------------------------------------------------------- J1/J2, M, D6
J_COLS = ["points_scored_roll_5", "total_points_std_10", "days_rest", "game_num"]
J_OUT = ["game_id", "home", "away", "date"] + [f"{s}_{c}" for s in ("home", "away") for c in J_COLS]


@register("J1_J2_matchup_join", with_ctes(FEAT_CTE, pair_cte(J_COLS, how="reference")) + project(J_OUT, "pair"))
def q_j12(spark, sf):
    games = load_games(spark, sf)
    f = trailing_features(team_games(games), stats=["points_scored"], windows=[5, 10],
                          std_stats=["total_points"], pace=False, trend=False)
    return rounded(matchup_join(games, f, J_COLS), J_OUT)


MU = ["game_id", "actual_total", "went_over"] + matchup_feature_columns()


@register("M1_M12_matchup_features", with_ctes(*processed_ctes(sparse=False)) + project(MU, "processed"))
def q_m(spark, sf):
    return rounded(process_events(load_games(spark, sf), sparse_frac=None), MU)


D6_OUT = (["game_id", "season", "date", "home", "away", "actual_total", "went_over"]
          + ["home_points_scored_roll_3", "away_total_points_std_10", "home_days_rest", "away_game_num",
             "home_season_ppg", "away_season_phase", "home_win_trend", "combined_scoring_5",
             "expected_total_10", "line_vs_expected_15", "total_rest", "both_b2b",
             "combined_total_trend", "home_early_season", "combined_volatility_15"])


@register("D6_process_events", with_ctes(*processed_ctes()) + project(D6_OUT, "processed"))
def q_d6(spark, sf):
    """Flagship pipeline (pairing by event) incl. P7, a column subset."""
    return rounded(process_events(load_games(spark, sf)), D6_OUT)


@register("D6_process_events_reference_pairing", with_ctes(*processed_ctes(how="reference")) + project(D6_OUT, "processed"))
def q_d6_ref(spark, sf):
    """D6 with the reference's two (entity, date) joins (fans out, Q17)."""
    return rounded(process_events(load_games(spark, sf), pairing="reference"), D6_OUT)


# --------------------------------------------------------------------------- P9 + S16
def _model_features():
    from tandem.functions.names import side_feature_columns as sfc
    wide = GAME_COLUMNS + [f"home_{c}" for c in sfc()] + [f"away_{c}" for c in sfc()]
    wide += ["actual_total", "went_over"] + matchup_feature_columns()
    return model_feature_columns(wide)


MODEL_FEATURES = _model_features()


def _profile_sql():
    items = ", ".join(
        f"{{'feature': '{c}', 'non_null': CAST(count({c}) AS BIGINT), "
        f"'null_share': CAST(count(*) - count({c}) AS DOUBLE) / count(*), "
        f"'mean': round(avg({c}), 6)}}" for c in MODEL_FEATURES)
    return with_ctes(*processed_ctes()) + f"SELECT unnest([{items}], recursive := true) FROM processed"


@register("P9_S16_feature_profile", _profile_sql())
def q_profile(spark, sf):
    """P9 (features = all columns minus the exclusion list, 288) profiled in
    one aggregation (S16): non-NULL count, NULL share and mean per feature."""
    from tandem.operators.filters import select_by_exclusion
    df = process_events(load_games(spark, sf))
    feats = select_by_exclusion(df)[0]
    row = df.agg(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("non_null"),
                            ((F.count(F.lit(1)) - F.count(c)) / F.count(F.lit(1))).alias("null_share"),
                            F.round(F.avg(c), 6).alias("mean")).alias(c) for c in feats])
    return row.select(F.explode(F.array(*[F.col(c) for c in feats])).alias("_p")).select("_p.*")


# --------------------------------------------------------------------------- skewed entity
SKEW_SQL_GAMES = ("gs AS (SELECT * REPLACE (CASE WHEN game_id % 3 <> 0 AND away <> 't0' THEN 't0' ELSE home END AS home) "
                  "FROM games)")
SKEW_COLS = ["points_scored_roll_3", "points_scored_roll_15", "total_points_std_10", "days_rest",
             "game_num", "season_ppg", "season_phase"]


def _skew_sql():
    from tandem.plans.oracle import LONG_CTES
    long_sql = LONG_CTES.replace("FROM games", "FROM gs")
    f = ("f AS (SELECT game_id, is_home, team, " + feature_select(windows=(3, 10, 15),
         stats=["points_scored"], std_stats=["total_points"], pace=False, trend=False) + " FROM long)")
    from tandem.plans.oracle import GAMES_CTES
    return ("WITH " + GAMES_CTES.strip() + ",\n" + SKEW_SQL_GAMES + ",\n" + long_sql.strip() + ",\n" + f + "\n"
            + project(KEY + SKEW_COLS, "f"))


def skewed_games(spark, sf):
    """The games view with one entity ('t0') made home side of two thirds of
    the events: it holds about a third of all long rows."""
    g = load_games(spark, sf)
    return g.withColumn("home", F.when(((F.col("game_id") % 3) != 0) & (F.col("away") != "t0"), F.lit("t0"))
                        .otherwise(F.col("home")))


@register("W1_W9_hot_entity_skew", _skew_sql())
def q_skew(spark, sf):
    """Trailing and season features when one entity holds a third of the rows:
    only that entity is split (multi-day buckets with halo and season prefix)."""
    long = team_games(skewed_games(spark, sf))
    policy = SplitPolicy(hot_rows=1000, bucket_rows=500)
    f = trailing_features(long, stats=["points_scored"], windows=[3, 10, 15], std_stats=["total_points"],
                          pace=False, trend=False, split=policy)
    return rounded(f, KEY + SKEW_COLS)


def _odd_sql(games: str) -> str:
    from tandem.plans.oracle import GAMES_CTES, LONG_CTES
    f = ("f AS (SELECT game_id, is_home, team, " + feature_select(windows=(3, 10, 15),
         stats=["points_scored"], std_stats=["total_points"], pace=False, trend=False) + " FROM long)")
    return ("WITH " + GAMES_CTES.strip() + ",\n" + games + ",\n" + LONG_CTES.replace("FROM games", "FROM gs").strip() + ",\n" + f + "\n"
            + project(KEY + SKEW_COLS, "f").replace("season_ppg", "round(season_ppg, 6) AS season_ppg"))


def _odd_features(games):
    policy = SplitPolicy(hot_rows=1000, bucket_rows=500)
    f = trailing_features(team_games(games), stats=["points_scored"], windows=[3, 10, 15], std_stats=["total_points"],
                          pace=False, trend=False, split=policy)
    # a season of a third of all rows: engines add such a mean up in other orders
    return rounded(f.withColumn("season_ppg", F.round("season_ppg", 6)), KEY + SKEW_COLS)


@register("W1_W9_hot_day", _odd_sql(
    "gs AS (SELECT * REPLACE (CASE WHEN game_id % 3 <> 0 AND away <> 't0' THEN 't0' ELSE home END AS home, "
    "CASE WHEN game_id % 3 <> 0 AND away <> 't0' THEN DATE '1997-11-02' ELSE date END AS date, "
    "CASE WHEN game_id % 3 <> 0 AND away <> 't0' THEN 1998 ELSE season END AS season) FROM games)"))
def q_hot_day(spark, sf):
    """One entity holds a third of all rows on one single day: its buckets lie within the day."""
    moved = ((F.col("game_id") % 3) != 0) & (F.col("away") != "t0")
    g = load_games(spark, sf)
    return _odd_features(g.withColumns({
        "home": F.when(moved, "t0").otherwise(F.col("home")), "season": F.when(moved, 1998).otherwise(F.col("season")),
        "date": F.when(moved, F.lit("1997-11-02").cast("date")).otherwise(F.col("date"))}))


@register("W1_W9_null_entity", _odd_sql(
    "gs AS (SELECT * REPLACE (CASE WHEN game_id % 3 = 0 THEN home END AS home, "
    "CASE WHEN game_id % 11 = 0 THEN NULL ELSE season END AS season) FROM games)"))
def q_null_entity(spark, sf):
    """A third of all rows have no entity (one group, as in SQL), and some no season."""
    g = load_games(spark, sf)
    return _odd_features(g.withColumns({"home": F.when(F.col("game_id") % 3 == 0, F.col("home")),
                                        "season": F.when(F.col("game_id") % 11 != 0, F.col("season"))}))


def _completed_sql():
    body = with_ctes(*processed_ctes())
    played = "gp AS (SELECT * FROM games WHERE score_home IS NOT NULL AND score_away IS NOT NULL)"
    body = body.replace(" FROM games", " FROM gp").replace("FROM q)", "FROM q),\n" + played, 1)
    return body + project(D6_OUT, "processed")


@register("D6_process_events_completed_only", _completed_sql())
def q_d6_completed(spark, sf):
    """D6 with unplayed events removed first (P4, option for Q9)."""
    return rounded(process_events(load_games(spark, sf), completed_only=True), D6_OUT)
