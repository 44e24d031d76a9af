"""Evaluation queries (A1-A19, O1, O2, O4, U2, L1/L2 splits) over a scored
frame whose prediction is the matchup estimate ``expected_total_10`` (M5),
so every metric is checkable against DuckDB without a fitted model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tandem.operators import evaluate as ev
from tandem.operators.longform import two_sided_long
from tandem.operators.matchup import over_under_features, pair_sides
from tandem.operators.windows import trailing_features, ts_folds
from tandem.plans.catalog import register
from tandem.plans.oracle import TEAM_ORDER, with_ctes
from tandem.sources.games import load_games

WINDOWS = [3, 5, 10, 15]
ALPHAS = [0.0, 0.25, 0.5, 0.75, 1.0]


def scored_frame(spark, sf, windows=(10,), primary=10):
    """Events with ``prediction`` = expected_total_<primary>, where present."""
    games = load_games(spark, sf)
    long = two_sided_long(games, keep=["game_id", "season", "date", "total"], measures=["points"])
    feats = trailing_features(long, stats=["points_scored", "points_allowed"], windows=list(windows),
                              std_stats=[], season_col=None, rest=False, pace=False, trend=False)
    cols = [f"points_{k}_roll_{w}" for w in windows for k in ("scored", "allowed")]
    paired = pair_sides(feats, cols, carry=["season", "date", "total"], side_carry=["team", "points_scored"])
    m = over_under_features(paired.withColumnsRenamed({"home_points_scored": "score_home",
                                                       "away_points_scored": "score_away"}), list(windows))
    return (m.withColumn("prediction", F.col(f"expected_total_{primary}"))
            .filter(F.col("prediction").isNotNull()))


def _scored_sql(windows=(10,), primary=10):
    sel = ", ".join(
        f"avg(points_{k}) OVER (PARTITION BY team {TEAM_ORDER} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS {k[0]}{w}"
        for w in windows for k in ("scored", "allowed"))
    exp = ", ".join(f"(h.s{w} + a.a{w}) / 2 + (a.s{w} + h.a{w}) / 2 AS expected_total_{w}" for w in windows)
    return [f"f AS (SELECT game_id, is_home, {sel} FROM long)",
            f"s0 AS (SELECT g.game_id, g.season, g.date, g.total, g.home, g.away, "
            f"g.score_home + g.score_away AS actual_total, {exp} FROM games g "
            f"JOIN f h ON h.game_id = g.game_id AND h.is_home = 1 JOIN f a ON a.game_id = g.game_id AND a.is_home = 0)",
            f"scored AS (SELECT *, expected_total_{primary} AS prediction FROM s0 WHERE expected_total_{primary} IS NOT NULL)"]


SCORED = _scored_sql()


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


# --------------------------------------------------------------------------- A5-A7, A14, A15
@register("A5_A6_A7_error_metrics", with_ctes(*SCORED) + """
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(abs(prediction - actual_total)), 6) AS mae,
  round(sqrt(avg((prediction - actual_total) * (prediction - actual_total))), 6) AS rmse,
  round(1 - sum((actual_total - prediction) * (actual_total - prediction)) / (var_pop(actual_total) * count(actual_total)), 6) AS r2
FROM scored WHERE actual_total IS NOT NULL""")
def q_err(spark, sf):
    return ev.error_metrics(scored_frame(spark, sf)).select("n", *r6("mae", "rmse", "r2"))


@register("A5_error_metrics_by_season", with_ctes(*SCORED) + """
SELECT season, CAST(count(*) AS BIGINT) AS n, round(avg(abs(prediction - actual_total)), 6) AS mae,
  round(sqrt(avg((prediction - actual_total) * (prediction - actual_total))), 6) AS rmse,
  round(1 - sum((actual_total - prediction) * (actual_total - prediction)) / (var_pop(actual_total) * count(actual_total)), 6) AS r2
FROM scored WHERE actual_total IS NOT NULL GROUP BY season""")
def q_err_season(spark, sf):
    return ev.error_metrics(scored_frame(spark, sf), group=["season"]).select("season", "n", *r6("mae", "rmse", "r2"))


@register("A14_line_baseline_mae", with_ctes(*SCORED) + "SELECT round(avg(abs(actual_total - total)), 6) AS line_mae FROM scored")
def q_line_mae(spark, sf):
    return ev.line_baseline_mae(scored_frame(spark, sf)).select(*r6("line_mae"))


@register("A15_target_stats", with_ctes(*SCORED) + """
SELECT round(avg(actual_total), 6) AS mean, round(stddev_samp(actual_total), 6) AS std,
  min(actual_total) AS min, max(actual_total) AS max FROM scored""")
def q_target(spark, sf):
    return ev.target_stats(scored_frame(spark, sf)).select(*r6("mean", "std"), "min", "max")


# --------------------------------------------------------------------------- A8-A13
def _bet_sql(group: str = "", void: bool = False) -> str:
    g = f"{group}, " if group else ""
    wins = ("count(*) FILTER (WHERE coalesce(prediction > total, false) = coalesce(actual_total > total, false)"
            + (" AND NOT coalesce(actual_total = total, false))" if void else ")"))
    where = "WHERE total IS NOT NULL AND actual_total IS NOT NULL" if void else ""
    gb = f"GROUP BY {group}" if group else ""
    return with_ctes(*SCORED, f"""
o AS (SELECT {g}CAST(count(*) AS BIGINT) AS bets, CAST({wins} AS BIGINT) AS wins,
  CAST(count(*) FILTER (WHERE coalesce(actual_total = total, false)) AS BIGINT) AS pushes FROM scored {where} {gb})""",
                     """o2 AS (SELECT *, bets - wins - pushes AS losses FROM o)""",
                     """o3 AS (SELECT *, coalesce(CASE WHEN wins + losses <> 0 THEN CAST(wins * 100 AS DOUBLE) / (wins + losses) END, 0.0) AS win_rate,
  wins * 100 - losses * 110 AS profit, (wins + losses) * 110 AS wagered FROM o2)""") + f"""
SELECT {g}bets, wins, pushes, losses, round(win_rate, 6) AS win_rate, profit, wagered,
  round(coalesce(CASE WHEN wagered <> 0 THEN CAST(profit * 100 AS DOUBLE) / wagered END, 0.0), 6) AS roi_pct,
  win_rate > 52.4 AS beats_break_even, round(win_rate - 52.4, 6) AS break_even_margin FROM o3"""


BET_OUT = ["bets", "wins", "pushes", "losses", "win_rate", "profit", "wagered", "roi_pct",
           "beats_break_even", "break_even_margin"]


def _bet_select(df, group=None):
    return df.select(*(group or []), "bets", "wins", "pushes", "losses", *r6("win_rate"), "profit", "wagered",
                     *r6("roi_pct"), "beats_break_even", *r6("break_even_margin"))


@register("A8_A9_A10_bet_outcomes", _bet_sql())
def q_bets(spark, sf):
    return _bet_select(ev.bet_outcomes(scored_frame(spark, sf)))


@register("A8_bet_outcomes_by_season", _bet_sql("season"))
def q_bets_season(spark, sf):
    return _bet_select(ev.bet_outcomes(scored_frame(spark, sf), group=["season"]), ["season"])


@register("A8_bet_outcomes_void_pushes", _bet_sql(void=True))
def q_bets_void(spark, sf):
    return _bet_select(ev.bet_outcomes(scored_frame(spark, sf), push_policy="void"))


@register("A11_J8_edge_sweep", with_ctes(*SCORED, "t AS (SELECT range AS min_edge FROM range(1, 11))", """
e AS (SELECT CAST(t.min_edge AS INTEGER) AS min_edge, CAST(count(s.game_id) AS BIGINT) AS bets,
  CAST(count(s.game_id) FILTER (WHERE coalesce(s.prediction > s.total, false) = coalesce(s.actual_total > s.total, false)) AS BIGINT) AS wins
  FROM t JOIN scored s ON abs(s.prediction - s.total) >= t.min_edge GROUP BY t.min_edge)""") + """
SELECT min_edge, bets, wins, bets - wins AS losses, round(CAST(wins * 100 AS DOUBLE) / bets, 6) AS win_rate,
  wins * 100 - (bets - wins) * 110 AS profit,
  round(CAST((wins * 100 - (bets - wins) * 110) * 100 AS DOUBLE) / (bets * 110), 6) AS roi_pct FROM e WHERE bets > 0""")
def q_edge(spark, sf):
    out = ev.edge_sweep(scored_frame(spark, sf))
    return out.select("min_edge", "bets", "wins", "losses", *r6("win_rate"), "profit", *r6("roi_pct"))


@register("A12_side_breakdown", with_ctes(*SCORED, """
x AS (SELECT coalesce(prediction > total, false) AS so, coalesce(actual_total > total, false) AS wo FROM scored)""") + """
SELECT 'OVER' AS side, CAST(count(*) FILTER (WHERE so) AS BIGINT) AS bets, CAST(count(*) FILTER (WHERE so AND wo) AS BIGINT) AS wins,
  round(coalesce(CAST(count(*) FILTER (WHERE so AND wo) * 100 AS DOUBLE) / nullif(count(*) FILTER (WHERE so), 0), 0.0), 6) AS win_rate FROM x
UNION ALL
SELECT 'UNDER', CAST(count(*) FILTER (WHERE NOT so) AS BIGINT), CAST(count(*) FILTER (WHERE NOT so AND NOT wo) AS BIGINT),
  round(coalesce(CAST(count(*) FILTER (WHERE NOT so AND NOT wo) * 100 AS DOUBLE) / nullif(count(*) FILTER (WHERE NOT so), 0), 0.0), 6) FROM x""")
def q_sides(spark, sf):
    return ev.side_breakdown(scored_frame(spark, sf)).select("side", "bets", "wins", *r6("win_rate"))


@register("A13_monthly_perf", with_ctes(*SCORED, """
m AS (SELECT strftime(date, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS bets,
  CAST(count(*) FILTER (WHERE coalesce(prediction > total, false) = coalesce(actual_total > total, false)) AS BIGINT) AS wins
  FROM scored GROUP BY 1)""") + """
SELECT month, bets, wins, round(CAST(wins * 100 AS DOUBLE) / bets, 6) AS win_rate, wins * 100 - (bets - wins) * 110 AS profit FROM m""")
def q_monthly(spark, sf):
    return ev.monthly_performance(scored_frame(spark, sf)).select("month", "bets", "wins", *r6("win_rate"), "profit")


# --------------------------------------------------------------------------- A17-A19
FEATS = ["points_scored_roll_3", "points_scored_roll_10", "points_allowed_roll_5",
         "total_points_roll_15", "total_points_std_10", "win_roll_10", "days_rest", "season_ppg"]


def _team_feats(spark, sf):
    from tandem.operators.longform import team_games
    return trailing_features(team_games(load_games(spark, sf)),
                             stats=["points_scored", "points_allowed", "total_points", "win"],
                             windows=[3, 5, 10, 15], std_stats=["total_points"], pace=False, trend=False)


def _team_feats_sql():
    from tandem.plans.oracle import feature_select
    return (f"tf AS (SELECT team, season, {feature_select(stats=['points_scored', 'points_allowed', 'total_points', 'win'], std_stats=['total_points'], pace=False, trend=False)} FROM long)")


@register("A17_L3_column_means", with_ctes(_team_feats_sql()) + "SELECT "
          + ", ".join(f"round(avg({c}), 6) AS {c}" for c in FEATS) + " FROM tf WHERE season < (SELECT max(season) FROM tf)")
def q_means(spark, sf):
    """Mean-imputer fit (A17/L3) over the training seasons (all but the last)."""
    f = _team_feats(spark, sf)
    train = f.filter(F.col("season") < f.select(F.max("season")).scalar())
    return ev.column_means(train, FEATS).select(*r6(*FEATS))


@register("A18_standardize_stats", with_ctes(_team_feats_sql()) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM tf" for c in FEATS))
def q_std(spark, sf):
    return ev.standardize_stats(_team_feats(spark, sf), FEATS).select("feature", *r6("mean", "std"))


@register("A19_W12_fold_mae", with_ctes(*SCORED, """
p AS (SELECT *, row_number() OVER (ORDER BY date, game_id) AS position, count(*) OVER () AS n FROM scored)""",
                                        """k AS (SELECT *, n // 6 AS block FROM p)""",
                                        """fo AS (SELECT *, CASE WHEN block > 0 AND position - 1 >= n - 5 * block
  THEN (position - 1 - (n - 5 * block)) // block END AS fold FROM k)""",
                                        """pm AS (SELECT fold, avg(abs(prediction - actual_total)) AS mae FROM fo WHERE fold IS NOT NULL GROUP BY fold)""")
          + "SELECT CAST(count(*) AS BIGINT) AS folds, round(avg(mae), 6) AS mean_mae FROM pm")
def q_fold_mae(spark, sf):
    s = scored_frame(spark, sf)
    folds = ts_folds(s, keep=["game_id", "date", "prediction", "actual_total"])
    return ev.fold_mae(folds).select("folds", *r6("mean_mae"))


# --------------------------------------------------------------------------- A1-A4
@register("A1_warehouse_stats", with_ctes(*SCORED) + """
SELECT CAST(count(*) AS BIGINT) AS total_games, min(date) AS earliest_game, max(date) AS latest_game,
  string_agg(DISTINCT CAST(season AS VARCHAR), ',' ORDER BY CAST(season AS VARCHAR)) AS seasons,
  CAST(count(DISTINCT home) AS BIGINT) AS teams,
  (SELECT CAST(count(*) AS BIGINT) FROM scored WHERE actual_total IS NOT NULL) AS total_predictions
FROM games""")
def q_wh(spark, sf):
    games = load_games(spark, sf)
    preds = scored_frame(spark, sf).filter(F.col("actual_total").isNotNull())
    out = ev.warehouse_stats(games, preds)
    return out.select("total_games", "earliest_game", "latest_game",
                      F.array_join(F.transform("seasons", lambda x: x.cast("string")), ",").alias("seasons"),
                      "teams", "total_predictions")


@register("A2_distinct_seasons", with_ctes() + "SELECT DISTINCT season FROM games ORDER BY season")
def q_seasons(spark, sf):
    return ev.distinct_values(load_games(spark, sf), "season")


@register("A2_distinct_home", with_ctes() + "SELECT DISTINCT home FROM games ORDER BY home")
def q_homes(spark, sf):
    return ev.distinct_values(load_games(spark, sf), "home")


@register("A3_season_record", with_ctes() + """
SELECT team, CAST(sum(win) AS BIGINT) AS season_wins, avg(points_scored) AS season_avg_scored,
  avg(points_allowed) AS season_avg_allowed, CAST(count(*) - sum(win) AS BIGINT) AS season_losses
FROM long WHERE season = (SELECT max(season) FROM games) GROUP BY team""")
def q_record(spark, sf):
    from tandem.operators.longform import team_games
    return ev.season_record(team_games(load_games(spark, sf)))


@register("A4_games_played", with_ctes() + "SELECT team, CAST(count(*) AS BIGINT) AS games_played FROM long GROUP BY team")
def q_played(spark, sf):
    return ev.games_played(two_sided_long(load_games(spark, sf), keep=["game_id"], measures=["points"]))


# --------------------------------------------------------------------------- O1, O2, O4, U2
@register("S5_O1_scan_all_games", with_ctes() + "SELECT * FROM games ORDER BY date, game_id")
def q_scan_all(spark, sf):
    from tandem.sources.store import scan_all_games
    return scan_all_games(load_games(spark, sf))


def _blend_sql():
    parts = []
    for w in WINDOWS:
        for a in ALPHAS:
            parts.append(f"SELECT {w} AS lookback, CAST({a} AS DOUBLE) AS alpha, "
                         f"round(avg(abs({a} * total + (1 - {a}) * expected_total_{w} - actual_total)), 6) AS mae FROM bl")
    return with_ctes(*_scored_sql(tuple(WINDOWS), 10),
                     "bl AS (SELECT * FROM s0 WHERE total IS NOT NULL AND actual_total IS NOT NULL AND "
                     + " AND ".join(f"expected_total_{w} IS NOT NULL" for w in WINDOWS) + ")",
                     "gr AS (" + " UNION ALL ".join(parts) + ")") + \
        "SELECT CAST(lookback AS INTEGER) AS lookback, alpha, mae FROM gr ORDER BY mae, lookback, alpha LIMIT 5"


@register("O2_top_params", _blend_sql())
def q_top_params(spark, sf):
    """Grid (window x blend weight toward the line) scored by MAE in one
    aggregation, then the best five (ORDER BY + LIMIT)."""
    s = scored_frame(spark, sf, windows=tuple(WINDOWS))
    s = s.filter(F.col("total").isNotNull() & F.col("actual_total").isNotNull()
                 & F.expr(" AND ".join(f"expected_total_{w} IS NOT NULL" for w in WINDOWS)))
    aggs = [F.struct(F.lit(w).alias("lookback"), F.lit(a).cast("double").alias("alpha"),
                     F.round(F.avg(F.abs(F.lit(a) * F.col("total") + (1 - F.lit(a)) * F.col(f"expected_total_{w}")
                                         - F.col("actual_total"))), 6).alias("mae"))
            for w in WINDOWS for a in ALPHAS]
    grid = s.agg(F.array(*aggs).alias("g")).select(F.explode("g").alias("r")).select("r.*")
    return grid.orderBy("mae", "lookback", "alpha").limit(5)


@register("O4_head_sample", with_ctes(*SCORED) + """
SELECT game_id, date, home, away, round(prediction, 6) AS prediction, actual_total FROM scored ORDER BY date, game_id LIMIT 5""")
def q_head(spark, sf):
    s = scored_frame(spark, sf)
    return s.orderBy("date", "game_id").limit(5).select("game_id", "date", "home", "away",
                                                         *r6("prediction"), "actual_total")


@register("U2_dedupe_events", with_ctes("""
r AS (SELECT game_id, team, is_home, points_scored,
  row_number() OVER (PARTITION BY game_id ORDER BY is_home DESC, team) AS rn FROM long)""")
          + "SELECT game_id, team, is_home, points_scored FROM r WHERE rn = 1")
def q_dedupe(spark, sf):
    from tandem.operators.setops import first_per_key
    long = two_sided_long(load_games(spark, sf), keep=["game_id"], measures=["points"])
    return first_per_key(long, "game_id", [("is_home", False), ("team", True)]).select(
        "game_id", "team", "is_home", "points_scored")
