"""Core queries: the minimal slice (flagship), long form, windows, matchup."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators.evaluate import bet_outcomes
from tandem.operators.longform import two_sided_long
from tandem.operators.matchup import matchup_join, over_under_features, pair_sides
from tandem.operators.windows import trailing_features
from tandem.plans.catalog import register
from tandem.plans.oracle import TEAM_ORDER, with_ctes
from tandem.sources.games import load_games

BET_COLS = ["bets", "wins", "losses", "pushes", "win_rate", "profit", "roi_pct"]


def minimal_slice(spark, sf_dir):
    """Games -> long -> trailing 5-game means -> pair by event -> expected_total_5
    -> betting outcome per season (reference push and NULL rules)."""
    games = load_games(spark, sf_dir)
    long = two_sided_long(games, keep=["game_id", "season", "date", "total"], measures=["points"])
    feats = trailing_features(long, stats=["points_scored", "points_allowed"], windows=[5], std_stats=[],
                              season_col=None, rest=False, pace=False, trend=False)
    cols = ["points_scored_roll_5", "points_allowed_roll_5"]
    paired = pair_sides(feats, cols, carry=["season", "total"], side_carry=["points_scored"])
    m = over_under_features(paired.withColumnsRenamed({"home_points_scored": "score_home",
                                                       "away_points_scored": "score_away"}), windows=[5])
    scored = m.filter(F.col("expected_total_5").isNotNull()).withColumn("prediction", F.col("expected_total_5"))
    return bet_outcomes(scored, group=["season"]).select("season", *BET_COLS)


MINIMAL_SLICE_SQL = with_ctes(f"""
f AS (SELECT team, game_id, is_home,
  avg(points_scored) OVER (PARTITION BY team {TEAM_ORDER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ps5,
  avg(points_allowed) OVER (PARTITION BY team {TEAM_ORDER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pa5
  FROM long)""", """
m AS (SELECT g.season, g.total, g.score_home + g.score_away AS actual_total,
  (h.ps5 + a.pa5) / 2 + (a.ps5 + h.pa5) / 2 AS prediction
  FROM games g LEFT JOIN f h ON h.game_id = g.game_id AND h.is_home = 1
  LEFT JOIN f a ON a.game_id = g.game_id AND a.is_home = 0)""", """
o AS (SELECT season,
  CAST(count(*) AS BIGINT) AS bets,
  CAST(count(*) FILTER (WHERE coalesce(prediction > total, false) = coalesce(actual_total > total, false)) AS BIGINT) AS wins,
  CAST(count(*) FILTER (WHERE coalesce(actual_total = total, false)) AS BIGINT) AS pushes
  FROM m WHERE prediction IS NOT NULL GROUP BY season)""") + """
SELECT season, bets, wins, bets - wins - pushes AS losses, pushes,
  coalesce(CASE WHEN bets - pushes <> 0 THEN CAST(wins * 100 AS DOUBLE) / (bets - pushes) END, 0.0) AS win_rate,
  wins * 100 - (bets - wins - pushes) * 110 AS profit,
  coalesce(CASE WHEN bets - pushes <> 0 THEN CAST((wins * 100 - (bets - wins - pushes) * 110) * 100 AS DOUBLE)
                / ((bets - pushes) * 110) END, 0.0) AS roi_pct
FROM o"""

register("minimal_slice", MINIMAL_SLICE_SQL)(minimal_slice)
