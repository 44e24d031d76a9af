"""D4, D7, S17 and the scalar function suite."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tandem.plans import jobs as J
from tandem.plans.catalog import QUERIES, register
from tandem.plans.oracle import GAME_COLUMNS, with_ctes
from tandem.sources import store as S
from tandem.sources.games import load_games


def _d4_sql():
    from tandem.plans.queries_sources import PRED_SQL
    return f"""
WITH g AS ({QUERIES["D2_S4_ingest_feed"][1]}), n AS ({with_ctes(*PRED_SQL)} SELECT count(*) AS n FROM preds)
SELECT CAST(count(*) AS BIGINT) AS total_games, min(date) AS earliest_game, max(date) AS latest_game,
  string_agg(DISTINCT CAST(season AS VARCHAR), ',' ORDER BY CAST(season AS VARCHAR)) AS seasons,
  CAST(count(DISTINCT home) AS BIGINT) AS teams, (SELECT CAST(n AS BIGINT) FROM n) AS total_predictions FROM g"""


@register("D4_daily_update", _d4_sql())
def q_daily(spark, sf):
    """Ingest -> settle -> snapshot -> stats on a stored table."""
    from tandem.plans.queries_sources import _landing, _prediction_log
    games, dim, sb, bx, _ = _landing(spark, sf, feeds=("scoreboard", "boxscore"))
    table = S.create_table(spark, S.scratch_path(spark, "daily-games"), games)
    out = J.daily_update(spark, table.path, sb, bx, dim, _prediction_log(spark, sf))
    st = out["stats"]
    return st.select("total_games", "earliest_game", "latest_game",
                     F.array_join(F.transform("seasons", lambda x: x.cast("string")), ",").alias("seasons"),
                     "teams", "total_predictions")


def _d4_dates_sql():
    from tandem.plans.queries_sources import PLAYED, PRED_SQL
    window = "BETWEEN (SELECT max(date) - INTERVAL 60 DAY FROM games) AND (SELECT max(date) - INTERVAL 10 DAY FROM games)"
    return with_ctes(*PRED_SQL, f"done AS (SELECT DISTINCT date AS game_date, away, home FROM games WHERE {PLAYED} AND date {window})") + """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM done) AS games_added, (SELECT CAST(count(*) AS BIGINT) FROM done) AS games_settled,
  (SELECT CAST(count(*) AS BIGINT) FROM preds JOIN done USING (game_date, away, home)) AS predictions_updated,
  (SELECT CAST(count(*) AS BIGINT) FROM preds) AS total_predictions,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT team FROM long)) AS teams"""


@register("D4_daily_update_dates", _d4_dates_sql())
def q_daily_dates(spark, sf):
    """The daily job over a range of dates on stored tables: what it added, settled and updated, observed
    while writing, then checked against the log as it lies there."""
    from tandem.plans.queries_sources import _landing, _prediction_log
    games, dim, sb, bx, _ = _landing(spark, sf, feeds=("scoreboard", "boxscore"))
    hi = games.agg(F.max("date")).first()[0]
    table = S.create_table(spark, S.scratch_path(spark, "daily-games"), games)
    log = S.scratch_path(spark, "daily-log")
    S.log_predictions(spark, log, _prediction_log(spark, sf))
    out = J.daily_update(spark, table.path, sb, bx, dim, start=hi - timedelta(days=60), end=hi - timedelta(days=10), log_path=log)
    counts = {k: F.lit(v).cast("long").alias(k) for k, v in out["counts"].items()}
    in_log = F.count_if(F.col("actual_total").isNotNull() & F.col("prediction_error").isNotNull())
    return out["settled"].agg(in_log.alias("predictions_updated"), F.count(F.lit(1)).alias("total_predictions")).select(
        counts["games_added"], counts["games_settled"],
        F.when(F.col("predictions_updated") == counts["predictions_updated"], F.col("predictions_updated")).alias("predictions_updated"),
        "total_predictions", out["snapshot"].select(F.count(F.lit(1))).scalar().alias("teams"))


def _d7_sql():
    from tandem.plans.queries_eval import SCORED
    return with_ctes(*SCORED, """
t AS (SELECT * FROM scored WHERE season IN (2000, 2001))""", """
o AS (SELECT avg(abs(prediction - actual_total)) AS mae, sqrt(avg((prediction - actual_total) * (prediction - actual_total))) AS rmse,
  CAST(count(*) AS BIGINT) AS bets,
  CAST(count(*) FILTER (WHERE coalesce(prediction > total, false) = coalesce(actual_total > total, false)) AS BIGINT) AS wins,
  CAST(count(*) FILTER (WHERE coalesce(actual_total = total, false)) AS BIGINT) AS pushes FROM t)""") + """
SELECT round(mae, 6) AS mae, round(rmse, 6) AS rmse, bets, wins, pushes, bets - wins - pushes AS losses,
  round((wins * 100 - (bets - wins - pushes) * 110) * 100.0 / ((bets - pushes) * 110), 6) AS roi_pct FROM o"""


@register("D7_evaluate_job", _d7_sql())
def q_eval_job(spark, sf):
    """Held-out seasons 2000-2001 scored with the matchup estimate."""
    from tandem.plans.queries_eval import scored_frame
    out = J.evaluate_job(scored_frame(spark, sf), [2000, 2001]).filter(F.col("part") == "all")
    return out.select(F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), "bets", "wins", "pushes",
                      "losses", F.round("roi_pct", 6).alias("roi_pct"))


def _d7_parts_sql():
    from tandem.plans.queries_eval import SCORED
    correct = "coalesce(prediction > total, false) = coalesce(actual_total > total, false)"
    agg = (f"CAST(count(*) AS BIGINT) AS bets, CAST(count(*) FILTER (WHERE {correct}) AS BIGINT) AS wins, "
           "CAST(count(*) FILTER (WHERE coalesce(actual_total = total, false)) AS BIGINT) AS pushes")
    side = "CASE WHEN coalesce(prediction > total, false) THEN 'OVER' ELSE 'UNDER' END"
    return with_ctes(*SCORED, "t AS (SELECT * FROM scored WHERE season IN (2000, 2001))", "k AS (SELECT range AS e FROM range(1, 11))", f"""
parts AS (
  SELECT 'all' AS part, NULL AS key, {agg}, bets - wins - pushes AS losses, avg(abs(prediction - actual_total)) AS mae,
    sqrt(avg((prediction - actual_total) * (prediction - actual_total))) AS rmse FROM t
  UNION ALL SELECT 'side', {side}, {agg}, bets - wins, NULL, NULL FROM t GROUP BY 2
  UNION ALL SELECT 'month', strftime(date, '%Y-%m'), {agg}, bets - wins, NULL, NULL FROM t GROUP BY 2
  UNION ALL SELECT 'edge', CAST(e AS VARCHAR), {agg}, bets - wins, NULL, NULL FROM k JOIN t ON abs(prediction - total) >= e GROUP BY 2)""") + """
SELECT part, key, bets, wins, pushes, losses, round(coalesce(wins * 100.0 / nullif(wins + losses, 0), 0), 6) AS win_rate,
  wins * 100 - losses * 110 AS profit,
  round(coalesce((wins * 100 - losses * 110) * 100.0 / nullif((wins + losses) * 110, 0), 0), 6) AS roi_pct,
  round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM parts"""


@register("D7_evaluate_breakdowns", _d7_parts_sql())
def q_eval_parts(spark, sf):
    """The whole evaluation in one pass: totals, minimum edges, sides and months."""
    from tandem.plans.queries_eval import scored_frame
    out = J.evaluate_job(scored_frame(spark, sf), [2000, 2001])
    return out.withColumns({c: F.round(c, 6) for c in ("win_rate", "roi_pct", "mae", "rmse")})


@register("S17_load_stored", with_ctes() + "SELECT * FROM games")
def q_stored(spark, sf):
    """A stored table with rows is loaded; the CSV, which does not exist here, is not read."""
    table = S.create_table(spark, S.scratch_path(spark, "stored-games"), load_games(spark, sf))
    return S.load_or_seed(spark, table.path, S.scratch_path(spark, "no-csv")).select(*GAME_COLUMNS)


@register("S17_load_or_seed", QUERIES["S1_S2_csv_conform"][1])
def q_seed(spark, sf):
    """No stored table yet -> seed from the CSV export (S1 + S2)."""
    games = load_games(spark, sf)
    csv = S.scratch_path(spark, "seed-csv")
    games.write.option("header", True).csv(csv)
    df = S.load_or_seed(spark, S.scratch_path(spark, "no-table-yet"), csv)
    return df.select(*GAME_COLUMNS, "regular", "playoffs", "id_spread")


SCALAR_SQL = with_ctes() + """
SELECT game_id,
  upper(home) AS up, lower(upper(away)) AS low, contains(home, '1') AS has1, starts_with(away, 't1') AS st,
  substring(home, 2, 3) AS sub, regexp_replace(home, '[0-9]', '#', 'g') AS masked,
  regexp_matches(away, '^t[0-9]+$') AS code_ok, concat(away, ' @ ', home) AS matchup,
  strftime(date, '%Y-%m') AS ym, CAST(month(date) AS INTEGER) AS m, CAST(year(date) AS INTEGER) AS y,
  date - INTERVAL 1 DAY AS prev_day, CAST(date_diff('day', DATE '1995-01-01', date) AS INTEGER) AS day_no,
  abs(score_home - score_away) AS margin, round(sqrt(score_home), 6) AS root,
  round_even(total / 3, 1) AS third, least(score_home, score_away) AS lo, greatest(score_home, score_away) AS hi,
  CASE WHEN score_home > score_away THEN 'H' WHEN score_home < score_away THEN 'A' ELSE 'T' END AS winner,
  coalesce(total, 0.0) AS line0,
  [q1_home, q2_home, q3_home, q4_home][2] AS q2, len([q1_home, q2_home, q3_home, q4_home]) AS nq,
  CASE WHEN ot_home > 0 THEN 'ot' ELSE 'reg' END AS kind
FROM games"""


@register("F_scalar_suite", SCALAR_SQL)
def q_scalars(spark, sf):
    """The string, date, math, conditional and array functions the operators use."""
    g = load_games(spark, sf)
    c = F.col
    quarters = F.array("q1_home", "q2_home", "q3_home", "q4_home")
    kinds = F.create_map(F.lit(True), F.lit("ot"), F.lit(False), F.lit("reg"))
    return g.select(
        "game_id", F.upper("home").alias("up"), F.lower(F.upper("away")).alias("low"),
        c("home").contains("1").alias("has1"), c("away").startswith("t1").alias("st"),
        F.substring("home", 2, 3).alias("sub"), F.regexp_replace("home", "[0-9]", "#").alias("masked"),
        c("away").rlike("^t[0-9]+$").alias("code_ok"), F.concat("away", F.lit(" @ "), "home").alias("matchup"),
        F.date_format("date", "yyyy-MM").alias("ym"), F.month("date").alias("m"), F.year("date").alias("y"),
        F.date_sub("date", 1).cast("timestamp_ntz").alias("prev_day"),
        F.datediff("date", F.lit("1995-01-01").cast("date")).alias("day_no"),
        F.abs(c("score_home") - c("score_away")).alias("margin"), F.round(F.sqrt("score_home"), 6).alias("root"),
        F.bround(c("total") / 3, 1).alias("third"),
        F.least("score_home", "score_away").alias("lo"), F.greatest("score_home", "score_away").alias("hi"),
        F.when(c("score_home") > c("score_away"), "H").when(c("score_home") < c("score_away"), "A")
         .otherwise("T").alias("winner"),
        F.coalesce("total", F.lit(0.0)).alias("line0"),
        F.element_at(quarters, 2).alias("q2"), F.size(quarters).cast("bigint").alias("nq"),
        kinds[c("ot_home") > 0].alias("kind"))
