"""Queries for sources/sinks (S1-S17), filters (P4-P6, P10-P15), joins
(J3-J6, J9) and composed jobs (D1-D3, D5, D8, D9, L9, L11, L12, A16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions.names import ALLOWED_GAME_COLUMNS
from tandem.operators import filters as P
from tandem.operators.evaluate import slate_summary
from tandem.operators.longform import team_games
from tandem.plans import jobs as J
from tandem.plans.catalog import register
from tandem.plans.oracle import FEAT_CTE, GAME_COLUMNS, TEAM_ORDER, matchup_select, side_columns, with_ctes
from tandem.plans.pipeline import team_features
from tandem.sources import store as S
from tandem.sources.dims import entity_dimension, full_names, map_codes, validate_entity
from tandem.sources.feeds import (SEASON_LOG_SCHEMA, checked_boxscore, checked_scoreboard, completed_scores,
                                  landing_from_games, read_boxscore, read_scoreboard, season_finder)
from tandem.sources.games import load_games
from tandem.sources.tables import read_table

KEYSTR = "CAST(regexp_extract({c}, '(\\d+)$', 1) AS BIGINT)"
GID = "lpad(CAST(game_id AS VARCHAR), 10, '0')"
PLAYED = "score_home IS NOT NULL AND score_away IS NOT NULL"


def _landing(spark, sf, feeds=("scoreboard", "boxscore", "season_log")):
    games = load_games(spark, sf)
    paths = landing_from_games(games, S.scratch_path(spark, "landing"), feeds)
    dim = entity_dimension(read_table(spark, sf, "customer"))
    sb = read_scoreboard(spark, paths["scoreboard"]) if "scoreboard" in paths else None
    bx = read_boxscore(spark, paths["boxscore"]) if "boxscore" in paths else None
    return games, dim, sb, bx, paths


# --------------------------------------------------------------------------- S1, S2, S3, S4
@register("S1_S2_csv_conform", with_ctes() + "SELECT *, true AS regular, false AS playoffs, 0 AS id_spread FROM games")
def q_csv(spark, sf):
    """Games written as CSV, read back with PERMISSIVE string schema (S1) and
    conformed to the typed schema with defaults (S2)."""
    games = load_games(spark, sf)
    path = S.scratch_path(spark, "csv")
    games.write.option("header", True).csv(path)
    conformed = S.conform_games(S.read_games_csv(spark, path))
    return conformed.select(*GAME_COLUMNS, "regular", "playoffs", "id_spread")


def _ingest_sql(coalesce_old: bool) -> str:
    q0 = ", ".join(f"CAST({'NULL' if coalesce_old else 0} AS BIGINT) AS {p}_{s}" for s in ("away", "home")
                   for p in ("q1", "q2", "q3", "q4", "ot"))
    delta = (f"d AS (SELECT game_id, CAST(CASE WHEN month(date) >= 10 THEN year(date) + 1 ELSE year(date) END AS INTEGER) AS season, "
             f"date, away, home, score_away, score_home, {q0}, CAST(NULL AS DOUBLE) AS total FROM games WHERE {PLAYED})")
    cols = ", ".join(GAME_COLUMNS)
    u = f"u AS (SELECT {cols}, 0 AS src FROM games UNION ALL SELECT {cols}, 1 AS src FROM d)"
    if not coalesce_old:
        r = "r AS (SELECT *, row_number() OVER (PARTITION BY date, away, home ORDER BY src DESC, game_id DESC) AS rn FROM u)"
        return with_ctes(delta, u, r) + f"SELECT {cols} FROM r WHERE rn = 1"
    win = "OVER (PARTITION BY date, away, home ORDER BY src DESC, game_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    sel = ", ".join(c if c in ("date", "away", "home") else f"first({c} IGNORE NULLS) {win} AS {c}" for c in GAME_COLUMNS)
    r = (f"r AS (SELECT {sel}, row_number() OVER (PARTITION BY date, away, home ORDER BY src DESC, game_id DESC) AS rn FROM u)")
    return with_ctes(delta, u, r) + f"SELECT {cols} FROM r WHERE rn = 1"


@register("D2_S4_ingest_feed", _ingest_sql(False))
def q_ingest(spark, sf):
    """Feed landing -> completed events (J6) -> season (D1) -> latest-wins
    upsert by (date, away, home), whole row replaced (reference, Q6)."""
    games, dim, sb, bx, _ = _landing(spark, sf)
    return J.ingest(games, sb, bx, dim).select(*GAME_COLUMNS)


@register("D2_S4_ingest_feed_coalesce", _ingest_sql(True))
def q_ingest_coalesce(spark, sf):
    """Same, but values the feed lacks (line, quarters) keep the stored ones."""
    games, dim, sb, bx, _ = _landing(spark, sf)
    return J.ingest(games, sb, bx, dim, reference_mode=False).select(*GAME_COLUMNS)


@register("S3_S4_upsert_parquet", _ingest_sql(False))
def q_upsert_parquet(spark, sf):
    """S3 write partitioned by season, then S4 against the stored table: only
    touched seasons are read, merged and committed as its next version."""
    games, dim, sb, bx, _ = _landing(spark, sf)
    table = S.create_table(spark, S.scratch_path(spark, "games"), games)
    S.upsert_into(spark, table.path, J.feed_delta(sb, bx, dim), S.GAME_KEY, order_col="game_id")
    return table.read().select(*GAME_COLUMNS)


def _null_season_sql():
    cols = ", ".join(GAME_COLUMNS)
    q0 = ", ".join(f"CAST(0 AS BIGINT) AS {p}_{s}" for s in ("away", "home") for p in ("q1", "q2", "q3", "q4", "ot"))
    base = "base AS (SELECT * REPLACE (CASE WHEN game_id % 5 < 2 THEN NULL ELSE season END AS season) FROM games)"
    delta = (f"d AS (SELECT game_id, CASE WHEN game_id % 7 = 0 THEN NULL ELSE season END AS season, date, away, home, score_away, "
             f"score_home, {q0}, CAST(NULL AS DOUBLE) AS total FROM games WHERE {PLAYED} AND game_id % 3 = 0 AND season > 1994)")
    u = f"u AS (SELECT {cols}, 0 AS src FROM base UNION ALL SELECT {cols}, 1 AS src FROM d)"
    r = "r AS (SELECT *, row_number() OVER (PARTITION BY date, away, home ORDER BY src DESC, game_id DESC) AS rn FROM u)"
    # keys that the delta does not have keep all their stored rows' latest as well only where their partition was merged:
    # the stored table holds one row per key, so that is the same
    return with_ctes("games1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, away, home ORDER BY game_id DESC) AS k "
                     "FROM games) WHERE k = 1)", base.replace("FROM games)", "FROM games1)"), delta, u, r) + f"SELECT {cols} FROM r WHERE rn = 1"


@register("S4_upsert_null_season", _null_season_sql())
def q_upsert_null(spark, sf):
    """Stored rows and delta rows without a season: those whose key the delta lacks survive, the others
    are replaced wherever they stand."""
    games, dim, sb, bx, _ = _landing(spark, sf)
    gid = F.col("game_id")
    stored = S.upsert_latest(games.limit(0), games, S.GAME_KEY, order_col="game_id")
    table = S.create_table(spark, S.scratch_path(spark, "games"),
                           stored.withColumn("season", F.when(gid % 5 >= 2, F.col("season"))))
    delta = J.feed_delta(sb, bx, dim).filter((gid % 3 == 0) & (F.col("season") > 1994))
    S.upsert_into(spark, table.path, delta.withColumn("season", F.when(gid % 7 != 0, F.col("season"))), S.GAME_KEY,
                  order_col="game_id")
    return table.read().select(*GAME_COLUMNS)


# --------------------------------------------------------------------------- quarantine
CSV_FAULT = ("CASE WHEN game_id % 50 IN (0, 1) THEN 'fields do not fit the header' WHEN game_id % 50 = 2 THEN 'no date' "
             "WHEN game_id % 50 = 3 THEN 'no entity' END")


@register("S1_csv_quarantine", with_ctes() + f"SELECT game_id, season, total, {CSV_FAULT} AS reason FROM games "
          f"WHERE {CSV_FAULT} IS NULL UNION ALL SELECT game_id, NULL, NULL, {CSV_FAULT} FROM games WHERE {CSV_FAULT} IS NOT NULL")
def q_csv_quarantine(spark, sf):
    """A CSV export with lines cut short or with fields too many, dates that are none and missing entities:
    good rows conformed, bad ones in the quarantine table with their reason."""
    games = load_games(spark, sf)
    gid = F.col("game_id") % 50
    path, bad_path = S.scratch_path(spark, "csv"), S.scratch_path(spark, "quarantine")
    text = games.select(*[F.col(c).cast("string").alias(c) for c in GAME_COLUMNS])
    text = text.withColumns({"date": F.when(gid == 2, "someday").otherwise(F.col("date")),
                             "home": F.when(gid != 3, F.col("home"))})
    text.filter(gid > 1).write.option("header", True).csv(path)
    cut = F.concat_ws(",", "game_id", "season", "date")
    long = F.concat(F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in GAME_COLUMNS]), F.lit(",1,2"))
    # one column named like the header line: whole lines as they are
    (text.filter(gid < 2).select(F.when(gid == 0, cut).otherwise(long).alias(",".join(GAME_COLUMNS)))
     .write.mode("append").option("header", True).option("sep", "\x01").option("quote", "").csv(path))
    good, bad = S.read_games_csv_checked(spark, path)
    S.quarantine(bad, bad_path, "games.csv")
    rejected = spark.read.parquet(bad_path).select(F.split("raw", ",")[0].cast("long").alias("game_id"), "reason")
    return good.select("game_id", "season", "total", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected, allowMissingColumns=True)


@register("S9_S10_feed_quarantine", with_ctes() + f"""
SELECT 'scoreboard' AS feed, {GID} AS game_id, NULL AS reason FROM games
UNION ALL SELECT 'boxscore', {GID}, NULL FROM games WHERE {PLAYED}
UNION ALL SELECT 'scoreboard', {GID}, CASE game_id % 30 WHEN 0 THEN 'unparsable' WHEN 1 THEN 'no date' ELSE 'event without id' END
  FROM games WHERE game_id % 30 < 3
UNION ALL SELECT 'boxscore', {GID}, CASE game_id % 30 WHEN 0 THEN 'unparsable' WHEN 1 THEN 'no id' ELSE 'side without points or name' END
  FROM games WHERE game_id % 30 < 3""")
def q_feed_quarantine(spark, sf):
    """Feed folders with broken documents among the good ones."""
    games, _, _, _, paths = _landing(spark, sf, feeds=("scoreboard", "boxscore"))
    bad_path = S.scratch_path(spark, "quarantine")
    gid = F.lpad(F.col("game_id").cast("string"), 10, "0")
    kind = F.col("game_id") % 30
    doc = lambda pattern: F.format_string(pattern, gid)
    broken = games.filter(kind < 3)
    broken.select(F.when(kind == 0, doc('{"date": "1996-01-01", "GameHeader": [{"GAME_ID": "%s"'))
                  .when(kind == 1, doc('{"date": "soon", "GameHeader": [{"GAME_ID": "%s"}]}'))
                  .otherwise(doc('{"date": "1996-01-01", "GameHeader": [{"GAME_STATUS_TEXT": "%s"}]}'))
                  ).write.mode("append").text(paths["scoreboard"])
    broken.select(F.when(kind == 0, doc('{"GAME_ID": "%s", "TeamStats": ['))
                  .when(kind == 1, doc('{"TeamStats": [{"TEAM_ID": 1, "TEAM_ABBREVIATION": "%s"}]}'))
                  .otherwise(doc('{"GAME_ID": "%s", "TeamStats": [{"TEAM_ID": 1}, {"TEAM_ID": 2}]}'))
                  ).write.mode("append").text(paths["boxscore"])
    out = []
    for name, read in (("scoreboard", checked_scoreboard), ("boxscore", checked_boxscore)):
        good, bad = read(spark, paths[name])
        S.quarantine(bad, bad_path, name)
        out.append(good.select(F.lit(name).alias("feed"), "game_id", F.lit(None).cast("string").alias("reason")))
    rejected = spark.read.parquet(bad_path).select(
        F.col("source").alias("feed"), F.regexp_extract("raw", r"([0-9]{10})", 1).alias("game_id"), "reason")
    return out[0].unionByName(out[1]).unionByName(rejected)


@register("S9_read_scoreboard_date", with_ctes() + f"""
SELECT {GID} AS game_id, date, CASE WHEN {PLAYED} THEN 'Final' ELSE '7:30 pm ET' END AS game_time FROM games
WHERE date = (SELECT max(date) FROM games)""")
def q_scoreboard_date(spark, sf):
    """The scoreboard of one day."""
    games, _, _, _, paths = _landing(spark, sf, feeds=("scoreboard",))
    return read_scoreboard(spark, paths["scoreboard"], games.agg(F.max("date")).first()[0]).select("game_id", "date", "game_time")


# --------------------------------------------------------------------------- S5-S8
@register("S6_scan_season", with_ctes() + "SELECT * FROM games WHERE season = (SELECT max(season) FROM games)")
def q_season(spark, sf):
    games = load_games(spark, sf)
    return S.scan_season(games, games.select(F.max("season")).scalar())


@register("S7_scan_date_range", with_ctes() + """
SELECT * FROM games WHERE date BETWEEN (SELECT max(date) - INTERVAL 365 DAY FROM games) AND (SELECT max(date) FROM games)""")
def q_range(spark, sf):
    games = load_games(spark, sf)
    hi = games.select(F.max("date")).scalar()
    return S.scan_date_range(games, F.date_sub(hi, 365), hi)


@register("S8_project_allowlist", with_ctes() + "SELECT * FROM games")
def q_allow(spark, sf):
    games = load_games(spark, sf).withColumns({"_rowid": F.lit(1), "injected; DROP": F.lit("x")})
    return S.project_game_columns(games)


# --------------------------------------------------------------------------- S9-S11, J5, J6
@register("S9_read_scoreboard", with_ctes() + f"""
SELECT {GID} AS game_id, date, {KEYSTR.format(c='home')} AS home_team_id, {KEYSTR.format(c='away')} AS away_team_id,
  CAST(CASE WHEN {PLAYED} THEN 3 ELSE 1 END AS INTEGER) AS game_status,
  CASE WHEN {PLAYED} THEN 'Final' ELSE '7:30 pm ET' END AS game_time FROM games""")
def q_scoreboard(spark, sf):
    return _landing(spark, sf)[2]


@register("S10_read_boxscore", with_ctes() + f"""
SELECT {GID} AS game_id, {KEYSTR.format(c='away')} AS away_team_id,
  CASE WHEN {KEYSTR.format(c='away')} % 10 = 0 THEN 'A' || CAST({KEYSTR.format(c='away')} AS VARCHAR) ELSE upper(away) END AS away_abbrev,
  {KEYSTR.format(c='home')} AS home_team_id,
  CASE WHEN {KEYSTR.format(c='home')} % 10 = 0 THEN 'A' || CAST({KEYSTR.format(c='home')} AS VARCHAR) ELSE upper(home) END AS home_abbrev,
  score_away, score_home FROM games WHERE {PLAYED}""")
def q_box(spark, sf):
    return _landing(spark, sf)[3]


@register("J6_J5_completed_scores", with_ctes() + f"SELECT date, away, home, score_away, score_home, {GID} AS game_id FROM games WHERE {PLAYED}")
def q_completed(spark, sf):
    """Final scoreboard rows joined to box scores, alias codes mapped back."""
    _, dim, sb, bx, _ = _landing(spark, sf)
    return completed_scores(sb, bx, dim)


@register("S11_season_finder", with_ctes() + f"SELECT {GID} AS game_id, date, away, home, score_away, score_home FROM games WHERE {PLAYED}")
def q_finder(spark, sf):
    games, dim, _, _, paths = _landing(spark, sf)
    log = spark.read.schema(SEASON_LOG_SCHEMA).json(paths["season_log"])
    return season_finder(log, dim)


@register("S11_season_finder_reference_mode", with_ctes() + f"""
SELECT {GID} AS game_id, date, {KEYSTR.format(c='home')} AS team_id,
  CASE WHEN {KEYSTR.format(c='home')} % 10 = 0 THEN 'A' || CAST({KEYSTR.format(c='home')} AS VARCHAR) ELSE upper(home) END AS abbrev,
  true AS is_home, CASE WHEN score_home > score_away THEN 'W' ELSE 'L' END AS win_loss, score_home AS points,
  CAST(score_home - score_away AS DOUBLE) AS plus_minus, home AS team FROM games WHERE {PLAYED}""")
def q_finder_ref(spark, sf):
    games, dim, _, _, paths = _landing(spark, sf)
    log = spark.read.schema(SEASON_LOG_SCHEMA).json(paths["season_log"])
    return season_finder(log, dim, reference_mode=True)


@register("J5_full_names", with_ctes() + "SELECT g.game_id, g.home, coalesce(c.c_name, g.home) AS home_name FROM games g "
          "LEFT JOIN customer c ON g.home = 't' || CAST(c.c_custkey AS VARCHAR)")
def q_names(spark, sf):
    dim = entity_dimension(read_table(spark, sf, "customer"))
    return full_names(load_games(spark, sf).select("game_id", "home"), "home", dim, "home_name")


@register("P10_validate_entity", with_ctes(f"""
x AS (SELECT game_id, CASE WHEN {KEYSTR.format(c='home')} % 10 = 0 THEN 'A' || CAST({KEYSTR.format(c='home')} AS VARCHAR) ELSE upper(home) END AS abbrev FROM games WHERE {PLAYED})""")
          + "SELECT x.game_id, x.abbrev, c.c_custkey IS NOT NULL AS valid FROM x LEFT JOIN customer c ON lower(x.abbrev) = 't' || CAST(c.c_custkey AS VARCHAR)")
def q_validate(spark, sf):
    """Raw feed codes checked against the entity codes; alias spellings are
    quarantined with a reason (valid=false)."""
    _, dim, _, bx, _ = _landing(spark, sf)
    rows = bx.select("game_id", F.col("home_abbrev").alias("abbrev"))
    valid, bad = validate_entity(rows, "abbrev", dim)
    return (valid.select("game_id", "abbrev", F.lit(True).alias("valid"))
            .unionByName(bad.select("game_id", "abbrev", F.lit(False).alias("valid")))
            .select(F.regexp_replace("game_id", "^0+(?=.)", "").cast("long").alias("game_id"), "abbrev", "valid"))


@register("P11_validate_date", with_ctes("""
x AS (SELECT game_id, strftime(date, '%Y-%m-%d') AS ok_s, strftime(date, '%Y') || '-99-' || strftime(date, '%d') AS bad_s FROM games)""") + """
SELECT game_id, ok_s, bad_s, regexp_full_match(ok_s, '\\d{4}-\\d{2}-\\d{2}') AS ok_ref,
  regexp_full_match(ok_s, '\\d{4}-\\d{2}-\\d{2}') AND try_strptime(ok_s, '%Y-%m-%d') IS NOT NULL AS ok_strict,
  regexp_full_match(bad_s, '\\d{4}-\\d{2}-\\d{2}') AS bad_ref,
  regexp_full_match(bad_s, '\\d{4}-\\d{2}-\\d{2}') AND try_strptime(bad_s, '%Y-%m-%d') IS NOT NULL AS bad_strict FROM x""")
def q_dates(spark, sf):
    g = load_games(spark, sf).select("game_id", F.date_format("date", "yyyy-MM-dd").alias("ok_s"),
                                     F.concat(F.date_format("date", "yyyy"), F.lit("-99-"),
                                              F.date_format("date", "dd")).alias("bad_s"))
    out = g
    for c in ("ok", "bad"):
        out = P.validate_date(out, f"{c}_s").withColumnRenamed("date_ok", f"{c}_ref")
        out = P.validate_date(out, f"{c}_s", strict=True).withColumnRenamed("date_ok", f"{c}_strict")
    return out


# --------------------------------------------------------------------------- P4-P6, P12-P15
@register("P4_completed_filter", with_ctes() + f"SELECT * FROM games WHERE {PLAYED}")
def q_completed_filter(spark, sf):
    return P.completed_filter(load_games(spark, sf))


@register("P5_entity_events", with_ctes("""
top AS (SELECT team FROM long GROUP BY team ORDER BY count(*) DESC, team LIMIT 1)""")
          + "SELECT g.* FROM games g, top WHERE g.home = top.team OR g.away = top.team")
def q_entity(spark, sf):
    """Events of the busiest entity (either side)."""
    from tandem.operators.longform import two_sided_long
    games = load_games(spark, sf)
    busiest = (two_sided_long(games, keep=[], measures=["points"]).groupBy("team").count()
               .orderBy(F.desc("count"), "team").limit(1))
    return P.entity_events(games, busiest.select("team").scalar())


TEST_SEASONS = [2000, 2001]


@register("P6_L1_season_holdout", with_ctes() + "SELECT game_id, season, season IN (2000, 2001) AS is_test FROM games")
def q_holdout(spark, sf):
    """L1: train = seasons not in the test list, test = the list (P6 both ways)."""
    games = load_games(spark, sf).select("game_id", "season")
    test = P.season_in(games, TEST_SEASONS).withColumn("is_test", F.lit(True))
    train = P.season_in(games, TEST_SEASONS, negate=True).withColumn("is_test", F.lit(False))
    return test.unionByName(train)


@register("L2_rolling_holdout", with_ctes() + """
SELECT game_id, season, CASE WHEN season IN (2000, 2001) THEN 'test' WHEN season BETWEEN 1995 AND 1999 THEN 'train' END AS split
FROM games WHERE season IN (2000, 2001) OR season BETWEEN 1995 AND 1999""")
def q_rolling(spark, sf):
    """L2: train = the 5 seasons before min(test), test = the test seasons."""
    games = load_games(spark, sf).select("game_id", "season")
    lo = min(TEST_SEASONS) - 5
    tr = games.filter(F.col("season").between(lo, min(TEST_SEASONS) - 1)).withColumn("split", F.lit("train"))
    te = P.season_in(games, TEST_SEASONS).withColumn("split", F.lit("test"))
    return tr.unionByName(te)


LINES_SQL = ("lines AS (SELECT date AS game_date, away, home, CASE WHEN total IS NULL THEN 'n/a' "
             "WHEN game_id % 41 = 0 THEN 'nan' ELSE CAST(total AS VARCHAR) END AS line FROM games)")


def _lines(games):
    return games.select(F.col("date").alias("game_date"), "away", "home",
                        F.when(F.col("total").isNull(), "n/a").when(F.col("game_id") % 41 == 0, "nan")
                        .otherwise(F.col("total").cast("string")).alias("line"))


@register("P12_coerce_numeric", with_ctes(LINES_SQL) + "SELECT game_date, away, home, TRY_CAST(nullif(line, 'nan') AS DOUBLE) AS line FROM lines")
def q_coerce(spark, sf):
    return P.coerce_numeric(_lines(load_games(spark, sf)), ["line"])


ROLL_SUB = ["points_scored_roll_3", "total_points_roll_10", "win_roll_15", "total_points_std_5"]


@register("P15_P14_fill_zero_prefix", with_ctes(FEAT_CTE) + "SELECT game_id, is_home, "
          + ", ".join(f"coalesce(round({c}, 6), 0) AS home_{c}" for c in ROLL_SUB) + " FROM feat")
def q_fill(spark, sf):
    f = team_features(load_games(spark, sf)).select("game_id", "is_home", *[F.round(c, 6).alias(c) for c in ROLL_SUB])
    f = P.fill_zero(f, ROLL_SUB)
    return P.prefix_columns(f, "home_", ROLL_SUB, keep=["game_id", "is_home"])


# --------------------------------------------------------------------------- D1, D3, D5
@register("D1_derive_season", with_ctes() + "SELECT game_id, date, CAST(CASE WHEN month(date) >= 10 THEN year(date) + 1 ELSE year(date) END AS INTEGER) AS season FROM games")
def q_derive(spark, sf):
    return J.derive_season(load_games(spark, sf).select("game_id", "date"))


@register("D3_backfill_report", with_ctes(f"""
d AS (SELECT CAST(generate_series AS DATE) AS date FROM generate_series((SELECT min(date) FROM games), (SELECT max(date) FROM games), INTERVAL 1 DAY))""",
                                           f"c AS (SELECT date, count(*) AS n FROM games WHERE {PLAYED} GROUP BY date)")
          + "SELECT d.date, CAST(coalesce(c.n, 0) AS BIGINT) AS games_added FROM d LEFT JOIN c ON c.date = d.date")
def q_backfill(spark, sf):
    games, dim, sb, bx, _ = _landing(spark, sf)
    lo, hi = games.select(F.min("date")).scalar(), games.select(F.max("date")).scalar()
    return J.backfill_report(sb, bx, dim, lo, hi)


MIDDLE = "(SELECT min(date) + CAST(date_diff('day', min(date), max(date)) // 2 AS INTEGER) FROM games)"


@register("D3_backfill", with_ctes("""
spine AS (SELECT CAST(generate_series AS DATE) AS date FROM generate_series((SELECT min(date) FROM games), (SELECT max(date) FROM games), INTERVAL 1 DAY)),
c AS (SELECT date, count(*) AS planned, count(*) FILTER (WHERE """ + PLAYED + """) AS n FROM games GROUP BY date),
d AS (SELECT s.date, coalesce(n, 0) AS n, coalesce(n > 0 AND n >= planned, false) AS complete FROM spine s LEFT JOIN c ON c.date = s.date)""")
          + f"""
SELECT 1 AS run, date, CAST(n AS BIGINT) AS games_added, true AS pending FROM d WHERE date <= {MIDDLE}
UNION ALL SELECT 2, date, CAST(CASE WHEN complete AND date <= {MIDDLE} THEN 0 ELSE n END AS BIGINT), NOT (complete AND date <= {MIDDLE}) FROM d""")
def q_backfill_runs(spark, sf):
    """The first half of the days backfilled, then all days: the second run takes what is still open."""
    games, dim, sb, bx, _ = _landing(spark, sf)
    lo, hi = games.agg(F.min("date"), F.max("date")).first()
    table = S.create_table(spark, S.scratch_path(spark, "backfill"), games.filter(F.col("score_home").isNull()))
    ledger = S.scratch_path(spark, "ledger")
    runs = [J.backfill(spark, table.path, ledger, sb, bx, dim, lo, end) for end in (lo + (hi - lo) // 2, hi)]
    return runs[0].withColumn("run", F.lit(1)).unionByName(runs[1].withColumn("run", F.lit(2)))


SNAP_W = [3, 5, 10, 15]


def _snapshot_sql():
    from tandem.plans.oracle import feature_select
    fs = feature_select(stats=["points_scored", "points_allowed", "total_points", "win"], std_stats=[],
                        rest=False, season=False, pace=False, trend=False)
    sel = ", ".join(f"points_scored_roll_{w} AS avg_points_scored_{w}, points_allowed_roll_{w} AS avg_points_allowed_{w}, "
                    f"total_points_roll_{w} AS avg_total_points_{w}, win_roll_{w} AS win_rate_{w}, total_points_roll_{w} AS avg_pace_{w}"
                    for w in SNAP_W)
    return with_ctes(f"tf AS (SELECT team, date, season, is_home, game_id, {fs} FROM long)",
                     f"lt AS (SELECT team, date, season, {sel}, row_number() OVER (PARTITION BY team ORDER BY date DESC, is_home ASC, game_id DESC) AS rn FROM tf)",
                     "gp AS (SELECT team, CAST(count(*) AS BIGINT) AS games_played FROM long GROUP BY team)",
                     "rec AS (SELECT team, CAST(sum(win) AS BIGINT) AS season_wins, avg(points_scored) AS season_avg_scored, "
                     "avg(points_allowed) AS season_avg_allowed, CAST(count(*) - sum(win) AS BIGINT) AS season_losses FROM long "
                     "WHERE season = (SELECT max(season) FROM games) GROUP BY team)") + \
        ("SELECT lt.* EXCLUDE (rn), gp.games_played, coalesce(rec.season_wins, 0) AS season_wins, rec.season_avg_scored, "
         "rec.season_avg_allowed, coalesce(rec.season_losses, 0) AS season_losses FROM lt JOIN gp USING (team) "
         "LEFT JOIN rec USING (team) WHERE lt.rn = 1")


@register("D5_team_snapshot", _snapshot_sql())
def q_snapshot(spark, sf):
    return J.team_snapshot(load_games(spark, sf))


@register("D5_incremental_snapshot", _snapshot_sql())
def q_snapshot_incremental(spark, sf):
    """The snapshot after two refreshes of stored state: the first delta holds later events, the second
    later ones and corrections of old ones. It equals the snapshot of the whole table."""
    games = load_games(spark, sf)
    gid = F.col("game_id")
    lo, hi = games.agg(F.min("date"), F.max("date")).first()
    cuts = [lo + (hi - lo) * k / 4 for k in (2, 3)]
    wrong = (gid % 40 == 7) & (F.col("date") < F.lit(cuts[0]))  # rows whose first delivery was wrong
    first = games.withColumn("score_home", F.when(wrong, F.lit(1).cast("long")).otherwise(F.col("score_home")))
    table = S.create_table(spark, S.scratch_path(spark, "inc-games"), first.filter(F.col("date") < F.lit(cuts[0])))
    state = J.snapshot_state(spark, S.scratch_path(spark, "inc-state"))
    state.rebuild(team_games(table.read()))
    deltas = [games.filter((F.col("date") >= F.lit(cuts[0])) & (F.col("date") < F.lit(cuts[1]))),
              games.filter((F.col("date") >= F.lit(cuts[1])) | wrong)]
    for delta in deltas:
        S.upsert_into(spark, table.path, delta, ["game_id"])
        J.refresh_state(state, delta, table.read())
    return J.snapshot_from_state(state)


@register("S14_team_stats_upsert", f"SELECT * REPLACE (CASE WHEN games_played % 2 = 0 THEN games_played + 1 "
          f"ELSE games_played END AS games_played) FROM ({_snapshot_sql()})")
def q_team_stats_upsert(spark, sf):
    """A delta that changes half of the teams replaces their rows by (team, date)."""
    snap = J.team_snapshot(load_games(spark, sf))
    changed = snap.filter(F.col("games_played") % 2 == 0).withColumn("games_played", F.col("games_played") + 1)
    return S.upsert_latest(snap, changed, S.TEAM_STATS_KEY)


# --------------------------------------------------------------------------- J4, S12
PRED_SQL = ["f AS (SELECT game_id, is_home, "
            f"avg(points_scored) OVER (PARTITION BY team {TEAM_ORDER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS s10, "
            f"avg(points_allowed) OVER (PARTITION BY team {TEAM_ORDER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS a10 FROM long)",
            "p0 AS (SELECT g.date AS game_date, g.away, g.home, g.season, (h.s10 + a.a10) / 2 + (a.s10 + h.a10) / 2 AS predicted_total, "
            "g.total AS vegas_total FROM games g JOIN f h ON h.game_id = g.game_id AND h.is_home = 1 "
            "JOIN f a ON a.game_id = g.game_id AND a.is_home = 0)",
            "preds AS (SELECT * FROM p0 WHERE predicted_total IS NOT NULL UNION ALL "
            "SELECT * FROM p0 WHERE predicted_total IS NOT NULL AND season = (SELECT max(season) FROM games))"]


def _prediction_log(spark, sf):
    """A prediction log derived from the data: one row per event with an
    estimate, plus a re-run of the latest season (append-only duplicates)."""
    from tandem.plans.queries_eval import scored_frame
    s = scored_frame(spark, sf).select(F.col("date").alias("game_date"), "away", "home", "season",
                                       F.col("prediction").alias("predicted_total"), F.col("total").alias("vegas_total"))
    s = S.written(s, "prediction-log")  # the re-run, its season and the log's readers do not score the events again
    latest = s.select(F.max("season")).scalar()
    return s.unionByName(s.filter(F.col("season") == latest))


@register("J4_settle_predictions", with_ctes(*PRED_SQL, f"done AS (SELECT date AS game_date, away, home, arg_max(CAST(score_home + score_away AS DOUBLE), game_id) AS actual_total FROM games WHERE {PLAYED} GROUP BY ALL)")
          + "SELECT p.game_date, p.away, p.home, round(p.predicted_total, 6) AS predicted_total, d.actual_total, "
            "round(p.predicted_total - d.actual_total, 6) AS prediction_error FROM preds p LEFT JOIN done d USING (game_date, away, home)")
def q_settle(spark, sf):
    log = _prediction_log(spark, sf)
    settled = J.settle_predictions(log, load_games(spark, sf))
    return settled.select("game_date", "away", "home", F.round("predicted_total", 6).alias("predicted_total"),
                          "actual_total", F.round("prediction_error", 6).alias("prediction_error"))


@register("S12_append_predictions", with_ctes(*PRED_SQL)
          + "SELECT game_date, away, home, round(predicted_total, 6) AS predicted_total, vegas_total, 'v1.0beta_2DROPTABLE' AS model_version FROM preds "
            "UNION ALL SELECT game_date, away, home, round(predicted_total, 6), vegas_total, 'v1.0beta_2DROPTABLE' FROM preds")
def q_append(spark, sf):
    """Validated, sanitised prediction rows appended twice to a Parquet log
    (re-runs add rows), read back whole."""
    rows = S.prediction_rows(_prediction_log(spark, sf), "v1.0 beta_2; DROP TABLE", date_col="game_date",
                             pred="predicted_total", line="vegas_total")
    path = S.scratch_path(spark, "predictions")
    S.append_predictions(rows, path)
    S.append_predictions(rows, path)
    return spark.read.parquet(path).withColumn("predicted_total", F.round("predicted_total", 6))


# --------------------------------------------------------------------------- slate: D8, J9, S13, J3/L9, L11/L12, A16, D9
def _slate(spark, sf):
    games, dim, sb, bx, _ = _landing(spark, sf, feeds=("scoreboard",))
    slate = J.build_slate(sb, dim)
    return games, J.attach_lines(slate, _lines(games))


SLATE_SQL = [LINES_SQL,
             f"slate AS (SELECT {GID} AS game_id, g.date AS game_date, g.away, g.home, '7:30 pm ET' AS game_time, "
             "CAST(1 AS INTEGER) AS game_status, TRY_CAST(nullif(l.line, 'nan') AS DOUBLE) AS vegas_total FROM games g "
             f"LEFT JOIN lines l ON l.game_date = g.date AND l.away = g.away AND l.home = g.home WHERE NOT ({PLAYED}))"]


@register("D8_J9_build_slate", with_ctes(*SLATE_SQL) + "SELECT * FROM slate")
def q_slate(spark, sf):
    """Scheduled events of the feed, ids resolved to codes, lines attached."""
    return _slate(spark, sf)[1]


@register("D8_slate_of_date", with_ctes() + f"""
SELECT {GID} AS game_id, date AS game_date, away, home, CASE WHEN {PLAYED} THEN 'Final' ELSE '7:30 pm ET' END AS game_time,
  CAST(CASE WHEN {PLAYED} THEN 3 ELSE 1 END AS INTEGER) AS game_status FROM games WHERE date = (SELECT max(date) FROM games)""")
def q_slate_day(spark, sf):
    """One day's events, whatever their status, as the original lists them."""
    games, dim, sb, _, _ = _landing(spark, sf, feeds=("scoreboard",))
    return J.build_slate(sb, dim, date=games.agg(F.max("date")).first()[0], all_statuses=True)


@register("S13_scheduled_upsert", with_ctes(*SLATE_SQL, """
u AS (SELECT game_date, away, home, game_time AS scheduled_time, vegas_total, 0 AS src FROM slate
      UNION ALL SELECT game_date, away, home, game_time, vegas_total + 0.5, 1 FROM slate WHERE vegas_total IS NOT NULL)""",
                                            "r AS (SELECT *, row_number() OVER (PARTITION BY game_date, away, home ORDER BY src DESC) AS rn FROM u)")
          + "SELECT game_date, away, home, scheduled_time, vegas_total FROM r WHERE rn = 1")
def q_sched(spark, sf):
    """Schedule rows upserted by (game_date, away, home): a later line wins."""
    _, slate = _slate(spark, sf)
    base = slate.select("game_date", "away", "home", F.col("game_time").alias("scheduled_time"), "vegas_total")
    moved = base.filter(F.col("vegas_total").isNotNull()).withColumn("vegas_total", F.col("vegas_total") + 0.5)
    return S.upsert_latest(base, moved, S.SCHEDULE_KEY)


SERVE_OUT = ["game_id", "home_points_scored_roll_10", "away_total_points_std_5", "home_days_rest",
             "away_game_num", "expected_total_10", "combined_volatility_15", "both_rested",
             "home_early_season", "line_vs_expected_10"]


def _serve_sql(known_line=False):
    cols = side_columns()
    pick = lambda side, team: (
        f"{side} AS (SELECT s.game_id, " + ", ".join(f"f.{c}" for c in cols)
        + f", row_number() OVER (PARTITION BY s.game_id ORDER BY f.date DESC, f.is_home ASC, f.game_id DESC) AS rn "
          f"FROM slate s JOIN feat f ON f.team = s.{team} AND f.date < s.game_date)")
    sel = ", ".join([f"h.{c} AS home_{c}" for c in cols] + [f"a.{c} AS away_{c}" for c in cols])
    pair = (f"pair0 AS (SELECT s.*, {sel} FROM slate s JOIN hs h ON h.game_id = s.game_id AND h.rn = 1 "
            f"JOIN aws a ON a.game_id = s.game_id AND a.rn = 1)")
    fix = ("pair1 AS (SELECT * REPLACE (coalesce(home_days_rest, 2) AS home_days_rest, coalesce(away_days_rest, 2) AS away_days_rest, "
           "coalesce(home_game_num, 40) AS home_game_num, coalesce(away_game_num, 40) AS away_game_num, "
           "coalesce(home_is_b2b, 0) AS home_is_b2b, coalesce(away_is_b2b, 0) AS away_is_b2b) FROM pair0)")
    mu = matchup_select(line="vegas_total" if known_line else "CAST(NULL AS DOUBLE)", target=False)
    return [*SLATE_SQL, FEAT_CTE, pick("hs", "home"), pick("aws", "away"), pair, fix,
            "pair AS (SELECT * FROM pair1)" if known_line else "pair AS (SELECT * EXCLUDE (vegas_total) FROM pair1)",
            f"served AS (SELECT *, {mu} FROM pair)"]


def _served(spark, sf):
    games, slate = _slate(spark, sf)
    feats = team_features(games)
    return J.serve_features(slate, feats)


@register("J3_L9_serve_features", with_ctes(*_serve_sql()) + "SELECT "
          + ", ".join(f"round({c}, 6) AS {c}" if ("std" in c or "volatility" in c) else c for c in SERVE_OUT) + " FROM served")
def q_serve(spark, sf):
    """Slate features from each side's latest feature row strictly before the
    event date (as-of join J3), matchup features with the line unknown (Q5)."""
    s = _served(spark, sf)
    return s.select(*[F.round(c, 6).alias(c) if ("std" in c or "volatility" in c) else F.col(c) for c in SERVE_OUT])


@register("L9_serve_two_phase", with_ctes(*_serve_sql()) + "SELECT "
          + ", ".join(f"round({c}, 6) AS {c}" if ("std" in c or "volatility" in c) else c for c in SERVE_OUT) + " FROM served")
def q_serve_two_phase(spark, sf):
    """The slate's features from the matched rows and their 15 predecessors alone, forced splits included."""
    from tandem.operators.windows import SplitPolicy
    games, slate = _slate(spark, sf)
    s = J.serve_from_history(slate, team_games(games), split=SplitPolicy(force=True))
    return s.select(*[F.round(c, 6).alias(c) if ("std" in c or "volatility" in c) else F.col(c) for c in SERVE_OUT])


LINE_OUT = SERVE_OUT + ["line_vs_expected_3", "home_over_tendency_5", "away_over_tendency_15", "vegas_total"]


@register("L9_line_known", with_ctes(*_serve_sql(known_line=True)) + "SELECT "
          + ", ".join(f"round({c}, 6) AS {c}" if ("std" in c or "volatility" in c) else c for c in LINE_OUT) + " FROM served")
def q_serve_line(spark, sf):
    """Q5 mended: features that depend on the line, where the slate knows it."""
    games, slate = _slate(spark, sf)
    s = J.serve_from_history(slate, team_games(games), line_col="vegas_total")
    return s.select(*[F.round(c, 6).alias(c) if ("std" in c or "volatility" in c) else F.col(c) for c in LINE_OUT])


REC_SQL = ("rec AS (SELECT game_id, round_even(expected_total_10, 1) AS predicted_total, vegas_total, "
           "CASE WHEN vegas_total IS NOT NULL THEN round_even(expected_total_10 - vegas_total, 1) END AS edge, "
           "CASE WHEN vegas_total IS NULL THEN NULL WHEN expected_total_10 > vegas_total THEN 'OVER' ELSE 'UNDER' END AS recommendation, "
           "CASE WHEN vegas_total IS NULL THEN NULL WHEN abs(round_even(expected_total_10 - vegas_total, 1)) >= 5 THEN 'HIGH' "
           "WHEN abs(round_even(expected_total_10 - vegas_total, 1)) >= 3 THEN 'MODERATE' ELSE 'SMALL' END AS confidence, "
           "game_date, away, home, game_time FROM served s JOIN (SELECT game_id AS gid, vegas_total FROM slate) v ON v.gid = s.game_id "
           "WHERE expected_total_10 IS NOT NULL)")


def _recommended(spark, sf):
    games, slate = _slate(spark, sf)
    s = J.serve_from_history(slate, team_games(games))
    s = s.filter(F.col("expected_total_10").isNotNull()).withColumn("predicted_total", F.col("expected_total_10"))
    return J.recommend(s)


@register("L10_L11_L12_recommend", with_ctes(*_serve_sql(), REC_SQL)
          + "SELECT game_id, predicted_total, vegas_total, edge, recommendation, confidence FROM rec")
def q_recommend(spark, sf):
    """Slate scored with the matchup estimate (fixed predictor), rounded to
    0.1 half-even; edge, OVER/UNDER pick and confidence tier."""
    return _recommended(spark, sf).select("game_id", "predicted_total", "vegas_total", "edge",
                                          "recommendation", "confidence")


@register("A16_slate_summary", with_ctes(*_serve_sql(), REC_SQL) + """
SELECT CAST(count(*) AS BIGINT) AS predicted, CAST(count(*) FILTER (WHERE recommendation = 'OVER') AS BIGINT) AS overs,
  CAST(count(*) FILTER (WHERE recommendation = 'UNDER') AS BIGINT) AS unders,
  CAST(count(*) FILTER (WHERE abs(edge) >= 5) AS BIGINT) AS high_confidence FROM rec""")
def q_slate_summary(spark, sf):
    return slate_summary(_recommended(spark, sf))


@register("D9_record_slate", with_ctes(*_serve_sql(), REC_SQL) + """
SELECT game_date, away, home, predicted_total, vegas_total, 'v1.0' AS model_version FROM rec
WHERE vegas_total IS NOT NULL AND vegas_total <> 0""")
def q_record(spark, sf):
    _, preds = J.record_slate(_recommended(spark, sf))
    return preds


@register("D9_record_slate_writes", with_ctes(*_serve_sql(), REC_SQL, """
ok AS (SELECT * FROM rec WHERE vegas_total IS NOT NULL AND vegas_total <> 0),
one AS (SELECT *, row_number() OVER (PARTITION BY game_date, away, home ORDER BY game_time DESC, vegas_total DESC) AS rn FROM ok)""") + """
SELECT 'schedule' AS kind, game_date, away, home, game_time AS scheduled_time, vegas_total, CAST(NULL AS DOUBLE) AS predicted_total
FROM one WHERE rn = 1 UNION ALL SELECT 'log', game_date, away, home, NULL, vegas_total, predicted_total FROM ok""")
def q_record_writes(spark, sf):
    """D9 with its writes, read back: the schedule upserted, the predictions logged."""
    from tandem.sources.versions import VersionedTable
    scored = _recommended(spark, sf)
    dim = entity_dimension(read_table(spark, sf, "customer"))
    paths = [S.scratch_path(spark, x) for x in ("schedule", "prediction-log")]
    J.record_slate_into(spark, *paths, scored, entities=dim.select("code"))
    sched, log = (VersionedTable(spark, p, "game_month").read() for p in paths)
    keys = ["game_date", "away", "home"]
    return sched.select(F.lit("schedule").alias("kind"), *keys, "scheduled_time", "vegas_total").unionByName(
        log.select(F.lit("log").alias("kind"), *keys, "vegas_total", "predicted_total"), allowMissingColumns=True)


VALID_SQL = """
x AS (SELECT game_id, CASE WHEN game_id % 4 = 1 THEN strftime(date, '%d.%m.%Y') ELSE strftime(date, '%Y-%m-%d') END AS game_date,
  CASE WHEN game_id % 4 = 2 THEN 'nobody' ELSE away END AS away, CASE WHEN game_id % 9 = 5 THEN upper(home) ELSE home END AS home,
  CASE WHEN game_id % 4 = 3 THEN 'pick' ELSE CAST(total AS VARCHAR) END AS vegas_total FROM games)"""


@register("S12_S13_validation", with_ctes(VALID_SQL) + """
SELECT game_id, CASE game_id % 4 WHEN 1 THEN 'invalid date' WHEN 2 THEN 'invalid away entity' WHEN 3 THEN 'invalid line' END AS reason FROM x""")
def q_validation(spark, sf):
    """Schedule rows with dates, entities and lines that do not pass, and why."""
    gid = F.col("game_id") % 4
    rows = load_games(spark, sf).select(
        "game_id", F.when(gid == 1, F.date_format("date", "dd.MM.yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd")).alias("game_date"),
        F.when(gid == 2, "nobody").otherwise(F.col("away")).alias("away"),
        F.when(F.col("game_id") % 9 == 5, F.upper("home")).otherwise(F.col("home")).alias("home"),
        F.when(gid == 3, "pick").otherwise(F.col("total").cast("string")).alias("vegas_total"))
    good, bad = S.validated(rows, entities=entity_dimension(read_table(spark, sf, "customer")).select("code"))
    return good.select("game_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("game_id", "reason"))


@register("P13_align_schema", with_ctes(*_serve_sql()) + """
SELECT game_id, home_points_scored_roll_3, away_days_rest, CAST(NULL AS DOUBLE) AS line_vs_expected_3,
  CAST(NULL AS DOUBLE) AS not_a_feature FROM served""")
def q_align(spark, sf):
    """Serving rows aligned to an expected column list: missing -> NULL."""
    return P.align_schema(_served(spark, sf), ["game_id", "home_points_scored_roll_3", "away_days_rest",
                                               "line_vs_expected_3", "not_a_feature"])


@register("J3_L9_serve_features_split_forced", with_ctes(*_serve_sql()) + "SELECT "
          + ", ".join(f"round({c}, 6) AS {c}" if ("std" in c or "volatility" in c) else c for c in SERVE_OUT) + " FROM served")
def q_serve_split(spark, sf):
    """J3/L9 with every entity split into day buckets: the as-of match of a
    bucket without feature rows comes from the one-row halo."""
    from tandem.operators.windows import SplitPolicy
    games, slate = _slate(spark, sf)
    forced = SplitPolicy(force=True)
    s = J.serve_features(slate, team_features(games, split=forced), split=forced)
    return s.select(*[F.round(c, 6).alias(c) if ("std" in c or "volatility" in c) else F.col(c) for c in SERVE_OUT])



def _serve_post_sql():
    from tandem.plans import oracle as O
    O.INCLUSIVE["on"] = True
    try:
        feat = ("feat AS (SELECT game_id, is_home, team, date, season, total, points_scored, points_allowed, "
                + O.feature_select() + " FROM long)")
    finally:
        O.INCLUSIVE["on"] = False
    cols = side_columns()
    season_of = "CAST(CASE WHEN month(s.game_date) >= 10 THEN year(s.game_date) + 1 ELSE year(s.game_date) END AS INTEGER)"
    adj = {"days_rest": "CAST(date_diff('day', f.date, s.game_date) AS INTEGER)",
           "is_b2b": "CAST(date_diff('day', f.date, s.game_date) = 1 AS INTEGER)",
           "long_rest": "CAST(date_diff('day', f.date, s.game_date) >= 4 AS INTEGER)",
           "game_num": f"CAST(CASE WHEN {season_of} = f.season THEN f.game_num + 1 ELSE 1 END AS INTEGER)"}
    gn = adj["game_num"]
    adj["season_phase"] = (f"CASE WHEN {gn} > 0 AND {gn} <= 25 THEN 'early' WHEN {gn} > 25 AND {gn} <= 55 THEN 'mid' "
                           f"WHEN {gn} > 55 AND {gn} <= 100 THEN 'late' END")
    for c in ("season_ppg", "season_papg", "season_total_avg", "season_win_pct"):
        adj[c] = f"CASE WHEN {season_of} = f.season THEN f.{c} END"
    sel = ", ".join(f"{adj.get(c, 'f.' + c)} AS {c}" for c in cols)
    pick = lambda side, team: (
        f"{side} AS (SELECT s.game_id, {sel}, row_number() OVER (PARTITION BY s.game_id "
        f"ORDER BY f.date DESC, f.is_home ASC, f.game_id DESC) AS rn "
        f"FROM slate s JOIN feat f ON f.team = s.{team} AND f.date < s.game_date)")
    both = ", ".join([f"h.{c} AS home_{c}" for c in cols] + [f"a.{c} AS away_{c}" for c in cols])
    pair = (f"pair AS (SELECT s.* EXCLUDE (vegas_total), {both} FROM slate s JOIN hs h ON h.game_id = s.game_id AND h.rn = 1 "
            f"JOIN aws a ON a.game_id = s.game_id AND a.rn = 1)")
    mu = matchup_select(line="CAST(NULL AS DOUBLE)", target=False)
    return with_ctes(*SLATE_SQL, feat, pick("hs", "home"), pick("aws", "away"), pair,
                     f"served AS (SELECT *, {mu} FROM pair)")


POST_OUT = SERVE_OUT + ["home_game_num", "away_days_rest", "home_season_ppg", "away_season_phase", "home_is_b2b"]


@register("L9_serve_features_post_game", _serve_post_sql() + "SELECT "
          + ", ".join(f"round({c}, 6) AS {c}" if ("std" in c or "volatility" in c) else c for c in dict.fromkeys(POST_OUT))
          + " FROM served")
def q_serve_post(spark, sf):
    """L9 fixed mode (Q3): each side's windows end at its latest game, rest is
    counted to the scheduled date and the game number continues the season."""
    from tandem.operators.longform import team_games
    from tandem.operators.windows import trailing_features
    games, slate = _slate(spark, sf)
    feats = trailing_features(team_games(games), inclusive=True)
    s = J.serve_features(slate, feats, post_game=True)
    return s.select(*[F.round(c, 6).alias(c) if ("std" in c or "volatility" in c) else F.col(c)
                      for c in dict.fromkeys(POST_OUT)])


@register("S13_scheduled_for_date", with_ctes(*SLATE_SQL) + """
SELECT game_date, away, home, game_time AS scheduled_time, vegas_total FROM slate
WHERE game_date = (SELECT max(game_date) FROM slate)""")
def q_sched_day(spark, sf):
    """The slate of one day (the latest scheduled date) by equality lookup."""
    _, slate = _slate(spark, sf)
    sched = slate.select("game_date", "away", "home", F.col("game_time").alias("scheduled_time"), "vegas_total")
    return S.scheduled_for_date(sched, sched.select(F.max("game_date")).scalar())
