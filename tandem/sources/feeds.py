"""Landing-zone readers for the results feed.

The reference polls an HTTP API per date and per event. Here the responses
land as JSON documents in a folder and are read in bulk with explicit
schemas: a scoreboard document per date (``GameHeader`` array) and a box
score document per event (``TeamStats`` array, element 1 = away, 2 = home).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.sources.dims import map_codes

SCOREBOARD_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("GameHeader", T.ArrayType(T.StructType([
        T.StructField("GAME_ID", T.StringType()),
        T.StructField("HOME_TEAM_ID", T.LongType()),
        T.StructField("VISITOR_TEAM_ID", T.LongType()),
        T.StructField("GAME_STATUS_ID", T.IntegerType()),
        T.StructField("GAME_STATUS_TEXT", T.StringType()),
    ]))),
])

BOXSCORE_SCHEMA = T.StructType([
    T.StructField("GAME_ID", T.StringType()),
    T.StructField("TeamStats", T.ArrayType(T.StructType([
        T.StructField("TEAM_ID", T.LongType()),
        T.StructField("TEAM_ABBREVIATION", T.StringType()),
        T.StructField("PTS", T.LongType()),
    ]))),
])

SEASON_LOG_SCHEMA = T.StructType([
    T.StructField("GAME_ID", T.StringType()),
    T.StructField("GAME_DATE", T.StringType()),
    T.StructField("TEAM_ID", T.LongType()),
    T.StructField("TEAM_ABBREVIATION", T.StringType()),
    T.StructField("MATCHUP", T.StringType()),
    T.StructField("WL", T.StringType()),
    T.StructField("PTS", T.LongType()),
    T.StructField("PLUS_MINUS", T.DoubleType()),
])

FINAL = 3
CORRUPT = "_corrupt_record"


def _documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Landed JSON documents; what does not parse, or does not fit the schema, keeps its text."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path))


def _split(raw: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    """(good documents, bad ones as ``raw`` and ``reason``)."""
    tagged = raw.withColumn("reason", F.when(F.col(CORRUPT).isNotNull(), "unparsable").otherwise(reason))
    body = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*[c for c in raw.columns if c != CORRUPT])))
    return (tagged.filter(F.col("reason").isNull()).drop("reason", CORRUPT),
            tagged.filter(F.col("reason").isNotNull()).select(body.alias("raw"), "reason"))


def checked_scoreboard(spark: SparkSession, path: str, date=None) -> tuple[DataFrame, DataFrame]:
    """S9 with a quarantine: (event rows, bad documents). Bad are documents that do not parse, whose date is
    no date, or that hold an event without an id; one without a GameHeader is no error (no events that day)."""
    no_id = F.exists("GameHeader", lambda g: g["GAME_ID"].isNull())
    good, bad = _split(_documents(spark, path, SCOREBOARD_SCHEMA),
                       F.when(F.col("date").try_cast("date").isNull(), "no date").when(no_id, "event without id"))
    return scoreboard_rows(good, date), bad


def checked_boxscore(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S10 with a quarantine: (box score rows, bad documents). Bad are documents that do not parse, lack the
    event's id, or name sides without points; fewer than two sides is an event not played yet."""
    sides = F.coalesce(F.size("TeamStats"), F.lit(0)) >= 2
    no_points = F.exists("TeamStats", lambda t: t["PTS"].isNull() | t["TEAM_ABBREVIATION"].isNull())
    good, bad = _split(_documents(spark, path, BOXSCORE_SCHEMA),
                       F.when(F.col("GAME_ID").isNull(), "no id").when(sides & no_points, "side without points or name"))
    return boxscore_rows(good), bad


def scoreboard_rows(raw: DataFrame, date=None) -> DataFrame:
    """S9 over already-loaded documents: one row per event of the feed;
    documents without a GameHeader produce no rows."""
    if date is not None:
        raw = raw.filter(F.col("date") == F.lit(date).cast("string"))
    g = raw.select(F.to_date("date").alias("date"), F.explode("GameHeader").alias("g"))
    return g.select(F.col("g.GAME_ID").alias("game_id"), "date",
                    F.col("g.HOME_TEAM_ID").alias("home_team_id"),
                    F.col("g.VISITOR_TEAM_ID").alias("away_team_id"),
                    F.col("g.GAME_STATUS_ID").alias("game_status"),
                    F.col("g.GAME_STATUS_TEXT").alias("game_time"))


def read_scoreboard(spark: SparkSession, path: str, date=None) -> DataFrame:
    """Scoreboard documents -> event rows (optionally one date)."""
    return scoreboard_rows(spark.read.schema(SCOREBOARD_SCHEMA).json(path), date)


def boxscore_rows(raw: DataFrame) -> DataFrame:
    """S10 over loaded documents: two-element team list -> one row; fewer
    than two elements -> dropped."""
    b = raw.filter(F.coalesce(F.size("TeamStats"), F.lit(0)) >= 2).select(
        F.col("GAME_ID").alias("game_id"),
        F.element_at("TeamStats", 1).alias("a"), F.element_at("TeamStats", 2).alias("h"))
    return b.select("game_id",
                    F.col("a.TEAM_ID").alias("away_team_id"), F.col("a.TEAM_ABBREVIATION").alias("away_abbrev"),
                    F.col("h.TEAM_ID").alias("home_team_id"), F.col("h.TEAM_ABBREVIATION").alias("home_abbrev"),
                    F.col("a.PTS").alias("score_away"), F.col("h.PTS").alias("score_home"))


def read_boxscore(spark: SparkSession, path: str) -> DataFrame:
    """Box score documents -> one row per event with both sides."""
    return boxscore_rows(spark.read.schema(BOXSCORE_SCHEMA).json(path))


def completed_scores(scoreboard: DataFrame, boxscore: DataFrame, dim: DataFrame) -> DataFrame:
    """Final events of the scoreboard joined to their box scores (the
    reference fetches one box score per event); codes mapped with J5."""
    final = scoreboard.filter(F.col("game_status") == FINAL).select("game_id", "date")
    j = final.join(boxscore, "game_id")
    j = map_codes(j, "away_abbrev", dim, "away")
    j = map_codes(j, "home_abbrev", dim, "home")
    return j.select("date", "away", "home", "score_away", "score_home", "game_id")


def season_finder(log: DataFrame, dim: DataFrame, reference_mode: bool = False) -> DataFrame:
    """Team-level season log -> events.

    ``reference_mode``: first row per GAME_ID (home row preferred, then team
    id), ``is_home`` = no '@' in MATCHUP, one side's points only. Default:
    both rows of the event pivoted into one row with both sides' points."""
    rows = log.select(F.col("GAME_ID").alias("game_id"), F.to_date("GAME_DATE").alias("date"),
                      F.col("TEAM_ID").alias("team_id"), F.col("TEAM_ABBREVIATION").alias("abbrev"),
                      (~F.col("MATCHUP").contains("@")).alias("is_home"),
                      F.col("WL").alias("win_loss"), F.col("PTS").alias("points"),
                      F.col("PLUS_MINUS").alias("plus_minus"))
    rows = map_codes(rows, "abbrev", dim, "team")
    if reference_mode:
        from pyspark.sql import Window
        w = Window.partitionBy("game_id").orderBy(F.col("is_home").desc(), F.col("team_id"))
        return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    side = lambda home: F.first(F.when(F.col("is_home") == home, F.struct("team", "points")), ignorenulls=True)
    p = rows.groupBy("game_id").agg(F.first("date").alias("date"), side(True).alias("h"), side(False).alias("a"))
    return p.select("game_id", "date", F.col("a.team").alias("away"), F.col("h.team").alias("home"),
                    F.col("a.points").alias("score_away"), F.col("h.points").alias("score_home"))


# --------------------------------------------------------------------------- test landing data
def landing_from_games(games: DataFrame, path: str,
                       feeds: tuple[str, ...] = ("scoreboard", "boxscore", "season_log")) -> dict[str, str]:
    """Write feed documents derived from a games table (test landing zone):
    one scoreboard document per event (final when scored, else scheduled),
    one box score per event (a single element for unplayed events, so it is
    dropped by S10), a team-level season log (two rows per event). Every tenth
    entity is reported under its alias code. Returns the folder per feed."""
    key = lambda c: F.regexp_extract(F.col(c), r"(\d+)$", 1).cast("long")
    abbrev = lambda c: F.when(key(c) % 10 == 0, F.concat(F.lit("A"), key(c).cast("string"))).otherwise(F.upper(F.col(c)))
    played = F.col("score_home").isNotNull() & F.col("score_away").isNotNull()
    gid = F.lpad(F.col("game_id").cast("string"), 10, "0")
    sb = games.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.array(F.struct(
        gid.alias("GAME_ID"), key("home").alias("HOME_TEAM_ID"), key("away").alias("VISITOR_TEAM_ID"),
        F.when(played, F.lit(FINAL)).otherwise(F.lit(1)).alias("GAME_STATUS_ID"),
        F.when(played, F.lit("Final")).otherwise(F.lit("7:30 pm ET")).alias("GAME_STATUS_TEXT"))).alias("GameHeader"))
    side = lambda s: F.struct(key(s).alias("TEAM_ID"), abbrev(s).alias("TEAM_ABBREVIATION"),
                              F.col(f"score_{s}").alias("PTS"))
    bx = games.select(gid.alias("GAME_ID"),
                      F.when(played, F.array(side("away"), side("home"))).otherwise(F.array(side("home"))).alias("TeamStats"))
    log_side = lambda me, other, sep: F.struct(
        gid.alias("GAME_ID"), F.date_format("date", "yyyy-MM-dd").alias("GAME_DATE"), key(me).alias("TEAM_ID"),
        abbrev(me).alias("TEAM_ABBREVIATION"),
        F.concat(F.upper(F.col(me)), F.lit(sep), F.upper(F.col(other))).alias("MATCHUP"),
        F.when(F.col(f"score_{me}") > F.col(f"score_{other}"), F.lit("W")).otherwise(F.lit("L")).alias("WL"),
        F.col(f"score_{me}").alias("PTS"),
        (F.col(f"score_{me}") - F.col(f"score_{other}")).cast("double").alias("PLUS_MINUS"))
    log = (games.filter(played).select(F.explode(F.array(log_side("home", "away", " vs. "),
                                                         log_side("away", "home", " @ "))).alias("r"))
           .select("r.*"))
    docs = {"scoreboard": sb, "boxscore": bx, "season_log": log}
    out = {}
    for name in feeds:
        out[name] = f"{path}/{name}"
        docs[name].write.mode("overwrite").option("compression", "gzip").json(out[name])
    return out
