"""Composed jobs (D1-D5, D8, D9) and settlement / serving joins.

Each job is one set-based Spark plan over whole tables; "today" and date
ranges are parameters, never the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tandem.functions.names import CONFIDENCE_TIERS, DEFAULT_GAME_NUM, DEFAULT_REST, ROLLING_WINDOWS
from tandem.functions.scalars import number_of, round1, season_of
from tandem.operators.incremental import FeatureSpec, FeatureState
from tandem.operators.longform import team_games
from tandem.operators.matchup import over_under_features, side_feature_columns_of
from tandem.operators.windows import (GAME_ORDER, SplitPolicy, asof_latest, mark_hot, order_by, trailing_features,
                                      with_halo)
from tandem.sources.dims import map_feed_ids
from tandem.sources.feeds import completed_scores
from tandem.sources.store import (GAME_DEFAULTS, GAME_KEY, log_predictions, scratch_path, upsert_into, upsert_latest,
                                  upsert_schedule, written)
from tandem.sources.versions import VersionedTable


# --------------------------------------------------------------------------- D1, D2, D3
def derive_season(df: DataFrame, date_col: str = "date", start_month: int = 10) -> DataFrame:
    """season = year + 1 for months >= start_month."""
    return df.withColumn("season", season_of(F.col(date_col), start_month))


def feed_delta(scoreboard: DataFrame, boxscore: DataFrame, dim: DataFrame,
               reference_mode: bool = True) -> DataFrame:
    """D2 (delta part): completed events from the feed as games rows. In
    reference mode quarters are 0 and the line is absent (NULL); otherwise
    quarters are NULL too (unknown, not zero)."""
    d = derive_season(completed_scores(scoreboard, boxscore, dim))
    q = F.lit(0).cast("long") if reference_mode else F.lit(None).cast("long")
    quarters = {f"{p}_{s}": q for s in ("away", "home") for p in ("q1", "q2", "q3", "q4", "ot")}
    return d.withColumns({"game_id": F.col("game_id").cast("long"), "regular": F.lit(True), "playoffs": F.lit(False),
                          **quarters})


def between_dates(df: DataFrame, start=None, end=None, col: str = "date") -> DataFrame:
    """Rows from ``start`` to ``end`` (either may be open), pushed to the scan."""
    if start is not None:
        df = df.filter(F.col(col) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(col) <= F.lit(end).cast("date"))
    return df


def ingest(games: DataFrame, scoreboard: DataFrame, boxscore: DataFrame, dim: DataFrame,
           reference_mode: bool = True, start=None, end=None) -> DataFrame:
    """Feed delta of the given dates upserted into the games table by (date, away, home).
    Reference mode replaces whole rows (Q6), columns the feed lacks take their
    defaults; otherwise older non-NULL values survive where the feed has none."""
    delta = feed_delta(between_dates(scoreboard, start, end), boxscore, dim, reference_mode)
    return upsert_latest(games, delta, GAME_KEY, order_col="game_id", coalesce_old=not reference_mode,
                         defaults=GAME_DEFAULTS)


def backfill_report(scoreboard: DataFrame, boxscore: DataFrame, dim: DataFrame, start, end) -> DataFrame:
    """D3 (counts only): one row per calendar day in [start, end] with the number of completed
    events the feed holds; days without data stay visible with 0."""
    spine = _days(scoreboard.sparkSession, start, end)
    got = (completed_scores(scoreboard, boxscore, dim).groupBy("date")
           .agg(F.count(F.lit(1)).alias("games_added")))
    return spine.join(got, "date", "left").select("date", F.coalesce("games_added", F.lit(0)).alias("games_added"))


def _days(spark: SparkSession, start, end) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))


def backfill(spark: SparkSession, table_path: str, ledger_path: str, scoreboard: DataFrame, boxscore: DataFrame,
             dim: DataFrame, start, end, reference_mode: bool = True) -> DataFrame:
    """D3: ingest every day of [start, end] that has not been ingested yet, in one upsert.

    The ledger, a versioned table by month, lists the days that are done: those whose events in the
    feed are all final and have a box score. Days in it are neither read from the feed nor written
    again, so partitions without pending days keep their files; a day that the feed delivered in part
    is ingested as far as it goes and taken again by the next run. The ledger is committed after the
    games: a run killed in between repeats its days, which changes nothing (S4).

    Returns a row per day: games_added by this run, and ``pending`` (false: done before)."""
    ledger = VersionedTable(spark, ledger_path, "month")
    days = _days(spark, start, end)
    done = ledger.read().select("date") if ledger.current() else days.limit(0)
    pending = days.join(done, "date", "left_anti")
    feed = between_dates(scoreboard, start, end).join(pending, "date", "left_semi")
    delta = feed_delta(feed, boxscore, dim, reference_mode).persist()  # merged, and counted by day
    try:
        upsert_into(spark, table_path, delta, GAME_KEY, order_col="game_id", coalesce_old=not reference_mode,
                    defaults=GAME_DEFAULTS)
        added = delta.groupBy("date").agg(F.count(F.lit(1)).alias("games_added"))
        planned = feed.groupBy("date").agg(F.count(F.lit(1)).alias("planned"))
        complete = planned.join(added, "date").filter(F.col("games_added") >= F.col("planned"))
        ledger.commit(complete.select("date", "games_added", F.date_format("date", "yyyy-MM").alias("month")), replaced=[])
        report = (days.join(pending.withColumn("pending", F.lit(True)), "date", "left").join(added, "date", "left")
                  .select("date", F.coalesce("games_added", F.lit(0)).alias("games_added"),
                          F.coalesce("pending", F.lit(False)).alias("pending")))
        return spark.createDataFrame(report.collect(), report.schema)  # one row a day
    finally:
        delta.unpersist()


# --------------------------------------------------------------------------- D5
def team_snapshot(games: DataFrame, current_season: Column | int | None = None,
                  windows: list[int] | None = None, split: SplitPolicy = SplitPolicy()) -> DataFrame:
    """Per entity, its newest row's trailing means, all-time games played
    and the current season's record. Names follow the snapshot table
    (``avg_points_scored_w``, ``win_rate_w``, ``avg_pace_w``), filled from
    the real feature columns (the reference looks them up under names that
    do not exist, Q4)."""
    windows = windows or ROLLING_WINDOWS
    long = team_games(games)
    season = long.select(F.max("season")).scalar() if current_season is None else current_season
    now = F.coalesce(F.col("season") == season, F.lit(False))
    feats = trailing_features(long, stats=SNAPSHOT_STATS, windows=windows, std_stats=[], season_col=None, rest=False,
                              pace=False, trend=False, split=split)
    cols = {}
    for w in windows:
        for out, stat in (("avg_points_scored", "points_scored"), ("avg_points_allowed", "points_allowed"),
                          ("avg_total_points", "total_points"), ("win_rate", "win"), ("avg_pace", "total_points")):
            cols[f"{out}_{w}"] = F.col(f"{stat}_roll_{w}")
    # newest row, games played and season record in one aggregation over the partitioning of the windows
    row = F.struct("date", "season", *[c.alias(n) for n, c in cols.items()])
    newest = F.struct("date", (-F.col("is_home")).alias("h"), "game_id")
    here = lambda c: F.when(now, F.col(c))
    out = feats.groupBy("team").agg(
        F.max_by(row, newest).alias("_r"), F.count(F.lit(1)).alias("games_played"),
        F.count_if(now).alias("_games"), F.sum(here("win")).alias("_wins"),
        F.avg(here("points_scored")).alias("season_avg_scored"), F.avg(here("points_allowed")).alias("season_avg_allowed"))
    wins = F.coalesce("_wins", F.lit(0).cast("long"))
    return out.select("team", "_r.*", "games_played", wins.alias("season_wins"), "season_avg_scored", "season_avg_allowed",
                      (F.col("_games") - wins).alias("season_losses"))


SNAPSHOT_STATS = ["points_scored", "points_allowed", "total_points", "win"]


def snapshot_state(spark: SparkSession, path: str, windows: list[int] | None = None, buckets: int = 64) -> FeatureState:
    """The stored state that the team snapshot is refreshed from."""
    spec = FeatureSpec(stats=SNAPSHOT_STATS, windows=windows or ROLLING_WINDOWS, rest=False,
                       season_stats={"season_avg_scored": "points_scored", "season_avg_allowed": "points_allowed",
                                     "season_win_share": "win"})
    return FeatureState(spark, path, spec, buckets)


def refresh_state(state: FeatureState, delta_games: DataFrame, games: DataFrame) -> DataFrame:
    """D5, incremental: bring the state up to date with a delta that is already in ``games``.

    Rows after their entity's newest row only extend it. Corrections and rows of earlier dates make
    their entities start again from their history; all other entities cost nothing. Returns the entities touched."""
    long = team_games(delta_games)
    _, late = state.advance(long.select(*state.spec.columns))
    again = late.select("team").distinct()
    if not again.isEmpty():
        state.rebuild(team_games(games), again)
    return long.select("team").distinct()


def snapshot_from_state(state: FeatureState, current_season: int | None = None,
                        entities: DataFrame | None = None) -> DataFrame:
    """The rows of :func:`team_snapshot` from the state. The current season is the latest one that any
    entity has, so a snapshot is right for every entity also after a refresh of few."""
    windows = state.spec.windows
    rows = state.newest(entities)
    if current_season is None:
        season = state.rows().select(F.max("season")).scalar()
    else:
        season = F.lit(current_season)
    now = F.coalesce(F.col("season") == season, F.lit(False))
    # counters before the newest row, and the row itself
    played = F.col("season_rows") + 1
    total = lambda s: F.col(f"season_sum_{s}") + F.coalesce(F.col(s), F.lit(0))
    mean = lambda s: F.when(now, F.try_divide(total(s), F.col(f"season_count_{s}") + F.col(s).isNotNull().cast("int")))
    cols = {}
    for w in windows:
        for out, stat in (("avg_points_scored", "points_scored"), ("avg_points_allowed", "points_allowed"),
                          ("avg_total_points", "total_points"), ("win_rate", "win"), ("avg_pace", "total_points")):
            cols[f"{out}_{w}"] = F.col(f"{stat}_roll_{w}")
    return rows.select(
        "team", "date", "season", *[c.alias(n) for n, c in cols.items()], F.col("entity_rows").alias("games_played"),
        F.when(now, total("win")).otherwise(F.lit(0)).alias("season_wins"),
        mean("points_scored").alias("season_avg_scored"), mean("points_allowed").alias("season_avg_allowed"),
        F.when(now, played - total("win")).otherwise(F.lit(0)).alias("season_losses"))


# --------------------------------------------------------------------------- J4
def settle_predictions(predictions: DataFrame, games: DataFrame) -> DataFrame:
    """Every prediction row of a completed game gets ``actual_total`` and
    ``prediction_error = predicted - actual`` (a derived view over the
    immutable log; rows of unplayed or unknown games keep NULLs). Several games
    under one key count as one, the newest (latest wins, S4): the log keeps its rows."""
    done = (games.filter(F.col("score_home").isNotNull() & F.col("score_away").isNotNull())
            .groupBy(F.col("date").alias("game_date"), "away", "home")
            .agg(F.max_by((F.col("score_home") + F.col("score_away")).cast("double"), "game_id").alias("_actual")))
    j = predictions.drop("actual_total", "prediction_error").join(done, ["game_date", "away", "home"], "left")
    return j.withColumns({"actual_total": F.col("_actual"),
                          "prediction_error": F.col("predicted_total") - F.col("_actual")}).drop("_actual")


def settle_into(spark: SparkSession, log_path: str, games: DataFrame, start=None, end=None) -> dict:
    """J4 on the stored log (a versioned table by month): predictions for completed games of the given
    dates get their result, others stay as they are. Only the months of these dates are rewritten.

    Returns, observed during that write, ``games_settled`` (keys of completed games) and
    ``predictions_updated`` (log rows that got a result)."""
    log = VersionedTable(spark, log_path, "game_month")
    played = between_dates(games.filter(F.col("score_home").isNotNull() & F.col("score_away").isNotNull()), start, end)
    done, settled = Observation(), Observation()
    results = (played.groupBy(F.col("date").alias("game_date"), "away", "home")
               .agg(F.max_by((F.col("score_home") + F.col("score_away")).cast("double"), "game_id").alias("_actual"))
               .observe(done, F.count(F.lit(1)).alias("games_settled")))
    months = [name.split("=", 1)[1] for name in log.current().folders]  # as many as the log has months
    months = [m for m in months if (start is None or m >= str(start)[:7]) and (end is None or m <= str(end)[:7])]
    rows = log.read().filter(log.partitions_of(months))
    actual = F.coalesce("_actual", "actual_total")
    merged = (rows.join(results, ["game_date", "away", "home"], "left")
              .withColumns({"actual_total": actual, "prediction_error": F.col("predicted_total") - actual})
              .observe(settled, F.count_if(F.col("_actual").isNotNull()).alias("predictions_updated")))
    log.commit(merged.select(*rows.columns), months)
    return {**done.get, **settled.get}


# --------------------------------------------------------------------------- D8, J9, D9
def build_slate(scoreboard: DataFrame, dim: DataFrame, status_scheduled: int = 1, date=None,
                all_statuses: bool = False) -> DataFrame:
    """Events with both feed ids resolved to codes (unresolved rows dropped), time default
    'TBD', status default scheduled. ``date`` takes one day's events; ``all_statuses`` also those that
    are under way or final (the original lists a day's events whatever their status)."""
    s = between_dates(scoreboard, date, date)
    if not all_statuses:
        s = s.filter(F.coalesce(F.col("game_status"), F.lit(status_scheduled)) == status_scheduled)
    s = map_feed_ids(s, "away_team_id", dim, "away")
    s = map_feed_ids(s, "home_team_id", dim, "home")
    return s.filter(F.col("away").isNotNull() & F.col("home").isNotNull()).select(
        "game_id", F.col("date").alias("game_date"), "away", "home",
        F.coalesce("game_time", F.lit("TBD")).alias("game_time"),
        F.coalesce("game_status", F.lit(status_scheduled)).alias("game_status"))


def attach_lines(slate: DataFrame, lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Slate LEFT JOIN lines on (game_date, away, home); typed-in lines are
    strings and non-numeric ones ("nan" included) become NULL."""
    l = lines.select("game_date", "away", "home", number_of(F.col(line_col)).alias("vegas_total"))
    return slate.join(l, ["game_date", "away", "home"], "left")


def record_slate(scored: DataFrame, model_version: str = "v1.0") -> tuple[DataFrame, DataFrame]:
    """Rows with a usable line (non-NULL, non-zero) -> (schedule upsert
    rows, prediction log rows)."""
    from tandem.sources.store import prediction_rows
    ok = scored.filter(F.col("vegas_total").isNotNull() & (F.col("vegas_total") != 0))
    sched = ok.select("game_date", "away", "home", F.col("game_time").alias("scheduled_time"), "vegas_total")
    preds = prediction_rows(ok, model_version, date_col="game_date", pred="predicted_total", line="vegas_total")
    return sched, preds


def record_slate_into(spark: SparkSession, schedule_path: str, log_path: str, scored: DataFrame,
                      model_version: str = "v1.0", entities: DataFrame | None = None) -> dict:
    """D9 with its writes: schedule upserted (S13), predictions logged (S12); returns the counts."""
    sched, preds = record_slate(scored, model_version)
    upserted, rejected = upsert_schedule(spark, schedule_path, sched, entities)
    if entities is not None:
        from tandem.sources.store import validated
        preds, _ = validated(preds, entities=entities, strict_line=False)
    seen = Observation()
    log_predictions(spark, log_path, preds.observe(seen, F.count(F.lit(1)).alias("n")))
    return {"scheduled": upserted["from_delta"], "logged": seen.get["n"], "rejected": rejected.count()}


# --------------------------------------------------------------------------- L9, L11, L12
def serve_features(slate: DataFrame, feats: DataFrame, windows: list[int] | None = None,
                   post_game: bool = False, line_col: str | None = None,
                   split: SplitPolicy = SplitPolicy(), start_month: int = 10) -> DataFrame:
    """Feature row of each unplayed matchup from each side's latest
    feature row before the event date (J3 as-of, both sides in one pass).

    Reference mode: the latest row's own (pre-game) features, rest default 2
    and game number default 40 when missing, line features NULL unless ``line_col``
    names the slate's line (Q5); a side without history drops the matchup.

    ``post_game`` (fixed mode, Q3): ``feats`` must be computed with
    ``inclusive=True`` (windows end at the latest game); rest is measured from
    the latest game to the scheduled date, the game number continues the
    season (1 in a new season) and season-to-date values are dropped when the
    scheduled event opens a new season.
    """
    windows = windows or ROLLING_WINDOWS
    # as-of on narrow keys (the feature windows are pruned from this branch),
    # then fetch the matched feature rows by their unique (game_id, is_home):
    # the matched side is small (two rows per slate event), the wide feature
    # rows are not shuffled for the as-of
    keys = feats.select("team", "date", "is_home", "game_id")
    m = asof_latest(_slate_sides(slate), keys, "team", ["game_id", "is_home"], left_date="game_date",
                    right_order=GAME_ORDER, split=split)
    m = m.filter(F.col("asof").isNotNull()).select(
        "game_id", "game_date", F.col("is_home").alias("side"), F.col("asof.game_id").alias("_fg"),
        F.col("asof.is_home").alias("_fh"))
    m = written(m, "slate-match")  # two rows a slate event; read for the marks and for the join
    marks = key_marks(m, ["_fg", "_fh"])
    return _served(slate, marked_rows(feats, ["game_id", "is_home"], *marks), m, windows, post_game, line_col, start_month)


#: Most bits of the marks of :func:`key_marks`: 32 MB are broadcast at most.
MARK_BITS = 1 << 28


def key_marks(keys: DataFrame, cols: list[str]) -> tuple[DataFrame, int]:
    """(blocks of a bitmap in which the hash of every key is marked, its bits): 16 bits a key, up to
    ``MARK_BITS``. With more keys other rows pass more often, but none with a key is ever lost."""
    bits = min(MARK_BITS, max(1 << 15, 16 * keys.count()))
    slot = _mark_slot(cols, bits)
    return (keys.groupBy(F.bitmap_bucket_number(slot).alias("_block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_marks"))), bits


def marked_rows(rows: DataFrame, cols: list[str], blocks: DataFrame, bits: int) -> DataFrame:
    """The rows whose key may be among the marked ones: what is left is a little more than a join keeps,
    so that wide rows need not be shuffled to find out."""
    slot = _mark_slot(cols, bits)
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.expr("substring(_marks, cast(_spot div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return (rows.withColumns({"_block": F.bitmap_bucket_number(slot), "_spot": at}).join(F.broadcast(blocks), "_block")
            .filter(byte.bitwiseAND(F.pow(F.lit(2), F.col("_spot") % 8).cast("int")) != 0).select(*rows.columns))


def _mark_slot(cols: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in cols]), F.lit(bits)) + 1


def _served(slate: DataFrame, feats: DataFrame, match: DataFrame, windows: list[int], post_game: bool,
            line_col: str | None, start_month: int) -> DataFrame:
    """Slate rows with both sides' features; ``match`` names the feature row of each (game_id, side)."""
    cols = side_feature_columns_of(feats)
    payload = cols + (["date", "season"] if post_game else [])
    rows = feats.select(F.col("game_id").alias("_fg"), F.col("is_home").alias("_fh"), F.struct(*payload).alias("asof"))
    m = match.join(rows, ["_fg", "_fh"])
    if post_game:
        from tandem.operators.windows import season_phase_of
        a = lambda c: F.col(f"asof.{c}")
        same = season_of(F.col("game_date"), start_month) == a("season")
        rest = F.datediff(F.col("game_date"), a("date"))
        gnum = F.when(same, a("game_num") + 1).otherwise(F.lit(1))
        fixed = {c: a(c) for c in cols}
        fixed.update({"days_rest": rest, "is_b2b": (rest == 1).cast("int"), "long_rest": (rest >= 4).cast("int"),
                      "game_num": gnum.cast("int"), "season_phase": season_phase_of(gnum)})
        for c in ("season_ppg", "season_papg", "season_total_avg", "season_win_pct"):
            fixed[c] = F.when(same, a(c))
        m = m.withColumn("asof", F.struct(*[fixed[c].alias(c) for c in cols]))
    side = lambda flag: F.first(F.when(F.col("side") == flag, F.col("asof")), ignorenulls=True)
    paired = m.groupBy("game_id").agg(side(1).alias("_h"), side(0).alias("_a"))
    paired = paired.filter(F.col("_h").isNotNull() & F.col("_a").isNotNull())
    flat = paired.select("game_id", *[F.col(f"_h.{c}").alias(f"home_{c}") for c in cols],
                         *[F.col(f"_a.{c}").alias(f"away_{c}") for c in cols])
    flat = flat.withColumns({
        "home_days_rest": F.coalesce("home_days_rest", F.lit(DEFAULT_REST)),
        "away_days_rest": F.coalesce("away_days_rest", F.lit(DEFAULT_REST)),
        "home_is_b2b": F.coalesce("home_is_b2b", F.lit(0)), "away_is_b2b": F.coalesce("away_is_b2b", F.lit(0)),
        "home_game_num": F.coalesce("home_game_num", F.lit(DEFAULT_GAME_NUM)),
        "away_game_num": F.coalesce("away_game_num", F.lit(DEFAULT_GAME_NUM)),
    })
    line = F.lit(None).cast("double") if line_col is None else F.col(line_col).cast("double")
    out = slate.join(flat, "game_id")
    return over_under_features(out.withColumn("_line", line), windows, line="_line").drop("_line")


def serve_from_history(slate: DataFrame, long: DataFrame, windows: list[int] | None = None, post_game: bool = False,
                       line_col: str | None = None, split: SplitPolicy = SplitPolicy(), start_month: int = 10) -> DataFrame:
    """L9 without the features of the whole history: :func:`serve_features` of a slate in two phases.

    1. On narrow rows (entity, order, season and the four stats of season-to-date means): the as-of match
       of each side, the season features, and which rows lie within the last 15 before a match.
    2. Only those rows, at most 16 a match, are fetched whole, and their windows computed.

    ``line_col`` (Q5): None serves with the line unknown, as the original does; a column of the slate
    gives the features that depend on the line their value where it is known at serve time."""
    windows = windows or ROLLING_WINDOWS
    spark = slate.sparkSession
    keys = ["team", "date", "is_home", "game_id", "season"]
    narrow = long.select(*keys, *SNAPSHOT_STATS)
    sides = _slate_sides(slate)
    match = asof_latest(sides, narrow, "team", ["game_id", "is_home"], left_date="game_date", right_order=GAME_ORDER, split=split)
    match = match.filter(F.col("asof").isNotNull()).select(
        "game_id", "game_date", F.col("is_home").alias("side"), F.col("asof.game_id").alias("_fg"),
        F.col("asof.is_home").alias("_fh"))
    path = scratch_path(spark, "slate-match")  # two rows a slate event; read by both phases
    match.write.parquet(path)
    match = spark.read.schema(match.schema).parquet(path)
    matched = match.select(F.col("_fg").alias("game_id"), F.col("_fh").alias("is_home"), F.lit(True).alias("_hit")).distinct()

    season = trailing_features(narrow, stats=[], std_stats=[], windows=[], rest=False, pace=False, trend=False, split=split,
                               inclusive=post_game)
    flagged = season.join(matched, ["game_id", "is_home"], "left")
    marked, any_hot = mark_hot(flagged, "team", GAME_ORDER, split)
    reach = max(windows)
    full = with_halo(marked, reach, split, ahead=True) if any_hot else marked.withColumn("_halo", F.lit(False))
    ordered = order_by(GAME_ORDER) + ([F.col("_rank")] if any_hot else [])
    ahead = Window.partitionBy("team", "_bucket").orderBy(*ordered).rowsBetween(0, reach)
    needed = full.withColumn("_near", F.max("_hit").over(ahead)).filter(F.col("_near") & ~F.col("_halo"))
    season_cols = ["game_num", "season_ppg", "season_papg", "season_total_avg", "season_win_pct", "season_phase"]
    needed = written(needed.select("game_id", "is_home", "_hit", *season_cols), "near-rows")
    rows = (marked_rows(long, ["game_id", "is_home"], *key_marks(needed, ["game_id", "is_home"]))
            .join(needed, ["game_id", "is_home"]))
    feats = trailing_features(rows.withColumnRenamed("_hit", "matched"), windows=windows, season_col=None, split=split,
                              inclusive=post_game).filter("matched").drop("matched")
    return _served(slate, feats, match, windows, post_game, line_col, start_month)


def _slate_sides(slate: DataFrame) -> DataFrame:
    return slate.select(F.explode(F.array(
        F.struct(F.col("game_id"), F.col("game_date"), F.col("home").alias("team"), F.lit(1).alias("is_home")),
        F.struct(F.col("game_id"), F.col("game_date"), F.col("away").alias("team"), F.lit(0).alias("is_home"))
    )).alias("s")).select("s.*")


def recommend(df: DataFrame, pred: str = "predicted_total", line: str = "vegas_total") -> DataFrame:
    """L10 rounding + L11 + L12: prediction rounded to 0.1 (half-even), edge =
    round(pred - line, 1), OVER when pred > line else UNDER, no pick without a
    line; tier HIGH (|edge| >= 5), MODERATE (>= 3), SMALL."""
    p, l = F.col(pred), F.col(line)
    edge = round1(p - l)
    rec = F.when(l.isNull(), F.lit(None).cast("string")).when(p > l, F.lit("OVER")).otherwise(F.lit("UNDER"))
    tier = F.when(l.isNull(), F.lit(None).cast("string"))
    for least, name in CONFIDENCE_TIERS:
        tier = tier.when(F.abs(edge) >= least, F.lit(name))
    tier = tier.otherwise(F.lit("SMALL"))
    return df.withColumns({"edge": F.when(l.isNotNull(), edge), "recommendation": rec, "confidence": tier,
                           pred: round1(p)})


# --------------------------------------------------------------------------- D4, D7
def daily_update(spark, table_path: str, scoreboard: DataFrame, boxscore: DataFrame, dim: DataFrame,
                 predictions: DataFrame | None = None, reference_mode: bool = True, start=None, end=None,
                 log_path: str | None = None) -> dict:
    """Ingest the feed of the given dates into the stored table (D2 + S4 on touched
    partitions), settle the predictions of these dates against it (J4), refresh the team
    snapshot (D5) and summarise the warehouse with the whole log (A1), in that order.

    With ``log_path`` the stored log is settled in place; ``predictions`` (a frame) is settled as a
    view. ``counts`` holds games_added, games_settled and predictions_updated, as observed."""
    from tandem.operators.evaluate import warehouse_stats

    delta = feed_delta(between_dates(scoreboard, start, end), boxscore, dim, reference_mode)
    added = upsert_into(spark, table_path, delta, GAME_KEY, order_col="game_id", coalesce_old=not reference_mode,
                        defaults=GAME_DEFAULTS)
    games = VersionedTable(spark, table_path).read()
    counts = {"games_added": added["from_delta"]}
    if log_path is not None:
        counts.update(settle_into(spark, log_path, games, start, end))
        settled = VersionedTable(spark, log_path, "game_month").read()
    else:
        settled = settle_predictions(predictions, games)
    return {"games": games, "settled": settled, "snapshot": team_snapshot(games),
            "stats": warehouse_stats(games, settled), "counts": counts}


def evaluate_job(scored: DataFrame, test_seasons: list[int], pred: str = "prediction",
                 actual: str = "actual_total", line: str = "total", date_col: str = "date") -> DataFrame:
    """Error metrics (A5, A6), betting results (A8-A10) and the breakdowns by minimum edge (A11), side
    (A12) and month (A13) of the held-out seasons, from one scan and one shuffle.

    Rows are aggregated once over the grouping sets (), (side), (month), (edge level), partially in each
    task; what leaves it is as many rows as there are months, plus a dozen. A row's edge level is
    min(10, floor(|edge|)), and a minimum edge adds up the levels from it on (J8). Output: ``part`` (all, edge,
    side, month), ``key``, bets, wins, pushes, losses, win_rate, profit, roi_pct, and mae, rmse for ``all``.
    Losses follow the original: without pushes in ``all``, bets - wins elsewhere."""
    from tandem.functions.names import EDGE_THRESHOLDS, RISK, WIN_PAYOUT
    from tandem.functions.scalars import month_key, safe_ratio
    from tandem.operators.evaluate import pick_flags

    f = pick_flags(pred, actual, line)
    p, y = F.col(pred), F.col(actual)
    edge = F.abs(p - F.col(line))
    top = max(EDGE_THRESHOLDS)
    rows = scored.filter(F.col("season").isin(test_seasons)).select(
        F.when(f["says_over"], "OVER").otherwise("UNDER").alias("side"), month_key(F.col(date_col)).alias("month"),
        F.when(edge >= min(EDGE_THRESHOLDS), F.least(F.floor(edge).cast("int"), F.lit(top))).alias("level"),
        f["correct"].alias("correct"), f["push"].alias("push"), F.abs(p - y).alias("err"))
    sums = [F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("bets"), F.count_if("correct").alias("wins"),
            F.count_if("push").alias("pushes"), F.avg("err").alias("mae"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse")]
    each = rows.groupingSets([[], ["side"], ["month"], ["level"]], "side", "month", "level").agg(*sums)
    # ids of (side, month, level): 7 = none of them, 3 = side, 5 = month, 6 = level
    part = (F.when(F.col("gid") == 7, "all").when(F.col("gid") == 3, "side").when(F.col("gid") == 5, "month").otherwise("edge"))
    each = each.withColumn("part", part).filter((F.col("part") != "edge") | F.col("level").isNotNull())
    # every edge level counts for the thresholds up to it: ten rows become fifty-five at most
    each = each.withColumn("at", F.when(F.col("part") == "edge", F.sequence(F.lit(min(EDGE_THRESHOLDS)), F.col("level")))
                           .otherwise(F.array(F.lit(0)))).withColumn("at", F.explode("at"))
    key = F.coalesce("side", "month", F.when(F.col("part") == "edge", F.col("at").cast("string")))
    sides = scored.sparkSession.range(3).select(
        F.when(F.col("id") == 2, "all").otherwise("side").alias("part"),
        F.when(F.col("id") == 0, "OVER").when(F.col("id") == 1, "UNDER").alias("key"))
    none = [F.lit(0).cast("long").alias(c) for c in ("bets", "wins", "pushes")] + [F.lit(None).cast("double").alias(c) for c in ("mae", "rmse")]
    out = (each.select("part", key.alias("key"), "bets", "wins", "pushes", "mae", "rmse")
           .unionByName(sides.select("*", *none))  # shown with no bets too
           .groupBy("part", "key").agg(*[F.sum(c).alias(c) for c in ("bets", "wins", "pushes")],
                                       F.max("mae").alias("mae"), F.max("rmse").alias("rmse")))
    whole = F.col("part") == "all"
    out = out.withColumn("losses", F.col("bets") - F.col("wins") - F.when(whole, F.col("pushes")).otherwise(0))
    profit, staked = F.col("wins") * WIN_PAYOUT - F.col("losses") * RISK, (F.col("wins") + F.col("losses")) * RISK
    return out.withColumns({
        "win_rate": F.coalesce(safe_ratio(F.col("wins") * 100, F.col("wins") + F.col("losses")), F.lit(0.0)),
        "profit": profit, "roi_pct": F.coalesce(safe_ratio(profit * 100, staked), F.lit(0.0)),
        "mae": F.when(whole, F.col("mae")), "rmse": F.when(whole, F.col("rmse"))}).select(
        "part", "key", "bets", "wins", "pushes", "losses", "win_rate", "profit", "roi_pct", "mae", "rmse")
