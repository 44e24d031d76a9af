"""Error and betting evaluation (A1-A19). Every aggregate is a single
``agg`` with map-side partial aggregation; the edge sweep aggregates into at
most ten groups before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.names import BREAK_EVEN_PCT, EDGE_THRESHOLDS, RISK, WIN_PAYOUT
from tandem.functions.scalars import month_key, null_false, safe_ratio


# --------------------------------------------------------------------------- errors

def error_metrics(df: DataFrame, pred: str = "prediction", actual: str = "actual_total",
                  group: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and R^2 over rows where both values are present."""
    p, y = F.col(pred), F.col(actual)
    d = df.filter(p.isNotNull() & y.isNotNull())
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(p - y)).alias("mae"),
        F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"),
        (F.lit(1.0) - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))).alias("r2"),
    ]
    return d.groupBy(*(group or [])).agg(*aggs)


def line_baseline_mae(df: DataFrame, actual: str = "actual_total", line: str = "total") -> DataFrame:
    """Mean |actual - line|, rows with a NULL on either side skipped."""
    return df.agg(F.avg(F.abs(F.col(actual) - F.col(line))).alias("line_mae"))


def target_stats(df: DataFrame, target: str = "actual_total") -> DataFrame:
    """Mean, sample std, min, max of the target."""
    t = F.col(target)
    return df.agg(F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"),
                  F.min(t).alias("min"), F.max(t).alias("max"))


def column_means(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean per column, NULLs skipped (what a mean imputer fits)."""
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def standardize_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population std per column, one row per column."""
    row = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in cols])
    return (row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s"))
                                            for c in cols])).alias("_r"))
            .select("_r.feature", "_r.s.mean", "_r.s.std"))


def fold_mae(df: DataFrame, pred: str = "prediction", actual: str = "actual_total",
             fold: str = "fold") -> DataFrame:
    """MAE per validation fold, then the mean over folds."""
    per = (df.filter(F.col(fold).isNotNull())
           .groupBy(fold).agg(F.avg(F.abs(F.col(pred) - F.col(actual))).alias("mae")))
    return per.agg(F.count(F.lit(1)).alias("folds"), F.avg("mae").alias("mean_mae"))


# --------------------------------------------------------------------------- betting

def pick_flags(pred: str, actual: str, line: str) -> dict[str, Column]:
    p, y, l = F.col(pred), F.col(actual), F.col(line)
    says_over = null_false(p > l) == 1
    went_over = null_false(y > l) == 1
    return {"says_over": says_over, "went_over": went_over,
            "correct": says_over == went_over, "push": null_false(y == l) == 1}


def _money(wins: Column, losses: Column) -> dict[str, Column]:
    profit = wins * WIN_PAYOUT - losses * RISK
    wagered = (wins + losses) * RISK
    return {"profit": profit, "wagered": wagered,
            "roi_pct": F.coalesce(safe_ratio(profit * 100, wagered), F.lit(0.0))}


def bet_outcomes(df: DataFrame, pred: str = "prediction", actual: str = "actual_total",
                 line: str = "total", group: list[str] | None = None,
                 push_policy: str = "reference") -> DataFrame:
    """Bets, wins, losses, pushes, win rate, profit, ROI, break-even.

    ``reference``: a pick is correct when (pred > line) == (actual > line),
    with NULL comparisons false; pushes (actual == line) are subtracted from
    losses, so a push on an UNDER pick counts as a win and is subtracted
    again. ``void``: rows with a NULL line/actual are dropped and pushes are
    neither wins nor losses.
    """
    f = pick_flags(pred, actual, line)
    d = df
    if push_policy == "void":
        d = d.filter(F.col(line).isNotNull() & F.col(actual).isNotNull())
        wins = F.count_if(f["correct"] & ~f["push"])
    else:
        wins = F.count_if(f["correct"])
    agg = d.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("bets"), wins.alias("wins"), F.count_if(f["push"]).alias("pushes"))
    agg = agg.withColumn("losses", F.col("bets") - F.col("wins") - F.col("pushes"))
    decided = F.col("wins") + F.col("losses")
    m = _money(F.col("wins"), F.col("losses"))
    return agg.withColumns({
        "win_rate": F.coalesce(safe_ratio(F.col("wins") * 100, decided), F.lit(0.0)),
        "profit": m["profit"], "wagered": m["wagered"], "roi_pct": m["roi_pct"],
    }).withColumns({
        "beats_break_even": F.col("win_rate") > F.lit(BREAK_EVEN_PCT),
        "break_even_margin": F.col("win_rate") - F.lit(BREAK_EVEN_PCT),
    })


def edge_sweep(df: DataFrame, pred: str = "prediction", actual: str = "actual_total",
               line: str = "total", thresholds: list[int] | None = None) -> DataFrame:
    """A11 over J8: for each minimum edge t, bets with |pred - line| >= t.

    Thresholds are consecutive integers 1..T, so a row qualifies for every
    t <= min(T, floor(|edge|)). Rows are aggregated by that top level (at most
    T groups, map-side), and the per-threshold totals are suffix sums over
    those T rows: no T-fold row explosion. Empty thresholds are skipped.
    """
    thresholds = thresholds or EDGE_THRESHOLDS
    if any(t != int(t) or t < 1 for t in thresholds):
        raise ValueError("thresholds are whole numbers from 1")
    top = max(thresholds)
    f = pick_flags(pred, actual, line)
    edge = F.abs(F.col(pred) - F.col(line))
    per = (df.filter(edge >= min(thresholds))
           .groupBy(F.least(F.floor(edge).cast("int"), F.lit(top)).alias("min_edge"))
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(f["correct"]).alias("w")))
    levels = df.sparkSession.range(1, top + 1).select(F.col("id").cast("int").alias("min_edge"))
    suffix = Window.orderBy(F.col("min_edge").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = (levels.join(F.broadcast(per), "min_edge", "left")
           .select("min_edge",
                   F.sum(F.coalesce("n", F.lit(0))).over(suffix).alias("bets"),
                   F.sum(F.coalesce("w", F.lit(0))).over(suffix).alias("wins"))
           .filter(F.col("min_edge").isin(thresholds) & (F.col("bets") > 0)))
    out = out.withColumn("losses", F.col("bets") - F.col("wins"))
    m = _money(F.col("wins"), F.col("losses"))
    return out.withColumns({
        "win_rate": safe_ratio(F.col("wins") * 100, F.col("bets")),
        "profit": m["profit"],
        "roi_pct": F.coalesce(safe_ratio(m["profit"] * 100, F.col("bets") * RISK), F.lit(0.0)),
    })


def side_breakdown(df: DataFrame, pred: str = "prediction", actual: str = "actual_total",
                   line: str = "total") -> DataFrame:
    """Bets, wins and win rate of OVER picks and of UNDER picks (both rows
    always present)."""
    f = pick_flags(pred, actual, line)
    row = df.agg(
        F.count_if(f["says_over"]).alias("over_bets"),
        F.count_if(f["says_over"] & f["went_over"]).alias("over_wins"),
        F.count_if(~f["says_over"]).alias("under_bets"),
        F.count_if(~f["says_over"] & ~f["went_over"]).alias("under_wins"))
    sides = F.array(
        F.struct(F.lit("OVER").alias("side"), F.col("over_bets").alias("bets"), F.col("over_wins").alias("wins")),
        F.struct(F.lit("UNDER").alias("side"), F.col("under_bets").alias("bets"), F.col("under_wins").alias("wins")))
    out = row.select(F.explode(sides).alias("_s")).select("_s.*")
    return out.withColumn("win_rate", F.coalesce(safe_ratio(F.col("wins") * 100, F.col("bets")), F.lit(0.0)))


def monthly_performance(df: DataFrame, pred: str = "prediction", actual: str = "actual_total",
                        line: str = "total", date_col: str = "date") -> DataFrame:
    """Per calendar month: bets, wins, win rate, profit (pushes are
    whatever side the pick lands on, as in the reference)."""
    f = pick_flags(pred, actual, line)
    out = (df.groupBy(month_key(F.col(date_col)).alias("month"))
           .agg(F.count(F.lit(1)).alias("bets"), F.count_if(f["correct"]).alias("wins")))
    return out.withColumns({
        "win_rate": safe_ratio(F.col("wins") * 100, F.col("bets")),
        "profit": F.col("wins") * WIN_PAYOUT - (F.col("bets") - F.col("wins")) * RISK,
    })


def slate_summary(df: DataFrame, edge: str = "edge", rec: str = "recommendation",
                  high_edge: float = 5.0) -> DataFrame:
    """Predicted count, OVER and UNDER picks, picks with |edge| >= 5."""
    return df.agg(
        F.count(F.lit(1)).alias("predicted"),
        F.count_if(F.col(rec) == "OVER").alias("overs"),
        F.count_if(F.col(rec) == "UNDER").alias("unders"),
        F.count_if(F.abs(F.col(edge)) >= high_edge).alias("high_confidence"))


# --------------------------------------------------------------------------- warehouse

def warehouse_stats(games: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """A1: games, first/last date, seasons, distinct home entities, predictions.

    The season list is bounded by the calendar; entities are counted, not
    listed (their list is A2, a distributed distinct)."""
    row = games.agg(
        F.count(F.lit(1)).alias("total_games"),
        F.min("date").alias("earliest_game"), F.max("date").alias("latest_game"),
        F.sort_array(F.collect_set("season")).alias("seasons"),
        F.count_distinct("home").alias("teams"))
    if predictions is not None:
        row = row.withColumn("total_predictions", predictions.select(F.count(F.lit(1))).scalar())
    return row


def distinct_values(games: DataFrame, col: str) -> DataFrame:
    """A2: ordered distinct values of a column."""
    return games.select(col).distinct().orderBy(col)


def season_record(long: DataFrame, season: Column | int | None = None,
                  entity: str = "team") -> DataFrame:
    """A3: per entity in one season: wins, losses, mean scored/allowed.
    Default season: the latest one present (scalar subquery)."""
    if season is None:
        season = long.select(F.max("season")).scalar()
    elif isinstance(season, int):
        season = F.lit(season)
    agg = (long.filter(F.col("season") == season).groupBy(entity)
           .agg(F.count(F.lit(1)).alias("games"), F.sum("win").alias("season_wins"),
                F.avg("points_scored").alias("season_avg_scored"),
                F.avg("points_allowed").alias("season_avg_allowed")))
    return agg.withColumn("season_losses", F.col("games") - F.col("season_wins")).drop("games")


def games_played(long: DataFrame, entity: str = "team") -> DataFrame:
    """A4: all-time rows per entity."""
    return long.groupBy(entity).agg(F.count(F.lit(1)).alias("games_played"))
