"""Two-sided events -> one row per entity and event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.names import MEASURES
from tandem.functions.scalars import null_false

GAME_CONTEXT = ["game_id", "season", "date", "total"]


def _side(df_cols: list[str], home: str, away: str, is_home: int,
          measures: list[str]) -> Column:
    me, other = ("home", "away") if is_home else ("away", "home")
    fields = [F.col(home if is_home else away).alias("team"),
              F.col(away if is_home else home).alias("opponent"),
              F.lit(is_home).alias("is_home")]
    for m in measures:
        src = "score" if m == "points" else m
        fields.append(F.col(f"{src}_{me}").alias(f"{m}_scored"))
        fields.append(F.col(f"{src}_{other}").alias(f"{m}_allowed"))
    return F.struct(*fields)


def two_sided_long(games: DataFrame, keep: list[str] | None = None,
                   home: str = "home", away: str = "away",
                   measures: list[str] | None = None) -> DataFrame:
    """Each event -> a home row (is_home=1) and an away row (is_home=0).

    ``*_home``/``*_away`` measures become ``*_scored``/``*_allowed``; the
    event's other columns in ``keep`` are carried along. One scan, no union:
    the two sides are an exploded two-element array of same-shaped structs.
    """
    measures = measures or MEASURES
    keep = [c for c in (keep if keep is not None else GAME_CONTEXT) if c in games.columns]
    sides = F.array(_side(games.columns, home, away, 1, measures),
                    _side(games.columns, home, away, 0, measures))
    return games.select(*keep, F.explode(sides).alias("_side")).select(*keep, "_side.*")


def two_sided_union(games: DataFrame, keep: list[str] | None = None,
                    home: str = "home", away: str = "away",
                    measures: list[str] | None = None) -> DataFrame:
    """The same rows as :func:`two_sided_long` as a bag union (two scans)."""
    measures = measures or MEASURES
    keep = [c for c in (keep if keep is not None else GAME_CONTEXT) if c in games.columns]
    parts = []
    for is_home in (1, 0):
        parts.append(games.select(*keep, _side(games.columns, home, away, is_home, measures).alias("_s"))
                     .select(*keep, "_s.*"))
    return parts[0].unionByName(parts[1])


def row_stats(long: DataFrame) -> DataFrame:
    """Per-row derived stats (11 columns); NULL comparisons count as 0."""
    ps, pa = F.col("points_scored"), F.col("points_allowed")
    cols = {
        "total_points": ps + pa,
        "point_diff": ps - pa,
        "win": null_false(ps - pa > 0),
    }
    if "ot_scored" in long.columns:
        cols["went_to_ot"] = null_false(F.col("ot_scored") > 0)
    if "q1_scored" in long.columns:
        reg = lambda kind: sum((F.col(f"q{i}_{kind}") for i in range(2, 5)), F.col(f"q1_{kind}"))
        cols.update({
            "reg_points_scored": reg("scored"),
            "reg_points_allowed": reg("allowed"),
            "reg_total": reg("scored") + reg("allowed"),
            "first_half_scored": F.col("q1_scored") + F.col("q2_scored"),
            "second_half_scored": F.col("q3_scored") + F.col("q4_scored"),
            "first_half_allowed": F.col("q1_allowed") + F.col("q2_allowed"),
            "second_half_allowed": F.col("q3_allowed") + F.col("q4_allowed"),
        })
    return long.withColumns(cols)


def team_games(games: DataFrame, keep: list[str] | None = None, measures: list[str] | None = None) -> DataFrame:
    """P1 + P2: the long team-game frame used by all per-entity features."""
    return row_stats(two_sided_long(games, keep=keep, measures=measures))
