"""Pair per-entity features back onto events (J1, J2, pairing by event) and
build the two-sided matchup features (M1-M12)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.names import ROLLING_WINDOWS, SIDE_FEATURE_MARKERS
from tandem.functions.scalars import null_false


def side_feature_columns_of(df: DataFrame, markers: list[str] | None = None) -> list[str]:
    """Columns whose name contains any marker substring."""
    markers = SIDE_FEATURE_MARKERS if markers is None else markers
    return [c for c in df.columns if any(m in c for m in markers)]


def _prefixed(feats: DataFrame, side: str, cols: list[str], entity: str, date_col: str) -> DataFrame:
    return feats.select(F.col(entity).alias(side), F.col(date_col),
                        *[F.col(c).alias(f"{side}_{c}") for c in cols])


def matchup_join(games: DataFrame, feats: DataFrame, cols: list[str] | None = None,
                 entity: str = "team", date_col: str = "date",
                 home: str = "home", away: str = "away",
                 derived: Callable[[str], dict[str, Column]] | None = None) -> DataFrame:
    """J1 + J2 (reference semantics): event LEFT JOIN home-side features on
    (home, date), then LEFT JOIN away-side features on (away, date).

    If an entity has two events on one date both joins fan out, exactly as the
    reference does. Both joins hash on (entity, date), so one busy entity is
    spread over its dates rather than landing in one task.

    ``derived`` (prefix of a side -> columns by name) gives features that follow from others of the same
    side and are NULL where these are: they are not shuffled, but made anew after the joins.
    """
    cols = side_feature_columns_of(feats) if cols is None else cols
    made = derived("") if derived else {}
    moved = [c for c in cols if c not in made]
    h = _prefixed(feats, "home", moved, entity, date_col).withColumnRenamed("home", home)
    a = _prefixed(feats, "away", moved, entity, date_col).withColumnRenamed("away", away)
    out = games.join(h, [home, date_col], "left").join(a, [away, date_col], "left")
    if derived is None:
        return out
    keys = [away, date_col, home]
    return (_with_derived(out, cols, derived)
            .select(*keys, *[c for c in games.columns if c not in keys], *[f"{s}_{c}" for s in ("home", "away") for c in cols]))


def _with_derived(paired: DataFrame, cols: list[str], derived: Callable[[str], dict[str, Column]]) -> DataFrame:
    """Add both sides' features of ``derived`` that are among ``cols``."""
    return paired.withColumns({f"{s}_{c}": v for s in ("home", "away") for c, v in derived(f"{s}_").items() if c in cols})


def _sides_by_event(feats: DataFrame, per_side: list[str], event: str, carry: list[str],
                    name=lambda side, c: f"{side}_{c}") -> DataFrame:
    """One row per event with the home row's and the away row's values side by
    side. The long rows are shuffled once by event id (two rows per key, so no
    skew), ordered home first, and the first row of each event takes the next
    row as one struct (a single ``lead``), so the work does not grow with the
    number of feature columns the way per-column aggregates would."""
    w = Window.partitionBy(event).orderBy(F.col("is_home").desc())
    me = F.struct(*[F.col(c) for c in per_side])
    home = F.when(F.col("is_home") == 1, me)
    away = F.when(F.col("is_home") == 0, me).otherwise(F.lead(me, 1).over(w))
    rows = (feats.select(event, *carry, home.alias("_h"), away.alias("_a"), F.row_number().over(w).alias("_rn"))
            .filter(F.col("_rn") == 1))
    return rows.select(event, *carry, *[F.col(f"_h.{c}").alias(name("home", c)) for c in per_side],
                       *[F.col(f"_a.{c}").alias(name("away", c)) for c in per_side])


def matchup_by_event(games: DataFrame, feats: DataFrame, cols: list[str] | None = None,
                     event: str = "game_id",
                     derived: Callable[[str], dict[str, Column]] | None = None) -> DataFrame:
    """Pair each event with its own home row and away row by event id: no
    fan-out on repeated (entity, date); the paired frame comes out
    partitioned by event id for the join back to the events. The phase label
    is derived from each side's game number after pairing, and so are the features
    of ``derived`` (see :func:`matchup_join`)."""
    from tandem.operators.windows import season_phase_of
    cols = side_feature_columns_of(feats) if cols is None else cols
    made = derived("") if derived else {}
    moved = [c for c in cols if c != "season_phase" and c not in made]
    out = games.join(_sides_by_event(feats, moved, event, []), event, "left")
    if derived is not None:
        out = _with_derived(out, cols, derived)
    if "season_phase" in cols and "game_num" in cols:
        out = out.withColumns({f"{s}_season_phase": season_phase_of(F.col(f"{s}_game_num")) for s in ("home", "away")})
    return out.select(*games.columns, *[f"{s}_{c}" for s in ("home", "away") for c in cols])


def over_under_features(df: DataFrame, windows: list[int] | None = None,
                        line: str = "total") -> DataFrame:
    """M1-M12. Only the features whose inputs are present are produced."""
    windows = ROLLING_WINDOWS if windows is None else windows
    have = set(df.columns)
    c = F.col
    out: dict[str, Column] = {}
    if {"score_home", "score_away"} <= have:
        out["actual_total"] = c("score_home") + c("score_away")
        if line in have:
            out["went_over"] = null_false(out["actual_total"] > c(line))
    for w in windows:
        hs, as_ = f"home_points_scored_roll_{w}", f"away_points_scored_roll_{w}"
        ha, aa = f"home_points_allowed_roll_{w}", f"away_points_allowed_roll_{w}"
        if {hs, as_} <= have:
            out[f"combined_scoring_{w}"] = c(hs) + c(as_)
        if {ha, aa} <= have:
            out[f"combined_defense_{w}"] = c(ha) + c(aa)
        if {hs, as_, ha, aa} <= have:
            out[f"expected_total_{w}"] = (c(hs) + c(aa)) / 2 + (c(as_) + c(ha)) / 2
        if {f"home_pace_{w}", f"away_pace_{w}"} <= have:
            out[f"pace_matchup_{w}"] = (c(f"home_pace_{w}") + c(f"away_pace_{w}")) / 2
        if {f"home_total_points_std_{w}", f"away_total_points_std_{w}"} <= have:
            out[f"combined_volatility_{w}"] = (c(f"home_total_points_std_{w}") + c(f"away_total_points_std_{w}")) / 2
    if line in have:
        for w in windows:
            if f"expected_total_{w}" in out:
                out[f"line_vs_expected_{w}"] = c(line) - out[f"expected_total_{w}"]
            for s in ("home", "away"):
                if f"{s}_total_points_roll_{w}" in have:
                    out[f"{s}_over_tendency_{w}"] = c(f"{s}_total_points_roll_{w}") - c(line)
    if {"home_days_rest", "away_days_rest"} <= have:
        hr, ar = c("home_days_rest"), c("away_days_rest")
        out["total_rest"] = hr + ar
        out["rest_diff"] = hr - ar
        out["both_rested"] = null_false((hr >= 2) & (ar >= 2))
    if {"home_is_b2b", "away_is_b2b"} <= have:
        out["both_b2b"] = null_false(c("home_is_b2b") + c("away_is_b2b") == 2)
    if {"home_scoring_trend", "away_scoring_trend"} <= have:
        out["combined_scoring_trend"] = c("home_scoring_trend") + c("away_scoring_trend")
        out["combined_total_trend"] = c("home_total_trend") + c("away_total_trend")
    if {"home_game_num", "away_game_num"} <= have:
        out["home_early_season"] = null_false(c("home_game_num") <= 25)
        out["away_early_season"] = null_false(c("away_game_num") <= 25)
    return df.withColumns(out)


def pair_sides(feats: DataFrame, cols: list[str], carry: list[str] | None = None,
               event: str = "game_id", side_carry: list[str] | None = None) -> DataFrame:
    """Events rebuilt from their two long rows alone (no join back to the
    events table). ``carry`` are event-level columns present on both rows
    (date, line, ...), taken from the home row; ``side_carry`` are per-side
    columns (team, points_scored, ...) emitted as ``home_*``/``away_*`` like
    the feature columns; the home entity becomes ``home``, the away one ``away``.
    """
    carry = carry or []
    side_carry = side_carry if side_carry is not None else ["team", "points_scored"]
    per_side = list(dict.fromkeys(side_carry + cols))
    name = lambda side, c: side if c == "team" else f"{side}_{c}"
    out = _sides_by_event(feats, per_side, event, carry, name)
    order = [event, *carry] + [name(s, c) for c in per_side for s in ("home", "away")]
    return out.select(*order)
