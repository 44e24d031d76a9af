"""Feature names and column lists.

Fixed values: these lists must equal the reference's so that the generated
feature names (and the 288 model features) match it exactly.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
ROLLING_WINDOWS = [3, 5, 10, 15]

ROLLING_STATS = [
    "points_scored", "points_allowed", "total_points", "point_diff",
    "reg_points_scored", "reg_points_allowed", "reg_total",
    "first_half_scored", "second_half_scored",
    "first_half_allowed", "second_half_allowed",
    "q1_scored", "q2_scored", "q3_scored", "q4_scored",
    "q1_allowed", "q2_allowed", "q3_allowed", "q4_allowed",
    "win", "went_to_ot",
]

VOLATILITY_STATS = ["points_scored", "points_allowed", "total_points"]

SIDE_FEATURE_MARKERS = ["roll_", "std_", "pace_", "trend", "season_",
                        "days_rest", "is_b2b", "long_rest", "game_num"]

EXCLUDE_FROM_FEATURES = [
    "season", "date", "regular", "playoffs", "away", "home",
    "score_away", "score_home", "q1_away", "q2_away", "q3_away", "q4_away", "ot_away",
    "q1_home", "q2_home", "q3_home", "q4_home", "ot_home",
    "whos_favored", "spread", "total", "moneyline_away", "moneyline_home",
    "h2_spread", "h2_total", "id_spread", "id_total",
    "actual_total", "went_over", "season_phase", "game_id",
    "created_at", "updated_at", "home_season_phase", "away_season_phase",
]

ALLOWED_GAME_COLUMNS = [
    "game_id", "season", "date", "regular", "playoffs", "away", "home",
    "score_away", "score_home", "q1_away", "q2_away", "q3_away", "q4_away", "ot_away",
    "q1_home", "q2_home", "q3_home", "q4_home", "ot_home",
    "whos_favored", "spread", "total", "moneyline_away", "moneyline_home",
    "h2_spread", "h2_total", "id_spread", "id_total",
    "created_at", "updated_at",
]

# Season phase bins on game_num: (0,25] early, (25,55] mid, (55,100] late.
PHASE_BINS = [(0, 25, "early"), (25, 55, "mid"), (55, 100, "late")]

# Betting constants: risk 110 to win 100; break-even win rate in percent.
WIN_PAYOUT = 100
RISK = 110
BREAK_EVEN_PCT = 52.4
EDGE_THRESHOLDS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]

# Confidence of a pick by its least absolute edge; below that it is small.
CONFIDENCE_TIERS = [(5, "HIGH"), (3, "MODERATE")]

# Serving defaults of an entity's rest days and game number.
DEFAULT_REST = 2
DEFAULT_GAME_NUM = 40
# ---------------------------------------------------------------------------

SEASON_STATS = {  # output name -> per-row stat whose season-to-date mean it is
    "season_ppg": "points_scored",
    "season_papg": "points_allowed",
    "season_total_avg": "total_points",
    "season_win_pct": "win",
}

TREND_STATS = {  # trend name -> stat, short minus long window
    "scoring_trend": "points_scored",
    "defense_trend": "points_allowed",
    "total_trend": "total_points",
    "win_trend": "win",
}

MEASURES = ["points", "q1", "q2", "q3", "q4", "ot"]  # per-side measures of a game


def roll_name(stat: str, w: int) -> str:
    return f"{stat}_roll_{w}"


def std_name(stat: str, w: int) -> str:
    return f"{stat}_std_{w}"


def side_feature_columns(windows=ROLLING_WINDOWS) -> list[str]:
    """The 125 per-side feature names, in the reference's generation order."""
    cols = [roll_name(s, w) for w in windows for s in ROLLING_STATS]
    cols += [std_name(s, w) for w in windows for s in VOLATILITY_STATS]
    for w in windows:
        cols += [f"off_pace_{w}", f"def_pace_{w}", f"pace_{w}", f"pace_diff_{w}"]
    if 3 in windows and 10 in windows:
        cols += list(TREND_STATS)
    cols += ["days_rest", "is_b2b", "long_rest", "game_num"]
    cols += list(SEASON_STATS) + ["season_phase"]
    return cols


def matchup_feature_columns(windows=ROLLING_WINDOWS) -> list[str]:
    cols = []
    for w in windows:
        cols += [f"combined_scoring_{w}", f"combined_defense_{w}", f"expected_total_{w}",
                 f"pace_matchup_{w}", f"combined_volatility_{w}"]
    for w in windows:
        cols += [f"line_vs_expected_{w}", f"home_over_tendency_{w}", f"away_over_tendency_{w}"]
    cols += ["total_rest", "rest_diff", "both_rested", "both_b2b",
             "combined_scoring_trend", "combined_total_trend",
             "home_early_season", "away_early_season"]
    return cols


def model_feature_columns(columns: list[str]) -> list[str]:
    """Feature columns = all columns minus the exclusion list (order kept)."""
    excl = set(EXCLUDE_FROM_FEATURES)
    return [c for c in columns if c not in excl]
