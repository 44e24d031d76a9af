"""The full feature pipeline as one lazy DataFrame plan.

events -> long (P1, P2) -> per-entity trailing/season features (W1-W9)
-> pair sides (by event id, or the reference's two (entity, date) joins)
-> matchup features (M1-M12) -> drop sparse rows (P7).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from tandem.functions.names import ROLLING_STATS, ROLLING_WINDOWS
from tandem.operators.longform import team_games
from tandem.operators.matchup import (matchup_by_event, matchup_join, over_under_features,
                                      side_feature_columns_of)
from tandem.operators.windows import SplitPolicy, derived_features, trailing_features


def drop_sparse_rows(df: DataFrame, frac: float = 0.5) -> DataFrame:
    """Keep rows with at least ``frac`` of their columns non-NULL."""
    return df.dropna(thresh=math.ceil(frac * len(df.columns)))


def team_features(games: DataFrame, windows: list[int] | None = None,
                  split: SplitPolicy = SplitPolicy()) -> DataFrame:
    """The long frame with all 125 per-side features (before pairing)."""
    return trailing_features(team_games(games), windows=windows or ROLLING_WINDOWS, split=split)


def process_events(games: DataFrame, windows: list[int] | None = None, pairing: str = "event",
                   split: SplitPolicy = SplitPolicy(), sparse_frac: float | None = 0.5,
                   completed_only: bool = False) -> DataFrame:
    """D6 (flagship pipeline). ``pairing='event'`` pairs the two rows of each
    event by id (default, no fan-out); ``'reference'`` joins on
    (entity, date) twice like the reference (fans out on repeated dates).
    ``completed_only`` applies P4 first, so unplayed events neither count as
    losses nor advance game numbers (the reference keeps them, Q9)."""
    windows = windows or ROLLING_WINDOWS
    if completed_only:
        from tandem.operators.filters import completed_filter
        games = completed_filter(games)
    feats = team_features(games, windows, split)
    cols = side_feature_columns_of(feats)
    derived = lambda side: derived_features(ROLLING_STATS, windows, side=side)
    if pairing == "event":
        wide = matchup_by_event(games, feats, cols, derived=derived)
    else:
        wide = matchup_join(games, feats, cols, derived=derived)
    wide = over_under_features(wide, windows)
    return drop_sparse_rows(wide, sparse_frac) if sparse_frac else wide
