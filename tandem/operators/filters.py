"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.names import EXCLUDE_FROM_FEATURES
from tandem.functions.scalars import number_of


def completed_filter(df: DataFrame, home_score: str = "score_home", away_score: str = "score_away",
                     status: str | None = None, final_status: int = 3) -> DataFrame:
    """Completed events only (status == final and both scores present)."""
    cond = F.col(home_score).isNotNull() & F.col(away_score).isNotNull()
    if status:
        cond = cond & (F.col(status) == final_status)
    return df.filter(cond)


def entity_events(df: DataFrame, entity: Column | str, home: str = "home", away: str = "away") -> DataFrame:
    """P5: events where the entity plays on either side."""
    e = F.lit(entity) if isinstance(entity, str) else entity
    return df.filter((F.col(home) == e) | (F.col(away) == e))


def season_in(df: DataFrame, seasons: list[int], negate: bool = False, col: str = "season") -> DataFrame:
    """Membership (or negated membership) of the season list."""
    cond = F.col(col).isin(seasons)
    return df.filter(~cond if negate else cond)


def select_by_exclusion(df: DataFrame, exclude: list[str] | None = None,
                        target: str = "actual_total") -> tuple[list[str], str]:
    """Model feature columns = all columns minus the exclusion list."""
    excl = set(EXCLUDE_FROM_FEATURES if exclude is None else exclude)
    return [c for c in df.columns if c not in excl], target


def project_allowlist(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Keep only allowed columns; error when none is allowed."""
    keep = [c for c in df.columns if c in set(allowed)]
    if not keep:
        raise ValueError("No valid columns provided")
    return df.select(*keep)


def validate_date(df: DataFrame, col: str, strict: bool = False) -> DataFrame:
    """``date_ok`` flag. Reference mode is the pattern YYYY-MM-DD (accepts
    2025-99-99); strict mode also requires a real calendar date."""
    pattern = F.col(col).rlike(r"^\d{4}-\d{2}-\d{2}$")
    ok = F.coalesce(pattern, F.lit(False))
    if strict:
        ok = ok & F.try_to_timestamp(F.col(col), F.lit("yyyy-MM-dd")).isNotNull()
    return df.withColumn("date_ok", ok)


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Bad numbers, "nan" included, become NULL (ANSI casts would throw)."""
    return df.withColumns({c: number_of(F.col(c)) for c in cols})


def align_schema(df: DataFrame, expected: list[str]) -> DataFrame:
    """Add missing expected columns as NULL doubles, drop extras, reorder."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in expected])


def prefix_columns(df: DataFrame, prefix: str, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rename feature columns with a side prefix."""
    return df.select(*(keep or []), *[F.col(c).alias(f"{prefix}{c}") for c in cols])


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL features -> 0 (when no imputer is available)."""
    return df.fillna(0, subset=cols)
