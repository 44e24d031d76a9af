"""Set operations (U1 lives in longform; U2 here)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators.windows import order_by


def first_per_key(df: DataFrame, key: str | list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """First row per key in an explicit order (``dropDuplicates`` keeps an
    arbitrary row). Planned as a WindowGroupLimit, which keeps one row per key
    in every map task before the shuffle, so a hot key is reduced early."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order_by(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
