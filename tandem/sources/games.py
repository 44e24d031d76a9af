"""The ``games`` fact table: schema, the test-data view, scans.

One row per event with both sides in the row; natural key (date, away, home).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.scalars import season_of
from tandem.sources.tables import read_table

GAMES_SCHEMA = T.StructType([
    T.StructField("game_id", T.LongType()),
    T.StructField("season", T.IntegerType()),
    T.StructField("date", T.DateType()),
    T.StructField("regular", T.BooleanType()),
    T.StructField("playoffs", T.BooleanType()),
    T.StructField("away", T.StringType()),
    T.StructField("home", T.StringType()),
    T.StructField("score_away", T.LongType()),
    T.StructField("score_home", T.LongType()),
    *[T.StructField(f"{q}_{s}", T.LongType()) for s in ("away", "home")
      for q in ("q1", "q2", "q3", "q4", "ot")],
    T.StructField("whos_favored", T.StringType()),
    T.StructField("spread", T.DoubleType()),
    T.StructField("total", T.DoubleType()),
    T.StructField("moneyline_away", T.LongType()),
    T.StructField("moneyline_home", T.LongType()),
    T.StructField("h2_spread", T.DoubleType()),
    T.StructField("h2_total", T.DoubleType()),
    T.StructField("id_spread", T.IntegerType()),
    T.StructField("id_total", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

FIXTURE_COLUMNS = ["game_id", "season", "date", "away", "home", "score_away", "score_home",
                   "q1_away", "q2_away", "q3_away", "q4_away", "ot_away",
                   "q1_home", "q2_home", "q3_home", "q4_home", "ot_home", "total"]


def _digit(p: Column, div: int) -> Column:
    """15 + floor(p / div) % 20: one synthetic quarter score."""
    base = p if div == 1 else F.floor(p / F.lit(div)).cast("long")
    return F.lit(15) + base % 20


def games_from_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Derive two-sided events from ``orders`` x ``customer`` (test fixture).

    home = the order's customer, away = another customer picked by the order
    key, scores and line derived from the price. The customer count is a
    scalar subquery (computed once), so no join is needed.
    """
    nc = customer.select(F.count(F.lit(1))).scalar()
    k = F.col("o_orderkey")
    p = F.floor(F.col("o_totalprice")).cast("long")
    ot_game = (k % 17) == 0
    unplayed = (k % 97) == 0
    q = {
        "q1_home": _digit(p, 1), "q2_home": _digit(p, 7), "q3_home": _digit(p, 11),
        "q4_home": _digit(p, 13), "q1_away": _digit(p, 17), "q2_away": _digit(p, 19),
        "q3_away": _digit(p, 23), "q4_away": _digit(p, 29),
        "ot_home": F.when(ot_game, F.lit(5) + k % 11).otherwise(F.lit(0).cast("long")),
        "ot_away": F.when(ot_game, F.lit(5) + k % 7).otherwise(F.lit(0).cast("long")),
    }
    date = F.to_date("o_orderdate")
    away_key = (F.col("o_custkey") + 1 + k % 29) % nc
    base = orders.select(
        k.alias("game_id"), date.alias("date"),
        F.concat(F.lit("t"), away_key.cast("string")).alias("away"),
        F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("home"),
        *[c.alias(n) for n, c in q.items()],
        k.alias("_k"),
        F.col("o_totalprice"),
    )
    unplayed = (F.col("_k") % 97) == 0
    score = lambda side: sum((F.col(f"{x}_{side}") for x in ("q1", "q2", "q3", "q4", "ot")), F.lit(0))
    return base.select(
        "game_id", season_of(F.col("date")).alias("season"), "date", "away", "home",
        F.when(unplayed, F.lit(None).cast("long")).otherwise(score("away")).alias("score_away"),
        F.when(unplayed, F.lit(None).cast("long")).otherwise(score("home")).alias("score_home"),
        "q1_away", "q2_away", "q3_away", "q4_away", "ot_away",
        "q1_home", "q2_home", "q3_home", "q4_home", "ot_home",
        F.when((F.col("_k") % 23) == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(175.0) + (F.floor(F.col("o_totalprice")).cast("long") % 81).cast("double") / 2)
         .alias("total"),
    )


def load_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``games`` view over the driver's test tables."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey")
    return games_from_orders(orders, customer)
