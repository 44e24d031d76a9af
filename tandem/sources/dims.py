"""Entity dimension and code mapping.

The dimension has one row per external code: ``external_code`` (upper case,
as a feed sends it), ``code`` (our canonical lower-case code), ``full_name``.
Aliases are extra rows pointing to the same canonical code, so history never
splits between two spellings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_dimension(customer: DataFrame) -> DataFrame:
    """Dimension derived from the customer table: code ``t<key>``, external
    code ``T<key>``, numeric feed id = key, and for every tenth entity an alias
    external code ``A<key>``."""
    key = F.col("c_custkey")
    main = customer.select(F.concat(F.lit("T"), key.cast("string")).alias("external_code"),
                           F.concat(F.lit("t"), key.cast("string")).alias("code"),
                           key.alias("feed_id"), F.col("c_name").alias("full_name"))
    alias = (customer.filter(key % 10 == 0)
             .select(F.concat(F.lit("A"), key.cast("string")).alias("external_code"),
                     F.concat(F.lit("t"), key.cast("string")).alias("code"),
                     F.lit(None).cast("long").alias("feed_id"), F.col("c_name").alias("full_name")))
    return main.unionByName(alias)


def map_codes(df: DataFrame, col: str, dim: DataFrame, out: str | None = None) -> DataFrame:
    """External code -> canonical code (upper-cased lookup), unknown codes
    pass through lower-cased. An equi-join; Spark broadcasts the dimension when
    its measured size is under the broadcast threshold."""
    out = out or col
    d = dim.select(F.col("external_code").alias("_ext"), F.col("code").alias("_code"))
    j = df.join(d, F.upper(F.col(col)) == F.col("_ext"), "left")
    return j.withColumn(out, F.coalesce(F.col("_code"), F.lower(F.col(col)))).drop("_ext", "_code")


def map_feed_ids(df: DataFrame, col: str, dim: DataFrame, out: str) -> DataFrame:
    """Numeric feed id -> canonical code (NULL when unknown)."""
    d = dim.filter(F.col("feed_id").isNotNull()).select(F.col("feed_id").alias("_id"), F.col("code").alias(out))
    return df.join(d, F.col(col) == F.col("_id"), "left").drop("_id")


def full_names(df: DataFrame, col: str, dim: DataFrame, out: str) -> DataFrame:
    """Code -> full name, defaulting to the code itself."""
    d = dim.filter(F.col("feed_id").isNotNull()).select(F.col("code").alias("_c"), F.col("full_name").alias("_n"))
    return (df.join(d, F.col(col) == F.col("_c"), "left")
            .withColumn(out, F.coalesce(F.col("_n"), F.col(col))).drop("_c", "_n"))


def validate_entity(df: DataFrame, col: str, dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P10: split rows into (valid, quarantine with reason) by whether
    lower(entity) is a known code."""
    codes = dim.select(F.lower(F.col("code")).alias("_k")).distinct()
    tagged = df.join(codes.withColumn("_ok", F.lit(True)), F.lower(F.col(col)) == F.col("_k"), "left")
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    valid = tagged.filter(ok).drop("_k", "_ok")
    bad = tagged.filter(~ok).drop("_k", "_ok").withColumn("reason", F.concat(F.lit("unknown entity: "), F.col(col)))
    return valid, bad


def lower_entity(c: Column) -> Column:
    return F.lower(F.trim(c))
