"""Tables at rest: Parquet layout, latest-wins upserts, scans.

Upsert = union of base and delta tagged with an ingest sequence, keep the
newest row per natural key (row_number = 1, a WindowGroupLimit), and commit
only the touched partitions as the next version of the table (see ``versions``).
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tandem.functions.names import ALLOWED_GAME_COLUMNS
from tandem.functions.scalars import number_of
from tandem.operators.filters import project_allowlist
from tandem.sources.games import GAMES_SCHEMA
from tandem.sources.versions import VersionedTable

GAME_KEY = ["date", "away", "home"]
SCHEDULE_KEY = ["game_date", "away", "home"]
TEAM_STATS_KEY = ["team", "date"]

# Column defaults of the games table (the DDL's DEFAULT clauses).
GAME_DEFAULTS = {"regular": True, "playoffs": False, "id_spread": 0, "id_total": 0,
                 **{f"{q}_{s}": 0 for q in ("q1", "q2", "q3", "q4", "ot") for s in ("away", "home")}}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local)."""
    from tandem.session import checkpoint_dir
    base = checkpoint_dir(spark)
    return os.path.join(base, "tandem", f"{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder, for plans that read them several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --------------------------------------------------------------------------- S1, S2
def read_games_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column read as a string by header name (no
    type inference); PERMISSIVE, so short or long lines yield NULLs instead of
    failing. Typing and defaults are :func:`conform_games`."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)


CORRUPT = "_corrupt"


def read_games_csv_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S1 with a quarantine: (conformed good rows, bad rows as ``raw`` and ``reason``).

    Bad are lines that do not fit the header (too few or too many fields), rows whose
    date is no date, and rows without an entity on a side; numbers that do not parse are
    NULL or their default as in :func:`conform_games`."""
    from pyspark.sql import types as T
    header = spark.read.option("header", True).csv(path).schema
    schema = T.StructType([*header.fields, T.StructField(CORRUPT, T.StringType())])
    # all columns are parsed, else a line with missing fields would pass where none is asked for
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
           .option("columnPruning", False).schema(schema).csv(path))
    have = set(header.names)
    text = lambda c: F.trim(F.col(c)) if c in have else F.lit(None).cast("string")
    reason = (F.when(F.col(CORRUPT).isNotNull(), "fields do not fit the header")
              .when(text("date").try_cast("date").isNull(), "no date")
              .when((F.coalesce(text("away"), F.lit("")) == "") | (F.coalesce(text("home"), F.lit("")) == ""), "no entity"))
    tagged = raw.withColumn("_reason", reason)
    bad = tagged.filter(F.col("_reason").isNotNull()).select(
        F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*header.names))).alias("raw"), F.col("_reason").alias("reason"))
    return conform_games(tagged.filter(F.col("_reason").isNull()).drop("_reason", CORRUPT)), bad


def quarantine(bad: DataFrame, path: str, source: str) -> None:
    """Append bad rows (raw, reason) of a source to the quarantine table."""
    bad.select(F.lit(source).alias("source"), "raw", "reason").write.mode("append").parquet(path)


def conform_games(raw: DataFrame) -> DataFrame:
    """Cast every column to the games schema; unparsable or missing values
    take the column default (quarters 0, regular true, playoffs false, ids 0)
    or NULL; booleans accept 0/1/true/false."""
    cols = []
    have = set(raw.columns)
    for f in GAMES_SCHEMA.fields:
        src = F.col(f.name) if f.name in have else F.lit(None).cast("string")
        t = f.dataType.simpleString()
        if t == "boolean":
            s = F.lower(F.trim(src.cast("string")))
            val = F.when(s.isin("1", "true", "t", "1.0"), F.lit(True)).when(s.isin("0", "false", "f", "0.0"), F.lit(False))
        elif t in ("bigint", "int"):
            val = number_of(src).try_cast(t)
        elif t == "double":
            val = number_of(src)
        else:
            val = src.cast("string").try_cast(t)
        if f.name in GAME_DEFAULTS:
            val = F.coalesce(val, F.lit(GAME_DEFAULTS[f.name]).cast(t))
        cols.append(val.alias(f.name))
    return raw.select(*cols)


# --------------------------------------------------------------------------- S3, S4
def write_games(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: Parquet partitioned by season; batches are Spark partitions."""
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("season").parquet(path))


def upsert_latest(base: DataFrame, delta: DataFrame, key: list[str], order_col: str | None = None,
                  coalesce_old: bool = False, defaults: dict | None = None, source: str | None = None) -> DataFrame:
    """Latest-wins by natural key.

    Reference mode (``coalesce_old=False``): the newer row replaces the whole
    older row; columns it lacks take their default in ``defaults``, else NULL.
    ``coalesce_old`` keeps the older non-NULL value where the newer one is NULL.
    Within one side, ties on the key are broken by ``order_col`` (higher wins),
    without one by the remaining columns in order. ``source`` names a column that
    tells where the newest row of the key is from: 0 base, 1 delta.
    """
    cols = base.columns
    given = {} if coalesce_old else defaults or {}
    d = delta.select(*[F.col(c) if c in delta.columns else F.lit(given.get(c)).cast(base.schema[c].dataType).alias(c)
                       for c in cols])
    tagged = (base.withColumn("_src", F.lit(0)).unionByName(d.withColumn("_src", F.lit(1))))
    order = [F.col("_src").desc()] + [F.col(c).desc() for c in ([order_col] if order_col else
                                                                [c for c in cols if c not in key])]
    w = Window.partitionBy(*key).orderBy(*order)
    origin = [F.col("_src").alias(source)] if source else []
    if not coalesce_old:
        return tagged.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).select(*cols, *origin)
    # newest non-null value per column: first(ignorenulls) over the ordered key group
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = tagged.select(*key, *[F.first(c, ignorenulls=True).over(full).alias(c) for c in cols if c not in key],
                           "_src", F.row_number().over(w).alias("_rn"))
    return merged.filter(F.col("_rn") == 1).select(*cols, *origin)


def create_table(spark: SparkSession, path: str, rows: DataFrame, partition_col: str = "season") -> VersionedTable:
    """S3 as a versioned table: the rows are its first version."""
    table = VersionedTable(spark, path, partition_col)
    table.commit(rows)
    return table


def upsert_into(spark: SparkSession, path: str, delta: DataFrame, key: list[str],
                partition_col: str = "season", order_col: str | None = None, coalesce_old: bool = False,
                defaults: dict | None = None, tags: dict | None = None) -> dict:
    """S4 on a versioned table: read the partitions the delta touches, merge, and commit just
    those. The partition is a function of the key or NULL (unknown): the NULL partition is
    merged too where the delta has a key of its rows, and for delta rows without a partition
    the stored one is looked up by key; rows with other keys stay.

    Returns what was written, observed during the write itself: ``version`` (None if the
    delta was empty), ``rows`` (of the touched partitions) and ``from_delta``."""
    table = VersionedTable(spark, path, partition_col)
    base = table.read()
    delta = delta.persist()  # partition values, stray keys and merge read it
    try:
        # a delta touches few partitions: their values prune the scan
        touched = [r[0] for r in delta.select(partition_col).distinct().collect()]
        if not touched:
            return {"version": None, "rows": 0, "from_delta": 0, "partitions": []}
        unknown = F.col(partition_col).isNull()
        if None in touched:  # rows whose partition the delta does not know may stand anywhere
            keys = delta.filter(unknown).select(*key).distinct()
            found = base.filter(~unknown).join(keys, key, "left_semi").select(partition_col).distinct().collect()
            touched += [r[0] for r in found if r[0] not in touched]
        elif not base.filter(unknown).join(delta.select(*key).distinct(), key, "left_semi").isEmpty():
            touched.append(None)
        merged = upsert_latest(base.filter(table.partitions_of(touched)), delta, key, order_col, coalesce_old, defaults,
                               source="_from_delta")
        seen = Observation()
        written = merged.observe(seen, F.count(F.lit(1)).alias("rows"),
                                 F.coalesce(F.sum("_from_delta"), F.lit(0)).alias("from_delta"))
        number = table.commit(written.select(*base.columns), touched, tags)
        return {"version": number, **seen.get, "partitions": touched}
    finally:
        delta.unpersist()


# --------------------------------------------------------------------------- S5-S8
def scan_all_games(games: DataFrame) -> DataFrame:
    """All games by date; 0/1 flags as booleans when present."""
    out = games
    for c in ("regular", "playoffs"):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast("boolean"))
    return out.orderBy("date", "game_id")


def scan_season(games: DataFrame, season: int | Column) -> DataFrame:
    """One season (partition pruning when stored partitioned by season)."""
    s = F.lit(season) if isinstance(season, int) else season
    return games.filter(F.col("season") == s)


def scan_date_range(games: DataFrame, start, end, col: str = "date") -> DataFrame:
    """``date BETWEEN start AND end`` (inclusive), pushed to the scan."""
    lo = F.lit(start).cast("date") if isinstance(start, str) else start
    hi = F.lit(end).cast("date") if isinstance(end, str) else end
    return games.filter(F.col(col).between(lo, hi))


def project_game_columns(df: DataFrame) -> DataFrame:
    """Keep the writable game columns only."""
    return project_allowlist(df, ALLOWED_GAME_COLUMNS)


# --------------------------------------------------------------------------- S12-S14, S17
def prediction_rows(df: DataFrame, model_version: str | Column = "v1.0", date_col: str = "date",
                    pred: str = "prediction", line: str = "total", entities: DataFrame | None = None) -> DataFrame:
    """Validated prediction log rows. Rows whose date is not YYYY-MM-DD or whose
    entities are empty (with ``entities``, a one-column frame: not listed there) are
    rejected; line coerced (bad -> NULL); model version sanitised to [a-zA-Z0-9._-], 50 chars."""
    mv = F.lit(model_version) if isinstance(model_version, str) else model_version
    day = F.col(date_col).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$")
    ok = number_of(F.col(pred)).isNotNull() & day & (F.trim("away") != "") & (F.trim("home") != "")
    if entities is not None:
        for side in ("away", "home"):
            known = entities.select(F.col(entities.columns[0]).alias(side)).distinct()
            df = df.join(known, side, "left_semi")
    return (df.filter(ok)
            .select(F.col(date_col).alias("game_date"), "away", "home",
                    number_of(F.col(pred)).alias("predicted_total"),
                    number_of(F.col(line)).alias("vegas_total"),
                    F.substring(F.regexp_replace(mv, r"[^a-zA-Z0-9._-]", ""), 1, 50).alias("model_version")))


def validated(df: DataFrame, date_col: str = "game_date", entities: DataFrame | None = None,
              line: str | None = "vegas_total", strict_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rejected rows with ``reason``). A date must read YYYY-MM-DD, both
    entities must be known (with ``entities``, a frame whose first column lists them; else not
    empty), and with ``strict_line`` a line that is given must be a number."""
    day = F.coalesce(F.col(date_col).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    tagged = df.withColumn("reason", F.when(~day, "invalid date"))
    for side in ("away", "home"):
        if entities is None:
            ok = F.coalesce(F.trim(side) != "", F.lit(False))
        else:
            known = entities.select(F.lower(F.col(entities.columns[0])).alias("_known")).distinct().withColumn("_ok", F.lit(True))
            tagged = tagged.join(known, F.lower(F.col(side)) == F.col("_known"), "left").drop("_known")
            ok = F.coalesce("_ok", F.lit(False))
        tagged = tagged.withColumn("reason", F.coalesce("reason", F.when(~ok, f"invalid {side} entity"))).drop("_ok")
    if line and strict_line:
        bad_line = F.col(line).isNotNull() & number_of(F.col(line)).isNull()
        tagged = tagged.withColumn("reason", F.coalesce("reason", F.when(bad_line, "invalid line")))
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def month_of(col: str) -> Column:
    """Partition value of the schedule and of the prediction log: YYYY-MM."""
    return F.date_format(F.col(col).cast("date"), "yyyy-MM")


def upsert_schedule(spark: SparkSession, path: str, rows: DataFrame, entities: DataFrame | None = None) -> tuple[dict, DataFrame]:
    """Validated slate rows (game_date, away, home, scheduled_time, vegas_total) replace those of
    the same key in the stored schedule, a versioned table by month. Returns (counts, rejected rows)."""
    good, bad = validated(rows, entities=entities)
    good = good.select(F.col("game_date").cast("date").alias("game_date"), "away", "home", "scheduled_time",
                       number_of(F.col("vegas_total")).alias("vegas_total"), month_of("game_date").alias("game_month"))
    table = VersionedTable(spark, path, "game_month")
    if table.current() is None:
        table.commit(good.limit(0))
    return upsert_into(spark, path, good, SCHEDULE_KEY, partition_col="game_month"), bad


def log_predictions(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Prediction rows added to the stored log, a versioned table by month; re-runs add rows."""
    table = VersionedTable(spark, path, "game_month")
    empty = F.lit(None).cast("double")
    full = rows.withColumns({"game_month": month_of("game_date"), "actual_total": empty, "prediction_error": empty})
    return table.commit(full, replaced=[])


def append_predictions(df: DataFrame, path: str) -> None:
    """Append-only log (re-runs add rows, as in the reference)."""
    df.write.mode("append").parquet(path)


def scheduled_for_date(scheduled: DataFrame, game_date) -> DataFrame:
    """Equality lookup of a day's slate (a date string, date or Column)."""
    d = game_date if isinstance(game_date, Column) else F.lit(game_date).cast("date")
    return scheduled.filter(F.col("game_date") == d)


def load_or_seed(spark: SparkSession, table_path: str, csv_path: str) -> DataFrame:
    """The stored table when it has rows, else the CSV conformed (S1+S2).
    The emptiness test is a one-row job."""
    versioned = VersionedTable(spark, table_path)
    if versioned.current() is not None:
        stored = versioned.read()
        return stored if not stored.isEmpty() else conform_games(read_games_csv(spark, csv_path))
    try:
        t = spark.read.parquet(table_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # a damaged table is an error, not a reason to seed
            raise
    else:
        if not t.isEmpty():
            return t
    return conform_games(read_games_csv(spark, csv_path))
