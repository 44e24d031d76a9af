"""Per-entity window features.

All trailing features look back at most ``max(windows)`` rows of the same
entity, ordered by ``date, is_home desc, game_id`` (home row first on a tie).

Skew: a window partitioned by entity puts all rows of one entity in one task.
When one entity holds a large share of the rows (the NULL entity too, and even if
they all share a day), its rows are numbered in their order and cut into buckets of
equally many rows. Each bucket is evaluated in its own partition together with a
*halo*: the ``lookback`` rows that precede it, which the row numbers name. Season-to-date
values, which are unbounded, are completed with per-bucket prefix sums. The
list of split entities is bounded by construction (see :func:`hot_entities`), so
it is safe to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, NumericType

from tandem.functions.names import (PHASE_BINS, ROLLING_STATS, ROLLING_WINDOWS, SEASON_STATS,
                                    TREND_STATS, VOLATILITY_STATS, roll_name, std_name)
from tandem.functions.scalars import null_false

# (column, ascending) pairs; the event order within an entity.
GAME_ORDER: list[tuple[str, bool]] = [("date", True), ("is_home", False), ("game_id", True)]

_NO_BUCKET = -(1 << 40)


def order_by(order: list[tuple[str, bool]], reverse: bool = False) -> list[Column]:
    out = []
    for name, asc in order:
        up = asc != reverse
        out.append(F.col(name).asc_nulls_first() if up else F.col(name).desc_nulls_last())
    return out


@dataclass(frozen=True)
class SplitPolicy:
    """When and how to split an entity's rows into buckets.

    An entity is *hot* when it has more than ``max(hot_rows, total/max_hot)``
    rows; hence fewer than ``max_hot`` entities can be hot and the hot list
    has a proven size bound. A hot entity's rows, in its order, are cut every
    ``bucket_rows`` rows, within a day too. ``force`` splits every entity every
    ``force_rows`` rows (tests: bucket boundaries everywhere).
    """
    hot_rows: int = 5_000_000
    max_hot: int = 4096
    force: bool = False
    bucket_rows: int = 1_000_000
    force_rows: int = 7

    @property
    def size(self) -> int:
        return max(1, self.force_rows if self.force else self.bucket_rows)


def _entity_key(entity: str) -> Column:
    """The entity as a string that is never NULL, so that joins meet the NULL entity as well."""
    return F.coalesce(F.concat(F.lit("="), F.col(entity).cast("string")), F.lit("null"))


def hot_entities(df: DataFrame, entity: str, policy: SplitPolicy) -> dict[str, int] | None:
    """Keys of the hot entities -> number of their buckets; ``None`` means all (``force``).

    One aggregation job (map-side partial counts, the total as a scalar subquery). Fewer than
    ``max_hot`` keys can pass the cut, so fetching them to the driver is bounded by construction."""
    if policy.force:
        return None
    counts = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.select(F.sum("_n")).scalar()
    cut = F.greatest(F.lit(policy.hot_rows).cast("long"), F.ceil(total / F.lit(policy.max_hot)).cast("long"))
    rows = counts.filter(F.col("_n") > cut).select(_entity_key(entity), "_n").collect()
    return {key: -(-n // policy.size) for key, n in rows}


def _ranked(rows: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """Add ``_rank``: the row's exact 0-based position among all rows by (entity, order), so that an
    entity's rows have consecutive numbers.

    Rows are range-partitioned by (entity, order), so an entity of any size spans many tasks; they are
    written once (their numbers must not change), and one row for each partition is summed up to offsets,
    which are broadcast: the rows are not shuffled again to be numbered."""
    from tandem.sources.store import written

    by = [F.col("_ek"), *order_by(order)]
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                     .withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn("_rank", F.col("_at") + F.col("_base")).drop("_at", "_part", "_base"))


def mark_hot(df: DataFrame, entity: str, order: list[tuple[str, bool]], policy: SplitPolicy) -> tuple[DataFrame, bool]:
    """(rows with ``_hot`` and ``_bucket``, whether any entity is hot). Where one is, also ``_ek``, the
    entity's key, and ``_rank``, the position of a hot row: bucket b of an entity holds those of its rows
    whose positions begin at b * size."""
    hot = hot_entities(df, entity, policy)
    plain = {"_hot": F.lit(False), "_bucket": F.lit(_NO_BUCKET)}
    if hot is not None and not hot:
        flagged = df.withColumn("_hot", F.lit(False))
        # always _NO_BUCKET; it rests on a column because a partition key that is folded too early makes
        # the optimizer lose columns of an explode over constants below (Spark 4.1)
        day = F.unix_date(F.col(order[0][0]).cast("date")).cast("long")
        return flagged.withColumn("_bucket", F.when(F.col("_hot"), F.floor(day / F.lit(1))).otherwise(F.lit(_NO_BUCKET))), False
    keyed = df.withColumn("_ek", _entity_key(entity))
    if hot is None:
        rows, rest = keyed, None
    else:
        listed = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in hot], "_ek string"))
        rows, rest = keyed.join(listed, "_ek", "left_semi"), keyed.join(listed, "_ek", "left_anti")
    marked = _ranked(rows, order).withColumns(
        {"_hot": F.lit(True), "_bucket": F.floor(F.col("_rank") / F.lit(policy.size))})
    if rest is not None:
        marked = marked.unionByName(rest.withColumns(plain).withColumn("_rank", F.lit(None).cast("long")))
    return marked, True


def with_halo(marked: DataFrame, lookback: int, policy: SplitPolicy, ahead: bool = False) -> DataFrame:
    """Rows flagged ``_halo=False`` plus, for each hot bucket, the ``lookback`` rows before it (``ahead``:
    after it) flagged ``_halo=True``. Row numbers tell the buckets a row is a halo of: no join, no window."""
    base = marked.withColumn("_halo", F.lit(False))
    if lookback <= 0:
        return base
    size = F.lit(policy.size)
    if ahead:
        first, last = F.greatest(F.floor((F.col("_rank") - lookback) / size), F.lit(0)), F.col("_bucket") - 1
    else:
        first, last = F.col("_bucket") + 1, F.floor((F.col("_rank") + lookback) / size)
    halo = (marked.filter(F.col("_hot") & (first <= last))
            .withColumn("_bucket", F.explode(F.sequence(first, last))).withColumn("_halo", F.lit(True)))
    return base.unionByName(halo)


def with_last_source(marked: DataFrame, source: Column) -> DataFrame:
    """Rows flagged ``_halo=False`` plus, for each hot bucket, the last row before it for which ``source``
    holds, however far back, flagged ``_halo=True``. Per bucket one row, found by partial aggregation."""
    cols = marked.columns
    found = F.max_by(F.struct(*cols), F.when(source, F.col("_rank")))
    last = marked.filter(F.col("_hot")).groupBy("_ek", "_bucket").agg(found.alias("_row"))
    before = Window.partitionBy("_ek").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    halo = (last.select("_bucket", F.last("_row", ignorenulls=True).over(before).alias("_row"))
            .filter(F.col("_row").isNotNull())
            .select(*[F.col("_bucket") if c == "_bucket" else F.col(f"_row.{c}").alias(c) for c in cols]))
    return marked.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))


def _season_key(season: str) -> Column:
    return F.coalesce(F.col(season).cast("string"), F.lit("null"))


def _season_prefix(marked: DataFrame, season: str, stats: list[str]) -> DataFrame:
    """Per (entity, bucket): map season -> sums over the entity's earlier buckets
    of that season (hot entities only; one row per bucket)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for s in stats:
        aggs += [F.sum(s).alias(f"s_{s}"), F.count(s).alias(f"c_{s}")]
    per_bucket = marked.filter(F.col("_hot")).groupBy("_ek", "_bucket", _season_key(season).alias("_sk")).agg(*aggs)
    wp = Window.partitionBy("_ek", "_sk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = ["n"] + [f"{k}_{s}" for s in stats for k in ("s", "c")]
    prefix = per_bucket.select("_ek", "_bucket", "_sk",
                               *[F.coalesce(F.sum(n).over(wp), F.lit(0)).alias(n) for n in names])
    return (prefix.groupBy("_ek", "_bucket")
            .agg(F.map_from_entries(F.collect_list(F.struct("_sk", F.struct(*names)))).alias("_pre")))


def season_phase_of(game_num: Column) -> Column:
    """(0,25] early, (25,55] mid, (55,100] late, else NULL."""
    phase = F.lit(None).cast("string")
    for lo, hi, label in reversed(PHASE_BINS):
        phase = F.when((game_num > lo) & (game_num <= hi), F.lit(label)).otherwise(phase)
    return phase


def derived_features(stats: list[str], windows: list[int], pace: bool = True, trend: bool = True,
                     side: str = "") -> dict[str, Column]:
    """Pace and trend features (W3, W4): arithmetic on the trailing means of the same row, NULL where
    these are. ``side`` prefixes the columns they are made of."""
    of = lambda s, w: F.col(side + roll_name(s, w))
    out: dict[str, Column] = {}
    if pace and {"points_scored", "points_allowed", "total_points"} <= set(stats):
        for w in windows:
            out[f"off_pace_{w}"] = of("points_scored", w)
            out[f"def_pace_{w}"] = of("points_allowed", w)
            out[f"pace_{w}"] = of("total_points", w)
            out[f"pace_diff_{w}"] = of("points_scored", w) - of("points_allowed", w)
    if trend and 3 in windows and 10 in windows:
        for name, s in TREND_STATS.items():
            if s in stats:
                out[name] = of(s, 3) - of(s, 10)
    return out


def season_counters(stats: list[str]) -> list[str]:
    """Names of the season-to-date counters of a row (rows, sums and counts before it)."""
    return ["season_rows"] + [f"season_{k}_{s}" for s in stats for k in ("sum", "count")]


def chunk_rows(windows: list[int]) -> int:
    """Rows of a chunk for which the fewest earlier rows and chunks have to be fetched (see :func:`with_trailing`)."""
    fetched = lambda c: c + len({(j, c) for w in windows for j in range(1, w // c)}
                                | {(w // c, w % c) for w in windows if w % c and w > c})
    return min(range(1, max(windows) + 1), key=fetched)


def with_trailing(rows: DataFrame, window: Window, stats: list[str], std_stats: list[str], windows: list[int],
                  inclusive: bool = False) -> DataFrame:
    """Add mean and sample deviation of every window, put together from chunks.

    A sliding frame adds up its w rows anew for each row and statistic. Here the rows of one chunk are
    fetched by ``lag`` once for all statistics and summed up, and longer windows add the sums of the
    chunks before (fetched by ``lag`` again): w rows cost about c + w / c additions. Deviations add the
    squares about each chunk's own mean and those of the chunk means about the window's, so nothing cancels."""
    size = chunk_rows(windows)
    start = 0 if inclusive else 1
    names = list(dict.fromkeys([*stats, *std_stats]))
    at = {s: f"v{i}" for i, s in enumerate(names)}
    values = F.struct(*[F.col(s).cast("double").alias(at[s]) for s in names])
    pieces = {w: [(j * size, size) for j in range(w // size)] + ([(w // size * size, w % size)] if w % size else [])
              for w in windows}
    lengths = sorted({n for ps in pieces.values() for _, n in ps})
    rows = rows.withColumns({f"_v{i}": F.lag(values, start + i).over(window) if start + i else values
                             for i in range(max(lengths))})

    def chunk(n: int) -> dict[str, Column]:
        out = {}
        for s in names:
            got = [F.col(f"_v{i}")[at[s]] for i in range(n)]
            out[f"s_{at[s]}"] = sum((F.coalesce(x, F.lit(0.0)) for x in got[1:]), F.coalesce(got[0], F.lit(0.0)))
            out[f"n_{at[s]}"] = sum((x.isNotNull().cast("int") for x in got[1:]), got[0].isNotNull().cast("int"))
        return out

    mean = lambda total, count: total / F.nullif(count, F.lit(0))
    square = lambda x: F.coalesce(x * x, F.lit(0.0))
    rows = rows.withColumns({f"_c{n}": F.struct(*[c.alias(k) for k, c in chunk(n).items()]) for n in lengths})
    if std_stats:
        rows = rows.withColumns({f"_m{n}": F.struct(*[mean(F.col(f"_c{n}")[f"s_{at[s]}"], F.col(f"_c{n}")[f"n_{at[s]}"]).alias(at[s])
                                                      for s in std_stats]) for n in lengths})
        rows = rows.withColumns({f"_q{n}": F.struct(*[
            sum((square(F.col(f"_v{i}")[at[s]] - F.col(f"_m{n}")[at[s]]) for i in range(n)), F.lit(0.0)).alias(at[s])
            for s in std_stats]) for n in lengths})
    rows = rows.drop(*[f"_v{i}" for i in range(max(lengths))])
    kinds = ["c", "m", "q"] if std_stats else ["c"]
    fetch = sorted({piece for ps in pieces.values() for piece in ps if piece[0]})
    rows = rows.withColumns({f"_{k}{n}_{off}": F.lag(f"_{k}{n}", off).over(window) for off, n in fetch for k in kinds})
    part = lambda k, piece, name: F.col(f"_{k}{piece[1]}_{piece[0]}" if piece[0] else f"_{k}{piece[1]}")[name]
    total = lambda k, ps, name, zero: sum((F.coalesce(part(k, p, name), zero) for p in ps[1:]), F.coalesce(part(k, ps[0], name), zero))
    sums = {(w, s): (total("c", ps, f"s_{at[s]}", F.lit(0.0)), total("c", ps, f"n_{at[s]}", F.lit(0)))
            for w, ps in pieces.items() for s in names}
    out = {roll_name(s, w): mean(*sums[w, s]) for w in windows for s in stats}
    if std_stats:
        about = {(w, s): roll_name(s, w) if s in stats else f"_about_{at[s]}_{w}" for w in windows for s in std_stats}
        rows = rows.withColumns({**out, **{name: mean(*sums[k]) for k, name in about.items()}})
        out = {}
        for (w, s), name in about.items():
            count = sums[w, s][1]
            spread = sum((F.coalesce(part("c", p, f"n_{at[s]}"), F.lit(0)) * square(part("m", p, at[s]) - F.col(name))
                          for p in pieces[w]), total("q", pieces[w], at[s], F.lit(0.0)))
            out[std_name(s, w)] = F.when(count > 1, F.sqrt(spread / (count - 1)))
    return rows.withColumns(out)


def trailing_features(long: DataFrame, entity: str = "team", order: list[tuple[str, bool]] | None = None,
                      stats: list[str] | None = None, windows: list[int] | None = None,
                      std_stats: list[str] | None = None, date_col: str = "date",
                      season_col: str | None = "season", rest: bool = True, pace: bool = True,
                      trend: bool = True, rest_default: int = 3,
                      split: SplitPolicy = SplitPolicy(), inclusive: bool = False,
                      season_stats: dict[str, str] | None = None, counters: bool = False,
                      base: str | None = None) -> DataFrame:
    """W1-W9 for every row of ``long``: leak-free trailing means/stds over the
    previous w rows, pace and trend projections, rest days, season-to-date.

    ``stats``/``windows``/``std_stats`` narrow the output; ``season_col=None``
    skips the season features, ``rest=False`` the rest features. ``season_stats``
    maps season-to-date means to their stat (default: those of the games table).
    ``counters`` adds the :func:`season_counters` they are made of; ``base`` names a struct of such
    counters to add, for rows whose season began before the first row of ``long``.
    """
    order = order or GAME_ORDER
    stats = ROLLING_STATS if stats is None else stats
    windows = ROLLING_WINDOWS if windows is None else windows
    std_stats = VOLATILITY_STATS if std_stats is None else std_stats
    lookback = max(windows + [1 if rest else 0])

    marked, any_hot = mark_hot(long, entity, order, split)
    full = with_halo(marked, lookback, split) if any_hot else marked.withColumn("_halo", F.lit(False))
    # without hot entities all is partitioned by the entity alone, which later steps by entity can build on;
    # else by the key of the season sums, so that the features are not shuffled to meet them
    part = ["_ek", "_bucket"] if any_hot else [entity]
    # repeated rows at the edge of a bucket come in the order of their numbers, their halo copies included
    ordered = order_by(order) + ([F.col("_rank")] if any_hot else [])
    wt = Window.partitionBy(*part).orderBy(*ordered)
    if season_stats is None:
        season_stats = {k: v for k, v in SEASON_STATS.items() if v in long.columns}
    pre_stats = sorted(set(season_stats.values()))
    if season_col:  # sorted by season first, while the rows are narrow
        ws = Window.partitionBy(*part, season_col, *(["_halo"] if any_hot else [])).orderBy(*ordered)
        before = ws.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        to_date = {"_rn": F.row_number().over(ws)}
        for s in pre_stats:
            to_date[f"_rs_{s}"] = F.sum(s).over(before)
            to_date[f"_rc_{s}"] = F.count(s).over(before)
        full = full.withColumns(to_date)
    cols: dict[str, Column] = {}
    # decimals and intervals keep their own averages
    chunked = lambda s: isinstance(long.schema[s].dataType, NumericType) and not isinstance(long.schema[s].dataType, DecimalType)
    for w in windows:
        # leak-free: the w rows before; ``inclusive`` (serving after the
        # latest game): the latest w rows including the current one
        frame = wt.rowsBetween(-(w - 1), 0) if inclusive else wt.rowsBetween(-w, -1)
        for s in stats:
            if not chunked(s):
                cols[roll_name(s, w)] = F.avg(s).over(frame)
        for s in std_stats:
            if not chunked(s):
                cols[std_name(s, w)] = F.stddev_samp(s).over(frame)
    if rest:
        prev = F.lag(date_col).over(wt)
        cols["days_rest"] = F.coalesce(F.datediff(F.col(date_col), prev), F.lit(rest_default))
    out = full.withColumns(cols) if cols else full
    sliding = [s for s in stats if chunked(s)], [s for s in std_stats if chunked(s)]
    if windows and any(sliding):
        out = with_trailing(out, wt, *sliding, windows, inclusive)
    out = out.filter(~F.col("_halo"))

    if season_col:
        own = lambda name: F.coalesce(F.col(base)[name], F.lit(0)) if base else F.lit(0)
        if any_hot:
            out = out.join(_season_prefix(marked, season_col, pre_stats), ["_ek", "_bucket"], "left")
            earlier = F.col("_pre")[_season_key(season_col)]
            pre = lambda name: F.coalesce(earlier[name], F.lit(0))
        else:
            pre = lambda name: F.lit(0)
        rows = pre("n") + F.col("_rn") + own("season_rows")
        derived = {"game_num": rows.cast("int")}
        for s in pre_stats:
            derived[f"_sum_{s}"] = pre(f"s_{s}") + F.coalesce(F.col(f"_rs_{s}"), F.lit(0)) + own(f"season_sum_{s}")
            derived[f"_count_{s}"] = pre(f"c_{s}") + F.col(f"_rc_{s}") + own(f"season_count_{s}")
        out = out.withColumns(derived)
        means = {name: F.when(F.col(f"_count_{s}") > 0, F.col(f"_sum_{s}").cast("double") / F.col(f"_count_{s}"))
                 for name, s in season_stats.items()}
        if counters:
            means["season_rows"] = (F.col("game_num") - 1).cast("long")
            for s in pre_stats:
                means[f"season_sum_{s}"], means[f"season_count_{s}"] = F.col(f"_sum_{s}"), F.col(f"_count_{s}")
        out = out.withColumns(means)
        out = out.withColumn("season_phase", season_phase_of(F.col("game_num")))

    post = derived_features(stats, windows, pace, trend)
    if rest:
        post["is_b2b"] = null_false(F.col("days_rest") == 1)
        post["long_rest"] = null_false(F.col("days_rest") >= 4)
    if post:
        out = out.withColumns(post)
    internal = [c for c in out.columns if c.startswith("_")]
    return out.drop(*internal)


# --------------------------------------------------------------------------- W10, W11

def latest_per_entity(df: DataFrame, entity: str = "team",
                      order: list[tuple[str, bool]] | None = None) -> DataFrame:
    """The newest row of each entity (max_by with partial aggregation:
    map-side combine keeps one row per entity per task, so a hot entity is
    reduced before the shuffle)."""
    order = order or GAME_ORDER
    key = F.struct(*[(F.col(c) if asc else -F.col(c)).alias(f"k{i}") for i, (c, asc) in enumerate(order)])
    others = [c for c in df.columns if c != entity]
    row = F.struct(*[F.col(c) for c in others])
    return df.groupBy(entity).agg(F.max_by(row, key).alias("_r")).select(entity, "_r.*")


def recent_n(df: DataFrame, n: int = 15, entity: str = "team",
             order: list[tuple[str, bool]] | None = None) -> DataFrame:
    """The last ``n`` rows per entity, n clamped to 1..100 (top-k per group:
    planned as a WindowGroupLimit with a partial limit before the shuffle)."""
    order = order or GAME_ORDER
    n = min(max(1, int(n)), 100)
    w = Window.partitionBy(entity).orderBy(*order_by(order, reverse=True))
    return (df.withColumn("recent_rank", F.row_number().over(w))
            .filter(F.col("recent_rank") <= n))


# --------------------------------------------------------------------------- W12

def global_position(df: DataFrame, order: list[tuple[str, bool]], keep: list[str]) -> DataFrame:
    """1-based global row position in ``order`` without a single-partition window.

    Range-partitions and sorts (balanced by sampling, so a hot date is spread
    over tasks), tags rows with their partition and in-partition index, and
    adds the row count of all earlier partitions (a table with one row per
    partition). The tagged frame is checkpointed to the shared checkpoint
    folder so both uses see one materialisation.
    """
    from tandem.session import cut_lineage

    tagged = (df.select(*keep).orderBy(*order_by(order))
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = cut_lineage(tagged)
    per_part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_m0"))
    offsets = per_part.select(
        "_pid", "_m0",
        F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn("position", F.col("_off") + (F.col("_mid") - F.col("_m0")) + 1)
            .drop("_pid", "_mid", "_off", "_m0"))


def ts_folds(df: DataFrame, n_splits: int = 5, order: list[tuple[str, bool]] | None = None,
             keep: list[str] | None = None) -> DataFrame:
    """Expanding time-series folds. With n rows sorted by ``order`` and
    block = n // (n_splits + 1), fold i (0-based) validates positions
    [n - (n_splits - i) * block, + block) and trains on everything before.
    Output: ``keep`` columns + position (1-based) + ``fold`` (validation fold,
    NULL for rows only ever used for training)."""
    order = order or [("date", True), ("game_id", True)]
    keep = keep or [c for c, _ in order]
    pos = global_position(df, order, keep)
    n = pos.count()                    # one number; the rows stay distributed
    block = n // (n_splits + 1)
    first_val = n - block * n_splits
    idx0 = F.col("position") - 1
    if block == 0:
        return pos.withColumn("fold", F.lit(None).cast("int"))
    fold = F.when(idx0 >= first_val, F.floor((idx0 - first_val) / block).cast("int"))
    return pos.withColumn("fold", fold)


# --------------------------------------------------------------------------- J3

def asof_latest(left: DataFrame, right: DataFrame, entity: str, payload: list[str],
                left_date: str = "date", right_order: list[tuple[str, bool]] | None = None,
                split: SplitPolicy = SplitPolicy(), inclusive: bool = False) -> DataFrame:
    """For each ``left`` row, the latest ``right`` row of the same entity
    with ``right.date < left.date`` (``<=`` when ``inclusive``), as a struct
    column ``asof`` (NULL when none).

    Union form: left and right rows are interleaved in one per-entity order
    (on equal dates the left row sorts before the right rows when strict,
    after them when inclusive) and ``last(payload, ignorenulls)`` over the
    preceding rows picks the as-of match. One shuffle by entity; hot entities
    are split into buckets and each bucket gets a one-row halo, the
    latest right row before it, so the result is identical.
    """
    right_order = right_order or GAME_ORDER
    rdate = right_order[0][0]
    l = left.select(F.col(entity).alias("_e"), F.col(left_date).alias("_d"),
                    F.lit(0 if not inclusive else 1).alias("_kind"),
                    F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
                    F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias("_p"),
                    *[F.lit(None).cast(right.schema[c].dataType).alias(f"_o{i}") for i, (c, _) in enumerate(right_order[1:])])
    r = right.select(F.col(entity).alias("_e"), F.col(rdate).alias("_d"),
                     F.lit(1 if not inclusive else 0).alias("_kind"),
                     F.lit(None).cast(l.schema["_left"].dataType).alias("_left"),
                     F.struct(*payload).alias("_p"),
                     *[F.col(c).alias(f"_o{i}") for i, (c, _) in enumerate(right_order[1:])])
    both = l.unionByName(r)
    order = [("_d", True), ("_kind", True)] + [(f"_o{i}", asc) for i, (_, asc) in enumerate(right_order[1:])]
    marked, any_hot = mark_hot(both, "_e", order, split)
    full = with_last_source(marked, F.col("_p").isNotNull()) if any_hot else marked.withColumn("_halo", F.lit(False))
    w = Window.partitionBy("_e", "_bucket").orderBy(*order_by(order)).rowsBetween(Window.unboundedPreceding, -1)
    out = (full.withColumn("asof", F.last("_p", ignorenulls=True).over(w))
           .filter(~F.col("_halo") & F.col("_left").isNotNull()))
    return out.select("_left.*", "asof")
