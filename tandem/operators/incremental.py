"""Trailing and season features of new rows from stored state.

State is a versioned table: for each entity its last ``lookback + 1`` rows, each with the season
counters before it, and the entity's number of rows. That is all that W1-W9 of later rows need, so new
rows cost as much as they are and not as the history is. (Seasons of an entity follow one another; rows
without a season may stand anywhere, so the newest row of either kind is kept as well.) The features come from the same windows
(:func:`trailing_features`) as over the whole history, hot entities included.

Rows are late when they do not come after their entity's newest row (or repeat it). Their features, and those
of the rows after them, cannot follow from the state: they are returned apart, and the caller keeps them in a
side table or rebuilds their entities from the history (:meth:`FeatureState.rebuild`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.operators.windows import (GAME_ORDER, SplitPolicy, latest_per_entity, order_by, season_counters,
                                      trailing_features)
from tandem.sources.store import scratch_path
from tandem.sources.versions import VersionedTable


@dataclass(frozen=True)
class FeatureSpec:
    """What to compute: the arguments of :func:`trailing_features` that the state depends on."""
    entity: str = "team"
    order: list = field(default_factory=lambda: GAME_ORDER)
    stats: list = field(default_factory=list)
    std_stats: list = field(default_factory=list)
    windows: list = field(default_factory=lambda: [3, 5, 10, 15])
    season_stats: dict = field(default_factory=dict)
    date_col: str = "date"
    season_col: str = "season"
    rest: bool = True
    split: SplitPolicy = SplitPolicy()

    @property
    def lookback(self) -> int:
        return max(self.windows)

    @property
    def columns(self) -> list[str]:
        """Columns of a row that state keeps."""
        return list(dict.fromkeys([self.entity, *[c for c, _ in self.order], self.date_col, self.season_col, *self.stats,
                                   *self.std_stats, *self.season_stats.values()]))

    @property
    def counters(self) -> list[str]:
        return season_counters(sorted(set(self.season_stats.values())))

    def features(self, rows: DataFrame, base: str | None = None) -> DataFrame:
        return trailing_features(rows, self.entity, self.order, self.stats, self.windows, self.std_stats, self.date_col,
                                 self.season_col, self.rest, pace=False, trend=False, split=self.split,
                                 season_stats=self.season_stats, counters=True, base=base)


def _position(order: list[tuple[str, bool]]) -> Column:
    """A struct that compares as the order does (descending columns are numbers)."""
    return F.struct(*[(F.col(c) if asc else -F.col(c)).alias(f"k{i}") for i, (c, asc) in enumerate(order)])


class FeatureState:
    """The state table of a :class:`FeatureSpec`, in ``buckets`` partitions by hash of the entity."""

    def __init__(self, spark: SparkSession, path: str, spec: FeatureSpec, buckets: int = 64):
        self.spark, self.spec, self.buckets = spark, spec, buckets
        self.table = VersionedTable(spark, path, "bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.spec.entity), F.lit(self.buckets)).cast("int").alias("bucket")

    def rows(self, entities: DataFrame | None = None) -> DataFrame | None:
        """State rows (of some entities); None before the first commit."""
        if self.table.current() is None:
            return None
        rows = self.table.read()
        return rows if entities is None else _of_entities(rows, entities, self.spec.entity)

    def _marked(self, features: DataFrame) -> DataFrame:
        """Features with ``_last``: the last rows of every entity, and its newest with and without a season.
        On the plan of the features itself, whose rows are dealt by entity already."""
        e, back = self.spec.entity, order_by(self.spec.order, reverse=True)
        unknown = F.col(self.spec.season_col).isNull()
        return features.withColumns({
            "_n": F.row_number().over(Window.partitionBy(e).orderBy(*back)),
            "_s": F.row_number().over(Window.partitionBy(e, unknown).orderBy(*back)),
        }).withColumn("_last", (F.col("_n") <= self.spec.lookback + 1) | (F.col("_s") == 1)).drop("_n", "_s")

    def _kept(self, marked: DataFrame, counts: DataFrame) -> DataFrame:
        """The rows that state keeps, with their entity's row count."""
        e, last = self.spec.entity, marked.filter("_last")
        counts = counts.select(F.col(e).alias("_e"), "entity_rows")
        return last.join(counts, F.col(e).eqNullSafe(F.col("_e"))).select(
            *self.spec.columns, *self.spec.counters, "entity_rows", self._bucket())

    def _commit(self, kept: DataFrame, entities: DataFrame, tags: dict | None) -> None:
        """Replace the rows of these entities; other entities of the same buckets stay as they are."""
        touched = [r[0] for r in entities.select(self._bucket()).distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        old = self.rows()
        if old is not None:
            listed = entities.select(F.col(self.spec.entity).alias("_e"))
            rest = old.filter(F.col("bucket").isin(touched)).join(
                listed, F.col(self.spec.entity).eqNullSafe(F.col("_e")), "left_anti")
            kept = rest.unionByName(kept)
        self.table.commit(kept, touched, tags)

    def advance(self, new: DataFrame, tags: dict | None = None, before_commit=None) -> tuple[DataFrame, DataFrame]:
        """(features of the rows on time, late rows); the state moves on to the new rows.

        Both are written in the shared folder, since they rest on the state as it was.
        ``before_commit`` gets them to write elsewhere before the state is committed."""
        spec, e = self.spec, self.spec.entity
        entities = new.select(e).distinct()
        state = self.rows(entities)
        if state is None:
            on_time, late = new, new.limit(0)
            union = on_time.withColumns({"_old": F.lit(False), "_base": F.lit(None).cast(self._base_type(new))})
            counts = on_time.groupBy(e).agg(F.count(F.lit(1)).alias("entity_rows"))
        else:
            newest = latest_per_entity(state.select(*spec.columns), e, spec.order).select(
                F.col(e).alias("_e"), _position(spec.order).alias("_newest"))
            placed = new.join(newest, F.col(e).eqNullSafe(F.col("_e")), "left")
            fresh = F.coalesce(_position(spec.order) > F.col("_newest"), F.lit(True))
            on_time, late = (placed.filter(c).drop("_e", "_newest") for c in (fresh, ~fresh))
            # counters before an entity's first state row of a season hold for all rows of that season
            first = state.groupBy(e, spec.season_col).agg(
                F.min_by(F.struct(*spec.counters), _position(spec.order)).alias("_base"))
            first = first.select(F.col(e).alias("_e"), F.col(spec.season_col).alias("_s"), "_base")
            both = (state.select(*spec.columns).withColumn("_old", F.lit(True))
                    .unionByName(on_time.withColumn("_old", F.lit(False)), allowMissingColumns=True))
            union = both.join(first, F.col(e).eqNullSafe(F.col("_e")) & F.col(spec.season_col).eqNullSafe(F.col("_s")),
                              "left").drop("_e", "_s")
            before = state.groupBy(e).agg(F.max("entity_rows").alias("entity_rows"))
            added = on_time.groupBy(e).agg(F.count(F.lit(1)).alias("entity_rows"))
            counts = before.unionByName(added).groupBy(e).agg(F.sum("entity_rows").alias("entity_rows"))
        marked = union.withColumnRenamed("_old", "was_state").withColumnRenamed("_base", "season_base")
        features = self._written(self._marked(spec.features(marked, base="season_base").drop("season_base")))
        late = self._written(late)
        on_time = features.filter(~F.col("was_state")).drop("was_state", "_last")
        if before_commit is not None:
            before_commit(on_time, late)
        self._commit(self._kept(features, counts), entities, tags)
        return on_time, late

    def _base_type(self, new: DataFrame) -> str:
        fields = ["season_rows: bigint"]
        for s in sorted(set(self.spec.season_stats.values())):
            kind = "double" if new.schema[s].dataType.typeName() in ("double", "float") else "bigint"
            fields += [f"season_sum_{s}: {kind}", f"season_count_{s}: bigint"]
        return f"struct<{', '.join(fields)}>"

    def rebuild(self, history: DataFrame, entities: DataFrame | None = None, tags: dict | None = None) -> None:
        """State of some entities (None: all) from their whole history."""
        e = self.spec.entity
        rows = history if entities is None else _of_entities(history, entities, e)
        kept = self._kept(self._marked(self.spec.features(rows)), rows.groupBy(e).agg(F.count(F.lit(1)).alias("entity_rows")))
        if entities is None:
            self.table.commit(kept, None, tags)
        else:
            self._commit(kept, entities.distinct(), tags)

    def newest(self, entities: DataFrame | None = None) -> DataFrame | None:
        """The newest row of each entity with its features, from the state alone."""
        rows = self.rows(entities)
        if rows is None:
            return None
        base = rows.withColumn("season_base", F.struct(*self.spec.counters)).drop(*self.spec.counters)
        # the newest row's own counters are stored; only its windows are computed again
        spec = self.spec
        features = trailing_features(base, spec.entity, spec.order, spec.stats, spec.windows, spec.std_stats, spec.date_col,
                                     None, spec.rest, pace=False, trend=False, split=spec.split)
        return latest_per_entity(features, spec.entity, spec.order).select("*", "season_base.*").drop("season_base")

    def _written(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "state-step")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _of_entities(rows: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    listed = entities.select(F.col(entity).alias("_e")).distinct()
    return rows.join(listed, F.col(entity).eqNullSafe(F.col("_e")), "left_semi")
