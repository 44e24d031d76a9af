"""Sharding by histogram sort (operator 3, DataFrame functions only).

Rows are ordered by a key of three 64-bit parts: hash of the text (equal texts
lie together), hash of the id, and a unique row number, so no group of copies is
too large to be cut. Splitters are found by counting exactly: probes divide the
open interval of each splitter, one aggregate counts the bytes below every probe
over all partitions, and the interval that holds the target is probed again
until a probe meets the tolerance; an interval of a single key part goes on with
the next part. Then rows go to their shards in one range exchange.

The driver sees (shards - 1) x probes counts in a round, never rows. Law:
``bytes`` - every splitter lies within ``tolerance`` of its exact share, or where
one row is larger than that, at the nearest row.

Defined cases: a null text has size 1 and crc32 of nothing; null ids and repeated
rows are rows like any other; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.staging import numbered, stage

SHARDS = 8
TOLERANCE = 0.001
PROBES = 256

KEY = ("k1", "k2", "k3")
#: Ranges of the key parts: hashes are signed 64-bit, row numbers are not negative.
_LOW, _HIGH = (-(1 << 63), -(1 << 63), 0), ((1 << 63) - 1, (1 << 63) - 1, (1 << 63) - 1)


class _Open:
    """The interval in which one splitter is sought: fixed leading key parts and a
    range [lo, hi] of the next part; ``below`` bytes lie before the range."""

    def __init__(self, target: float):
        self.target, self.prefix, self.lo, self.hi, self.below = target, (), _LOW[0], _HIGH[0], 0
        self.cut: tuple[int, ...] | None = None  # the splitter: the least key that goes to the next shard

    def narrow(self, counts: list[int], edges: list[int], tolerance: float) -> None:
        """counts[i]: bytes in [edges[i], edges[i + 1])."""
        total = self.below
        for i, n in enumerate(counts):
            if abs(total - self.target) <= tolerance:
                self.cut = (*self.prefix, edges[i])
                return
            if total + n > self.target:
                last = edges[i + 1] - edges[i] == 1 and len(self.prefix) + 1 == len(KEY)
                if last:  # one row: cut at its nearer side
                    before = self.target - total <= total + n - self.target
                    self.cut = (*self.prefix, edges[i] if before else edges[i + 1])
                elif edges[i + 1] - edges[i] == 1:
                    self.prefix += (edges[i],)
                    part = len(self.prefix)
                    self.lo, self.hi, self.below = _LOW[part], _HIGH[part], total
                else:
                    self.lo, self.hi, self.below = edges[i], edges[i + 1] - 1, total
                return
            total += n
        self.cut = (*self.prefix, edges[-1])

    def inside(self) -> Column:
        part = KEY[len(self.prefix)]
        cond = F.col(part).between(F.lit(self.lo), F.lit(self.hi))
        for name, value in zip(KEY, self.prefix):
            cond &= F.col(name) == F.lit(value)
        return cond


def _step(lo: int, hi: int, n: int) -> int:
    return -(-(hi - lo + 1) // n)


def _cell(col: str, lo: int, step: int) -> Column:
    """Probe interval of a key part; decimals, since the range of a hash exceeds a long."""
    wide = "decimal(20,0)"
    return F.floor((F.col(col).cast(wide) - F.lit(str(lo)).cast(wide)) / F.lit(str(step)).cast(wide)).cast("int")


def find_splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES,
                   weight: str = "size") -> list[tuple[int, ...]]:
    """The least key of shards 1, 2, ... by rounds of exact counts (rows: key parts and weight)."""
    total = rows.agg(F.sum(weight)).first()[0] or 0
    slack = total / shards * tolerance
    wanted = [_Open(total * i / shards) for i in range(1, shards)]
    while total and (todo := [w for w in wanted if w.cut is None]):
        # splitters still in one interval share its counts
        spans = {(w.prefix, w.lo, w.hi): w for w in todo}
        which = F.lit(None).cast("int")
        cell = F.lit(None).cast("int")
        edges = {}
        for i, (span, w) in enumerate(spans.items()):
            step = _step(w.lo, w.hi, probes)
            n = -(-(w.hi - w.lo + 1) // step)
            edges[span] = (i, [min(w.lo + step * j, w.hi + 1) for j in range(n + 1)])
            part = KEY[len(w.prefix)]
            which = F.when(w.inside(), i).otherwise(which)
            cell = F.when(w.inside(), _cell(part, w.lo, step)).otherwise(cell)
        counted = (rows.select(which.alias("span"), cell.alias("cell"), weight).where("span is not null")
                   .groupBy("span", "cell").agg(F.sum(weight).alias("n")).collect())
        found = {(r["span"], r["cell"]): r["n"] for r in counted}
        for w in todo:
            i, bounds = edges[(w.prefix, w.lo, w.hi)]
            w.narrow([found.get((i, j), 0) for j in range(len(bounds) - 1)], bounds, slack)
    return [w.cut for w in wanted if w.cut is not None]


def _at_or_after(cut: tuple[int, ...]) -> Column:
    """Key >= cut, part by part."""
    cond = F.col(KEY[len(cut) - 1]) >= F.lit(cut[-1])
    for name, value in reversed(list(zip(KEY, cut[:-1]))):
        cond = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & cond)
    return cond


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, plus the law."""
    rows = stage(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("k1"), F.xxhash64("doc_id").alias("k2"),
        F.monotonically_increasing_id().alias("k3")))
    cuts = find_splitters(rows, shards, tolerance)
    number = sum((F.when(_at_or_after(c), 1).otherwise(0) for c in cuts), F.lit(0))
    placed = numbered(rows.withColumn("shard", number.cast("int")), "shard",
                      [F.col(k).asc() for k in KEY], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
