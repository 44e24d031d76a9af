"""Mixing sources to target weights by Pfair scheduling (operator 6).

The rows of every source are cut into blocks of ``block`` rows in a pseudo-random
order; the last block of a source may be short. The mix is a sequence of slots, one
block each. In the ideal mix all sources flow at once, each at its weight over the
weights of those that have blocks left: a source that runs dry goes out and the
others share its part. Block k of a source is released at the slot in which its
ideal share reaches k blocks and due by the slot in which it reaches k + 1; earliest
deadline first serves the released blocks. The ideal shares sum to one block a slot,
so every block meets its deadline: after any number of slots each source has had its
ideal share within less than one block, and every row of a source with a weight gets
a slot.

The driver walks the slots once, in memory bounded by the number of sources, and
notes the state at every border of a stretch of slots; executors walk the stretches
again and write the slot of each block. Blocks are as long as it takes for the number of
slots to stay bounded; the guarantee is in blocks. Rows find their block from a gapless number
within their source (range-partitioned, so a hot source spans many partitions).

Without given weights a source's target is its row count to the power ``temper``, and
the mix holds all rows. Given weights are kept to the end of the mix: it ends at the
first slot whose source has no full block left, or where the ideal share of a source
runs dry; later rows have their slot, ``in_mix = false`` and a null position.
``whole`` chooses one or the other.

Defined cases: a null source counts as the source ''; a source without a given
weight, or with weight 0, stays out of the mix and does not end it; a source with a
weight and no rows is dry from the start; repeated rows are rows like any other; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.staging import fresh_name, numbered

BLOCK = 8
TEMPER = 0.9

#: Slots of a stretch that one executor task walks, at least.
STRETCH = 1 << 16

#: Blocks of a source in one row of the joined schedule.
RUN = 1 << 10

#: Blocks up to which the schedule is broadcast (16 bytes each); else the join is shuffled.
BROADCAST_BLOCKS = 2_000_000

#: Full blocks of a mix, at most, unless the block is given: the driver walks every slot once (about 12 us each).
MOST_BLOCKS = 1 << 22

_SCHEDULE = "mix_source string, _run long, _block long, _slot long, _start long"


class Ideal:
    """The mix in which all sources flow at once until they run dry, in exact numbers."""

    def __init__(self, weights: dict[str, float], rows: dict[str, int], block: int = 1):
        self.names = sorted(s for s, w in weights.items() if w > 0 and rows.get(s))
        exact = [Fraction(weights[s]) for s in self.names]
        scale = lcm(*(x.denominator for x in exact))
        self.block, self.rows = block, [rows[s] for s in self.names]
        self.weights = [int(x * scale) for x in exact]
        self.blocks = [-(-n // block) for n in self.rows]
        # sources in the order in which they run dry; before the j-th does, those before it
        # have had all their blocks (spent) and the others flow
        order = sorted(zip(self.blocks, self.weights), key=lambda e: Fraction(*e))
        self.dry, self.spent, self.flow = order, [0], [sum(self.weights)]
        for n, w in order:
            self.spent.append(self.spent[-1] + n)
            self.flow.append(self.flow[-1] - w)

    def reached(self, i: int, k: int) -> tuple[int, int]:
        """Floor and ceiling of the slot in which source i has had k blocks."""
        w = self.weights[i]
        j = bisect_left(self.dry, True, key=lambda e: k * e[1] <= e[0] * w)
        whole, part = divmod(self.spent[j] * w + k * self.flow[j], w)
        return whole, whole + (part > 0)

    def size(self, i: int, k: int) -> int:
        return min(self.block, self.rows[i] - k * self.block)

    def first_dry(self) -> int:
        """Whole slots before the first source runs dry."""
        n, w = self.dry[0]
        return n * self.flow[0] // w

    def walk(self, had: list[int], slot: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """(slot, source, block) of every slot: earliest deadline first among released blocks.

        ``had`` holds the blocks each source has had before the slot, and is kept so.
        """
        waiting: list[tuple[int, int]] = []  # (release of the next block, source)
        ready: list[tuple[int, int]] = []    # (deadline, source)
        for i, k in enumerate(had):
            if k < self.blocks[i]:
                waiting.append((self.reached(i, k)[0], i))
        heapq.heapify(waiting)
        for slot in range(slot, stop):
            while waiting and waiting[0][0] <= slot:
                _, i = heapq.heappop(waiting)
                heapq.heappush(ready, (self.reached(i, had[i] + 1)[1], i))
            deadline, i = heapq.heappop(ready)
            if slot >= deadline:
                raise AssertionError("a block missed its deadline")
            yield slot, i, had[i]
            had[i] += 1
            if had[i] < self.blocks[i]:
                heapq.heappush(waiting, (self.reached(i, had[i])[0], i))


def stretches(ideal: Ideal) -> tuple[list[tuple[int, int, int, list[int]]], int]:
    """(first slot, stop, rows before, blocks had) of every stretch; slots before the first short block or dry source."""
    total, length = sum(ideal.blocks), max(STRETCH, 64 * len(ideal.names))
    out, rows, had = [], 0, [0] * len(ideal.names)
    end = ideal.first_dry() if total else 0
    for slot, i, k in ideal.walk(had, 0, total):
        if slot % length == 0:
            out.append((slot, min(slot + length, total), rows, list(had)))
        size = ideal.size(i, k)
        rows += size
        if size < ideal.block:
            end = min(end, slot)
    return out, end


def _slots_of(ideal: Ideal) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        i, k, slot, start = zip(*rows)
        return pa.RecordBatch.from_pydict({
            "mix_source": pa.array([ideal.names[x] for x in i], pa.string()),
            "_run": pa.array([x // RUN for x in k], pa.int64()), "_block": pa.array(k, pa.int64()),
            "_slot": pa.array(slot, pa.int64()), "_start": pa.array(start, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                out, start = [], r["rows"]
                for slot, i, k in ideal.walk(r["had"], r["slot"], r["stop"]):
                    out.append((i, k, slot, start))
                    start += ideal.size(i, k)
                    if len(out) == STRETCH:
                        yield batch(out)
                        out = []
                if out:
                    yield batch(out)
    return run


def block_rows(rows: int, least: int = BLOCK, blocks: int = MOST_BLOCKS) -> int:
    """Rows of a block: ``least``, doubled until no more than ``blocks`` blocks are full."""
    size = least
    while rows // size > blocks:
        size *= 2
    return size


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int | None = None,
        temper: float = TEMPER, whole: bool | None = None, keep: list[str] | None = None) -> DataFrame:
    """Every row with mix_source, mix_block, mix_slot, mix_position and in_mix.

    Columns of the input that bear one of these names are replaced; ``keep`` names the columns of the
    input to carry (default: all). ``block`` is :func:`block_rows` of the table unless given.
    """
    own = ["mix_source", "mix_block", "mix_slot", "mix_position", "in_mix"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own]
    # texts that are not kept go before any row moves
    order = fresh_name("_order", docs)
    docs = docs.select(*kept, F.coalesce("source", F.lit("")).alias("mix_source"), F.xxhash64("doc_id", "text").alias(order))
    counts = {r["mix_source"]: r["n"] for r in docs.groupBy("mix_source").agg(F.count("*").alias("n")).collect()}
    block = block or block_rows(sum(counts.values()))
    targets = weights if weights is not None else {s: n ** temper for s, n in counts.items()}
    ideal = Ideal(targets, counts, block)
    parts, end = stretches(ideal)
    total = sum(ideal.blocks)
    if whole or (whole is None and weights is None):
        end = total
    elif len(ideal.names) < sum(w > 0 for w in targets.values()):
        end = 0
    number, run, slots, starts = (fresh_name(n, docs) for n in ("_number", "_run", "_slots", "_starts"))
    plan = docs.sparkSession.createDataFrame(parts, "slot long, stop long, rows long, had array<long>")
    plan = (plan.mapInArrow(_slots_of(ideal), _SCHEDULE).groupBy("mix_source", "_run")
            .agg(F.sort_array(F.collect_list(F.struct("_block", "_slot", "_start"))).alias("_at"))
            .select("mix_source", F.col("_run").alias(run), F.col("_at._slot").alias(slots), F.col("_at._start").alias(starts)))
    rows = numbered(docs, "mix_source", [F.col(order).asc()], number)
    rows = rows.withColumn("mix_block", F.floor(F.col(number) / block)).withColumn(run, F.floor(F.col("mix_block") / RUN))
    rows = rows.join(F.broadcast(plan) if total <= BROADCAST_BLOCKS else plan, ["mix_source", run], "left")
    place = (F.col("mix_block") % RUN + 1).cast("int")
    rows = rows.withColumn("mix_slot", F.element_at(slots, place))
    rows = rows.withColumn("in_mix", F.coalesce(F.col("mix_slot") < end, F.lit(False)))
    rows = rows.withColumn("mix_position", F.when(F.col("in_mix"), F.element_at(starts, place) + F.col(number) % block))
    return rows.select(*kept, *own)


def keep_mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int | None = None) -> DataFrame:
    """All rows of the sources that have a weight, in the order of the whole mix, with the columns of the input,
    those that are named like a column of the mix as well."""
    own = {"mix_source", "mix_block", "mix_slot", "mix_position", "in_mix"}
    held = {c: fresh_name(f"own_{c}", docs) for c in docs.columns if c in own}
    rows = mix(docs.withColumnsRenamed(held), weights, block, whole=True).where("in_mix")
    placed = rows.repartitionByRange("mix_position").sortWithinPartitions("mix_position")
    return placed.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])
