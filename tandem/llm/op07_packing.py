"""Best-fit packing with large-item matching (operator 7).

Documents become token ids followed by id 0 and are cut only where longer than
a sequence: into full pieces, the first taking the remainder. Packing depends on
lengths alone, and there are at most ``capacity`` of them, so the driver packs
the histogram of lengths (bounded by the capacity, whatever the corpus):

* pieces above a third of the capacity fit at most twice in a sequence: taken in
  descending order, each is matched with the open sequence that it fills best;
* smaller pieces, in descending order, best-fit the remaining gaps.

Runs of equal pieces are placed in runs of equal gaps, so the plan is a short
list of (length, rank range) -> (sequence range, place) steps. Every piece finds
its own place from its length and its rank among the pieces of that length;
ranks come from counts for each (partition, length). Texts are never shuffled.

Where the order of the rows matters (``ordered``), as after mixing, ranks follow it and
sequences are numbered by the first piece they hold, so reading them in turn meets the
documents' first pieces in that order. The plan, and so the number of sequences, is the same.

Defined cases: null and empty texts are one id (0) long; repeated rows and null
ids are packed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm.staging import in_order, numbered, stage

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
#: How a byte-level vocabulary splits text before its merges (fixed by the vocabulary).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with such runs are left to the ``tokenizers`` library, whose merges stay fast on them.
_LONG_RUN = re.compile(r"\S{4000}|\s{400}")


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself and the n-th other one as chr(256 + n)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class Encoder:
    """Exact ids of whole texts by a byte-level vocabulary file of ``tokenizers``.

    In such a file ids follow the order of the merges, so the ids are merge ranks:
    ``tiktoken`` encodes by them several times faster with equal results (tested
    against ``tokenizers``). Texts that hold a special token or a very long run are
    encoded by ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer
        self.plain = Tokenizer.from_file(path)
        byte_of = _byte_of_symbol()
        special = {t.content for t in self.plain.get_added_tokens_decoder().values()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.plain.get_vocab(False).items()
                 if token not in special}
        self.special = tuple(special)
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(t in text for t in self.special) or _LONG_RUN.search(text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def piece_batches(path: str | None, capacity: int, carried: tuple[str, ...] = ()):
    def run(batches):
        enc = encoder(tokenizer_path(path))
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                cols = [[] for _ in range(5)]
                for i, text in enumerate(rows.column("text").to_pylist()):
                    ids = enc(text or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    cut = n if n <= capacity else n % capacity or capacity
                    start, piece = 0, 0
                    while start < n:
                        for col, v in zip(cols, (i, piece, start, cut - start, zlib.crc32(ids[4 * start:4 * cut]))):
                            col.append(v)
                        start, cut, piece = cut, cut + capacity, piece + 1
                length = np.array(cols[3], np.int64)
                order = np.argsort(length, kind="stable")
                run_len = length[order]
                first = np.searchsorted(run_len, run_len)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - first + seen[run_len]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()),
                     pa.array(cols[2], pa.int64()), pa.array(length), pa.array(cols[4], pa.int64()),
                     pa.array(np.full(len(length), part, np.int32)), pa.array(rank)]
                    + [rows.column(c).take(pa.array(cols[0], pa.int64())) for c in carried],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *carried])
    return run


class Packer:
    """Best fit of runs of equal pieces into runs of equal gaps.

    ``steps`` rows: length, rank of the first piece, pieces, first sequence,
    pieces in each sequence, offset of the first piece there.
    """

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.gaps: list[int] = []                      # sizes of the open gaps, ascending
        self.open: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, sequences)
        self.steps: list[tuple[int, int, int, int, int, int]] = []
        self.ranks: dict[int, int] = {}

    def _add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.open:
                insort(self.gaps, gap)
                self.open[gap] = []
            self.open[gap].append((first, count))

    def _fill(self, size: int, n: int, gap: int, first: int, count: int) -> int:
        """Place up to n pieces in ``count`` sequences with this gap; return how many."""
        each = gap // size
        placed = min(n, each * count)
        full, rest = divmod(placed, each)
        rank = self.ranks.get(size, 0)
        used = self.capacity - gap
        if full:
            self.steps.append((size, rank, full * each, first, each, used))
            self._add(gap - each * size, first, full)
        if rest:
            self.steps.append((size, rank + full * each, rest, first + full, rest, used))
            self._add(gap - rest * size, first + full, 1)
        self._add(gap, first + full + (rest > 0), count - full - (rest > 0))
        self.ranks[size] = rank + placed
        return placed

    def place(self, size: int, n: int) -> None:
        while n:
            i = bisect_left(self.gaps, size)
            if i == len(self.gaps):  # no gap is wide enough
                each = self.capacity // size
                need = -(-n // each)
                first, self.sequences = self.sequences, self.sequences + need
                n -= self._fill(size, n, self.capacity, first, need)
                continue
            gap = self.gaps.pop(i)
            runs = self.open.pop(gap)
            while runs and n:
                n -= self._fill(size, n, gap, *runs.pop())
            for run in runs:
                self._add(gap, *run)


def pack_histogram(counts: dict[int, int], capacity: int) -> Packer:
    packer = Packer(capacity)
    sizes = sorted(counts, reverse=True)
    for size in (s for s in sizes if 3 * s > capacity):   # matching: two in a sequence at most
        packer.place(size, counts[size])
    for size in (s for s in sizes if 3 * s <= capacity):  # best fit of the rest
        packer.place(size, counts[size])
    return packer


_RANK_BITS = 44


def place_batches(steps, carried: tuple[str, ...] = ()):
    def run(batches):
        plan = steps.value
        key, first_rank, first_seq, each, offset = plan
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (length << _RANK_BITS) + rank, side="right") - 1
            j = rank - first_rank[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(first_seq[at] + j // each[at]), pa.array(offset[at] + (j % each[at]) * length)]
                + [batch.column(c) for c in carried],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *carried])
    return run


def _plan(spark: SparkSession, total: dict[int, int], capacity: int):
    """The steps of the packing, broadcast."""
    packer = pack_histogram(total, capacity)
    plan = np.array(sorted(packer.steps) or [(0, 0, 1, 0, 1, 0)], dtype=np.int64)
    return spark.sparkContext.broadcast(
        ((plan[:, 0] << _RANK_BITS) + plan[:, 1], plan[:, 1], plan[:, 3], plan[:, 4], plan[:, 5]))


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ordered: bool = False) -> DataFrame:
    """One row per piece with its sequence and place (see the module); ``ordered`` takes a table as it is read."""
    spark = docs.sparkSession
    if ordered:
        return _pack_in_order(docs, capacity, tokenizer)
    pieces = stage(docs.select("doc_id", "text").mapInArrow(piece_batches(tokenizer, capacity), PIECES))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = _plan(spark, total, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = (pieces.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
              .select("doc_id", "piece", "start", "length", "ids_crc32", "rank"))
    return ranked.mapInArrow(place_batches(steps), _PLACED)


def _pack_in_order(docs: DataFrame, capacity: int, tokenizer: str | None) -> DataFrame:
    """Pieces of a length take their places in the order of the rows; sequences are numbered by their first piece."""
    spark = docs.sparkSession
    rows, at = in_order(docs, ["doc_id", "text"])
    pieces = stage(rows.mapInArrow(piece_batches(tokenizer, capacity, at), PIECES + "".join(f", {c} long" for c in at)))
    order = [F.col(c).asc() for c in (*at, "piece")]
    total = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = numbered(pieces.drop("rank"), "length", order, "rank")
    placed = stage(ranked.mapInArrow(place_batches(_plan(spark, total, capacity), at),
                                     _PLACED + "".join(f", {c} long" for c in at)))
    first = placed.groupBy("sequence_id").agg(F.min(F.struct(*at, "piece")).alias("first"))
    first = first.select("sequence_id", "first.*", F.lit(0).alias("all"))
    turn = numbered(first, "all", order, "turn").select("sequence_id", "turn")
    return placed.join(turn, "sequence_id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("turn").alias("sequence_id"), "offset")
