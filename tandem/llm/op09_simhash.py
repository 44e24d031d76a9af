"""Document fingerprints by SimHash (operator 9).

Terms are pairs of adjacent lower-cased words (the single word of a one-word
text), weighted by 1 + log2 of their count, in whole sixteenths so that sums are
exact. Every term's 64-bit hash votes with its weight for (bit set) or against
(bit clear) each bit; the signs are the fingerprint. Likeness is 1 - Hamming
distance / 64.

``within_radius`` finds all pairs of different fingerprints within a Hamming
radius by permuted block tables: of ``blocks`` bit blocks at most ``radius``
differ, so some choice of ``blocks - radius`` blocks agrees whole; one table per
choice is keyed by those blocks. Fingerprints enter once, however many documents
share them.

``edited`` compares every document with an edited text: its last half replaced by
the start of the next document, in descending order of the id. Documents are
range-partitioned and sorted by id, so the next one is the next row of the same
task; the two rows at each partition border are staged and matched afterwards.

Defined cases: null and empty texts are empty (fingerprint 0, likeness 1 to each
other); null ids come last; equal ids are ordered by a hash of their text; a
table of one row is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm import textops as T
from tandem.llm.staging import join_summary, stage

BITS = 64
RADIUS, BLOCKS = 3, 5

#: row v: the bits of byte v, as +1 and -1 votes
_VOTES = np.where(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) > 0, 1.0, -1.0)


def _slice_prints(s: T.Slice) -> np.ndarray:
    begin, end, first = s.words()
    n = len(first) - 1
    words = T.byte_hashes(s.data, begin, end)
    own = T.owners(first)
    count = np.diff(first)
    pairs = np.flatnonzero(first[1:][own] - np.arange(len(words)) >= 2)
    single = first[:-1][count == 1]
    terms = np.r_[T.window_hashes(words, pairs, 2), words[single]]
    of = np.r_[own[pairs], own[single]]
    order = np.lexsort((terms, of))
    terms, of = terms[order], of[order]
    new = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (of[1:] != of[:-1])]) if len(terms) else of
    times = np.diff(np.r_[new, len(terms)])
    weight = np.rint(16 * (1 + np.log2(times))) if len(new) else times.astype(float)
    term_bytes = terms[new].view(np.uint8).reshape(-1, 8)
    bits = np.empty((n, 8, 8))
    for b in range(8):
        votes = np.bincount(of[new] * 256 + term_bytes[:, b], weight, minlength=n * 256).reshape(n, 256)
        bits[:, b] = votes @ _VOTES
    return np.packbits(bits.reshape(n, 64) > 0, axis=1).view(np.uint64).ravel()


def prints(texts: pa.Array) -> np.ndarray:
    """The 64-bit fingerprint of every text."""
    parts = [_slice_prints(s) for s in T.slices(texts, lower=True)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(a ^ b) / BITS


def _hex(values: np.ndarray) -> list[str]:
    return [f"{int(v):016x}" for v in values]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (a signed long) of every row."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints(batch.column("text")).view(np.int64))],
                                             names=["doc_id", "fp"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def within_radius(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (a < b) of different fingerprints (column ``fp``) within the radius, with their distance.

    More blocks make longer keys: choose them so that 64 * (blocks - radius) / blocks
    bits well exceed log2 of the number of different fingerprints.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("blocks must exceed the radius")
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                       for t, m in enumerate(masks)))
    rows = fps.select("fp").distinct().select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    a, b = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return (a.join(b, (a.t == b.t) & (a.key == b.key) & (F.col("a") < F.col("b")) & (distance <= radius))
            .select("a", "b", distance.alias("distance")).distinct())


_ROW = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, fp long")
_STAGED = _ROW + ", kind int, part int, text string"
_NAMES = [c.split()[0] for c in _STAGED.split(", ")]


def _compare(ids: pa.Array, texts: list[str], following: list[str], fp: np.ndarray, fp_next: np.ndarray) -> list:
    """Columns of _ROW for rows whose next text is known."""
    edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, following)]
    fp_edited = prints(pa.array(edited, pa.string()))
    return [ids, pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(_hex(fp), pa.string()), pa.array(_hex(fp_edited), pa.string()),
            pa.array(likeness(fp, fp_edited)), pa.array(likeness(fp, fp_next)), pa.array(fp.view(np.int64))]


def _staged(columns: list, kind: int, part: int, texts: list[str | None]) -> pa.RecordBatch:
    n = len(texts)
    return pa.RecordBatch.from_arrays(columns + [pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()),
                                                 pa.array(texts, pa.string())], names=_NAMES)


def _border(ids: pa.Array, text: str, kind: int, part: int) -> pa.RecordBatch:
    """The first (kind 2) or last (kind 1) row of a partition, with its text."""
    empty = [pa.nulls(1, t) for t in (pa.int64(), *(pa.string(),) * 3, *(pa.float64(),) * 2, pa.int64())]
    return _staged([ids, *empty], kind, part, [text])


def _sorted_batches(batches):
    part = TaskContext.get().partitionId()
    last = None  # (id column, text, fingerprint) that waits for its next row
    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            batch = whole.slice(lo, 1000)
            ids, column = batch.column("doc_id"), batch.column("text")
            texts = [t or "" for t in column.to_pylist()]
            fp = prints(column)
            if last is None:
                yield _border(ids.slice(0, 1), texts[0], 2, part)
                known, t, f = ids, texts, fp
            else:
                known = pa.concat_arrays([last[0], ids])
                t, f = [last[1], *texts], np.r_[last[2], fp]
            n = len(t) - 1
            if n:
                yield _staged(_compare(known.slice(0, n), t[:n], t[1:], f[:n], f[1:]), 0, part, [None] * n)
            last = (known.slice(n, 1), t[n], f[n:])
    if last is not None:
        yield _border(last[0], last[1], 1, part)


def _border_pairs(batches):
    for batch in batches:
        texts, following = ([t or "" for t in batch.column(c).to_pylist()] for c in ("text", "next_text"))
        fp, fp_next = (prints(pa.array(x, pa.string())) for x in (texts, following))
        yield pa.RecordBatch.from_arrays(_compare(batch.column("doc_id"), texts, following, fp, fp_next), names=_NAMES[:8])


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row, its edited text and the next document (see the module)."""
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc()]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    staged = stage(rows.mapInArrow(_sorted_batches, _STAGED))
    # two rows of each partition: every last row meets the first row of the next one with rows
    ends = staged.where("kind > 0")
    heads = ends.where("kind = 2").select("part", F.col("text").alias("next_text"))
    by_part = Window.orderBy("part")  # one row for each partition
    chain = heads.select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)).alias("following"))
    tails = ends.where("kind = 1").select("doc_id", "text", "part").join(chain, "part")
    met = tails.join(heads.withColumnRenamed("part", "following"), "following").select("doc_id", "text", "next_text")
    return staged.where("kind = 0").select(*_NAMES[:8]).unionByName(met.mapInArrow(_border_pairs, _ROW))


def with_near_counts(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Add n_near: other fingerprints of the table within the radius of the row's own."""
    pairs = within_radius(rows, radius)
    counts = (pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp")))
              .groupBy("fp").agg(F.count("*").alias("n_near")))
    return join_summary(rows, counts, ["fp"], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
