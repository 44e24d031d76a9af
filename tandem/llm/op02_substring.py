"""Substring dedup by level-wise doubling (operator 2).

A window of ``window`` words that also starts in a document with a smaller
``doc_id`` is a repeat; every word covered by a repeat is removed. Windows are
judged on the input.

Levels. The shortest level holds windows of about a quarter of the length,
chosen by content: in each full window the least hash among its short windows
is selected, so two equal full windows select the same short one and no repeat
is lost while one position in twenty is shuffled. Short windows found in two
different texts are extended to twice their length (to the left and to the right,
inside the full window); those found in two documents are extended again, to the
full length, where the least document of each window is exact. Without survivors
the next level is empty.

A text that an earlier document holds word for word needs no search: each of its
windows is a repeat. Only the first of equal texts enters the levels above the
first, so a large group of copies costs no more than one text.

Every level is aggregate (map-side combine) then join, so a passage that a third
of all documents share meets no single task; AQE splits skewed join partitions.
Texts are shuffled once, by a row key (hash of doc_id and text), and that
exchange is reused by the later levels.

Defined cases: a null text has no words; a null doc_id neither removes nor is
removed; repeated rows (same id and text) are judged alike; an id with two
texts never removes from itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import textops as T
from tandem.llm.staging import join_summary, stage

WINDOW = 50


def _levels(window: int) -> tuple[int, int]:
    return max(1, window // 4), max(1, window // 2)


def _selected(words: np.ndarray, first: np.ndarray, window: int):
    """(full window starts, position of the short window that each one selects)."""
    short, _ = _levels(window)
    n = np.diff(first)
    own = T.owners(first)
    left = first[1:][own] - np.arange(len(words))  # words from here to the end of the text
    starts = np.flatnonzero(left >= window)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    at = np.flatnonzero(np.arange(len(words)) + short <= len(words))
    hashes = T.window_hashes(words, at, short)
    bits = np.uint64(max(24, len(words).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    keys = (hashes & ~low) | at.astype(np.uint64)  # ties: the leftmost
    least = T.sliding_min(keys, window - short + 1)[starts]
    return starts, (least & low).astype(np.int64), hashes


def _by_text_and_hash(own: np.ndarray, h: np.ndarray, at: np.ndarray):
    """Sort by (text, hash, position); first index of every (text, hash) run, and the sorted arrays."""
    order = np.lexsort((at, h, own))
    own, h, at = own[order], h[order], at[order]
    return np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]), own, h, at


def anchor_batches(window: int):
    """Level 1: the short windows that some full window selects."""
    short, _ = _levels(window)
    schema = pa.schema([("rk", pa.int64()), ("th", pa.int64()), ("h", pa.int64()), ("at", pa.binary())])

    def run(batches):
        for batch in batches:
            for s in T.slices(batch.column("text")):
                begin, end, first = s.words()
                _, chosen, hashes = _selected(T.byte_hashes(s.data, begin, end), first, window)
                at = np.unique(chosen)
                if len(at):
                    own = np.searchsorted(first, at, side="right") - 1
                    cuts, own, h, at = _by_text_and_hash(own, hashes[at].view(np.int64), at)
                    take = pa.array(own[cuts] + s.lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("rk").take(take), batch.column("th").take(take), pa.array(h[cuts]),
                         T.binaries((at - first[own]).astype(np.int32), np.r_[cuts, len(at)])], schema=schema)
    return run


ANCHORS = "rk long, th long, h long, at binary"


def _found(batch, s: T.Slice, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index of the text's start, packed value) of the survivors of a slice."""
    found = batch.column("found")
    lists, values = found.offsets.to_numpy(), found.values
    packed = [values[i].as_py() for i in range(lists[s.lo], lists[s.hi])]
    row = np.repeat(np.repeat(np.arange(s.lo, s.hi), np.diff(lists[s.lo:s.hi + 1])),
                    np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed)))
    return first[row - s.lo], np.frombuffer(b"".join(packed), dtype=np.int32).astype(np.int64)


def extension_batches(window: int):
    """Level 2: surviving short windows extended to twice their length, to the
    left (code 1) and to the right (code 2)."""
    short, middle = _levels(window)
    schema = pa.schema([("rk", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("at", pa.binary())])

    def run(batches):
        for batch in batches:
            for s in T.slices(batch.column("text")):
                begin, end, first = s.words()
                words = T.byte_hashes(s.data, begin, end)
                base, pos = _found(batch, s, first)
                for code, start in ((1, base + pos - (middle - short)), (2, base + pos)):
                    own = np.searchsorted(first, base + pos, side="right") - 1
                    fits = (start >= base) & (start + middle <= first[own + 1])
                    if not fits.any():
                        continue
                    h = T.window_hashes(words, start[fits], middle).view(np.int64)
                    cuts, of, h, at = _by_text_and_hash(own[fits], h, pos[fits] * 4 + code)
                    take = pa.array(of[cuts] + s.lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("rk").take(take), batch.column("doc_id").take(take), pa.array(h[cuts]),
                         T.binaries(at.astype(np.int32), np.r_[cuts, len(at)])], schema=schema)
    return run




def window_batches(window: int):
    """Full windows whose chain of shorter windows survived, one row per text and hash."""
    short, middle = _levels(window)
    schema = pa.schema([("rk", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("at", pa.binary())])

    def run(batches):
        for batch in batches:
            for s in T.slices(batch.column("text")):
                begin, end, first = s.words()
                words = T.byte_hashes(s.data, begin, end)
                starts, chosen, _ = _selected(words, first, window)
                if not len(starts):
                    continue
                base, code = _found(batch, s, first)
                side = np.zeros(len(words) + 1, np.int8)  # two bits for the sides that survive
                np.bitwise_or.at(side, base + code // 4, (code % 4).astype(np.int8))
                offset = chosen - starts
                keep = np.where(offset >= middle - short, side[chosen] & 1, side[chosen] & 2) > 0
                starts = starts[keep]
                if not len(starts):
                    continue
                h = T.window_hashes(words, starts, window).view(np.int64)
                own = np.searchsorted(first, starts, side="right") - 1
                cuts, own, h, starts = _by_text_and_hash(own, h, starts)
                take = pa.array(own[cuts] + s.lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rk").take(take), batch.column("doc_id").take(take), pa.array(h[cuts]),
                     T.binaries((starts - first[own]).astype(np.int32), np.r_[cuts, len(starts)])], schema=schema)
    return run


WINDOWS = "rk long, doc long, h long, at binary"


def removal_batches(window: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            texts, at, marked = (batch.column(c) for c in ("text", "at", "marked"))
            total, removed, digest, kept_text = [], [], [], []
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                starts = at[i].as_py()
                gone = 0
                if starts:
                    p = np.frombuffer(b"".join(starts), dtype=np.int32)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + window, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    gone = int(covered.sum())
                    kept = [w for w, c in zip(words, covered.tolist()) if not c]
                elif marked[i].as_py() and len(words) >= window:  # an earlier document has the same text
                    gone, kept = len(words), []
                else:
                    kept = words
                total.append(len(words))
                removed.append(gone)
                joined = b" ".join(kept)
                digest.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(kept_text, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


def _of_two(rows: DataFrame, by: str) -> DataFrame:
    """Hashes found under two different values of ``by``, with the least of them."""
    return rows.groupBy("h").agg(F.min(by).alias("lo"), F.max(by).alias("hi")).where("lo < hi").select("h", "lo")


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (``keep_text``) the kept text of every row."""
    if window < 4:
        raise ValueError("windows have four words at least")
    # rk: NULL ids and NULL texts hash like any other value, so the key is never NULL
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk"))
    # texts with an equal text under a smaller id: all their windows are repeats
    text_key = ["th", "crc", "size"]
    named = docs.where("doc_id is not null").select(
        "doc_id", F.xxhash64("doc_id", "text").alias("rk"), F.xxhash64("text").alias("th"),
        F.crc32(F.col("text").cast("binary")).alias("crc"), F.octet_length("text").alias("size")).dropna()
    copies = stage(join_summary(named, named.groupBy(text_key).agg(F.min("doc_id").alias("least")), text_key)
                   .where("doc_id > least").select("rk").distinct())
    # level 1: short windows found in two different texts
    anchors = (docs.where("doc_id is not null").select("text", F.xxhash64("doc_id", "text").alias("rk"),
                                                       F.xxhash64("text").alias("th"))
               .mapInArrow(anchor_batches(window), ANCHORS))
    short = (join_summary(anchors.select("rk", "h", "at"), _of_two(anchors, "th"), ["h"], "left_semi")
             .groupBy("rk").agg(F.collect_set("at").alias("found")))
    short = stage(short.join(copies, "rk", "left_anti"))
    # level 2: twice the length, found in two documents
    longer = rows.join(short, "rk").select("rk", "doc_id", "text", "found").mapInArrow(
        extension_batches(window), WINDOWS)
    longer = (join_summary(longer.select("rk", "h", "at"), _of_two(longer, "doc"), ["h"], "left_semi")
              .groupBy("rk").agg(F.collect_set("at").alias("found")))
    # level 3: full windows over the survivors; the least document of each is exact
    windows = rows.join(longer, "rk").select("rk", "doc_id", "text", "found").mapInArrow(
        window_batches(window), WINDOWS)
    covers = (join_summary(windows, _of_two(windows, "doc"), ["h"]).where("doc > lo").groupBy("rk")
              .agg(F.collect_set("at").alias("at")))
    marks = covers.unionByName(copies.withColumn("at", F.lit(None).cast("array<binary>"))
                               ).withColumn("marked", F.lit(True))
    out = rows.join(marks, "rk", "left").select("doc_id", "text", "at", "marked").mapInArrow(
        removal_batches(window, keep_text),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if keep_text else out.drop("kept_text")
