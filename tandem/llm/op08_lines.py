"""Fuzzy line dedup by MinHash (operator 8).

A line is a \\n-separated part of a text that holds a word; it is compared without
the separators around it and with A-Z lower-cased, as the set of its ``gram``-
character shingles (a shorter line is one token, itself). Lines with Jaccard
similarity >= num / den are linked, and of each component of linked lines over the
whole table only the first (by doc_id, then line number) stays; lines without a
word always stay.

Equal lines are one class. A class gets a one-permutation MinHash signature of
``bands`` x ``rows`` minima (empty bins borrow from the next one); classes that
agree on a whole band are candidates. With 8 bands of 4 rows a pair at 0.8 is found
with probability 0.985, at 0.9 with 0.9999. Candidates are verified exactly on their
shingles through ``grouplinks`` (large bands by pivots, none expanded into all
pairs), components found by distributed union-find.

Texts are shuffled once, to rewrite them; candidate lines are fetched by a bounded
broadcast, else by a join.

Defined cases: null texts stay null and have no lines; null ids come after all ids
(then by row key); repeated rows (same id and text) keep the same lines, in each of
them; ``dedup_lines`` leaves out rows that lose their last word (texts without a word from the
start stay) and returns extra columns unchanged, whatever their names; an empty table gives an
empty result. A text may be as long as Arrow allows (2 GB); memory is a few dozen times the
longest one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tandem.llm import textops as T
from tandem.llm.components import components
from tandem.llm.grouplinks import HEAVY, bounded_join, links
from tandem.llm.staging import fresh_name, join_summary, stage

GRAM, NUM, DEN = 8, 8, 10
BANDS, ROWS = 8, 4
#: Classes a task remembers so as not to repeat their bands; a memory bound only.
SEEN = 500_000

_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True
_EMPTY = np.uint32(0xFFFFFFFF)


def _lines(s: T.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, text, line number) of every line with a word, bare of outer separators."""
    begin, end, first = s.words()
    newlines = np.r_[0, np.cumsum(_NEWLINE[s.data])]
    line = newlines[begin]                      # newlines before the word in the slice
    own = T.owners(first)
    lead = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (own[1:] != own[:-1])]) if len(begin) else own
    last = np.r_[lead[1:], len(begin)] - 1 if len(begin) else lead  # a run of texts may have no word at all
    text = own[lead]
    return begin[lead], end[last], text, line[lead] - newlines[s.offsets[text]]


def _class_keys(s: T.Slice, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return T.mix(T.byte_hashes(s.data, begin, end) ^ T.mix((end - begin).astype(np.uint64)))


def _shingles(data: np.ndarray, begin: np.ndarray, end: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, line) of all character shingles, in line order; a short line is one token."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    lo, hi = np.searchsorted(heads, begin), np.searchsorted(heads, end)
    n = np.maximum(hi - lo - gram + 1, 0)
    own = np.repeat(np.arange(len(begin)), n)
    at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    ends = np.r_[heads, len(data)]
    short = np.flatnonzero(n == 0)
    starts, stops = np.r_[heads[at], begin[short]], np.r_[ends[at + gram], end[short]]
    return T.byte_hashes(data, starts, stops), np.r_[own, short]


def char_sets(gram: int):
    def tokens(texts: list[str]) -> list[np.ndarray]:
        out = []
        for s in T.slices(pa.array(texts, pa.string())):
            begin, end = s.offsets[:-1], s.offsets[1:]
            tok, own = _shingles(s.data, begin, end, gram)
            n = np.bincount(own, minlength=len(begin))
            if len(tok) and (own[1:] < own[:-1]).any():  # short lines come last
                tok = tok[np.argsort(own, kind="stable")]
            tok, first = T.distinct_sets(tok, np.r_[0, np.cumsum(n)])
            out += np.split(tok, first[1:-1])
        return out
    return tokens


def _folded_shingles(data: np.ndarray, begin: np.ndarray, end: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of the shingles of up to 8 characters, each character folded to one
    byte, so that a shingle is one 64-bit word. Equal shingles stay equal, which is all
    that finding candidates needs; lines are as long as ``gram`` at least."""
    k = min(gram, 8)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
    before = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # characters before every byte
    lo, n = before[begin], before[end] - before[begin] - k + 1
    folded = np.zeros(len(points) + 8, np.uint8)
    folded[:-8] = points ^ (points >> 8) ^ (points >> 16)
    words = np.ndarray((len(points) + 1,), dtype="<u8", buffer=folded.tobytes(), strides=(1,))
    own = np.repeat(np.arange(len(begin)), n)
    tok = words[np.arange(len(own)) + np.repeat(lo - np.cumsum(n) + n, n)]
    return T.mix(tok & np.uint64((1 << 8 * k) - 1) if k < 8 else tok), own


def band_keys(data: np.ndarray, begin: np.ndarray, end: np.ndarray, gram: int, bands: int, rows: int) -> np.ndarray:
    """A key for each line (of ``gram`` characters at least) and band, by one-permutation MinHash."""
    bins = bands * rows
    tok, own = _folded_shingles(data, begin, end, gram)
    least = np.full(len(begin) * bins, _EMPTY, np.uint32)  # four of them make a band: 32 bits are enough
    bin_of = tok & np.uint64(bins - 1) if bins & (bins - 1) == 0 else tok % np.uint64(bins)
    np.minimum.at(least, own * bins + bin_of.view(np.int64), (tok >> np.uint64(32)).astype(np.uint32))
    least = least.reshape(-1, bins)
    for _ in range(bins):  # an empty bin takes the next filled one, marked by the distance
        empty = least == _EMPTY
        if not empty.any():
            break
        least = np.where(empty, np.roll(least, -1, axis=1), least)
        least = np.where(empty & (least != _EMPTY), least * np.uint32(0x9E3779B1) >> np.uint32(1), least)
    key = np.zeros((len(begin), bands), np.uint64)
    parts = least.reshape(len(begin), bands, rows)
    for r in range(rows):
        key = T.mix(key ^ parts[:, :, r].astype(np.uint64))
    return T.mix(key + np.arange(bands, dtype=np.uint64))


_LINES = "c long, doc_id long, rk long, pos int, g array<long>"


def _line_batches(gram: int, bands: int, rows: int):
    """Class and place of every line; its band keys where a task meets the class first."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for s in T.slices(batch.column("text"), limit=1 << 18, lower=True):
                begin, end, text, number = _lines(s)
                key = _class_keys(s, begin, end).view(np.int64)
                _, one = np.unique(key, return_index=True)
                one = np.array([i for i in np.sort(one).tolist() if int(key[i]) not in seen], dtype=np.int64)
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(key[one].tolist())
                before = np.r_[0, np.cumsum((s.data & 0xC0) != 0x80)]
                long = one[before[end[one]] - before[begin[one]] >= gram]  # shorter lines equal only themselves
                bk = band_keys(s.data, begin[long], end[long], gram, bands, rows) if len(long) else np.zeros(0, np.uint64)
                has = np.zeros(len(key), np.int32)
                has[long] = bands
                take = pa.array(text + s.lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), batch.column("doc_id").take(take), batch.column("rk").take(take),
                     pa.array(number.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(has)].astype(np.int32)), pa.array(bk.ravel().view(np.int64)))],
                    names=["c", "doc_id", "rk", "pos", "g"])
    return run


def _picked_lines(batches):
    """Lower-cased text of the listed lines."""
    for batch in T.row_runs(batches):
        ids, texts = [], []
        found = batch.column("found").to_pylist()
        for s in T.slices(batch.column("text"), lower=True):
            begin, end, text, number = _lines(s)
            at = {(int(t), int(n)): i for i, (t, n) in enumerate(zip(text, number))}
            for row in range(s.lo, s.hi):
                for line in found[row]:
                    i = at[(row - s.lo, line["pos"])]
                    ids.append(line["id"])
                    texts.append(s.data[begin[i]:end[i]].tobytes().decode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])


def removed_lines(docs: DataFrame, gram: int = GRAM, num: int = NUM, den: int = DEN, bands: int = BANDS,
                  rows: int = ROWS, heavy: int = HEAVY) -> DataFrame:
    """rk (hash of doc_id and text) and the sorted numbers of its lines to remove; only rows that lose some."""
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk")).where("text is not null")
    every = stage(texts.mapInArrow(_line_batches(gram, bands, rows), _LINES))
    lines = every.drop("g")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rk", "pos")
    classes = stage(lines.groupBy("c").agg(F.min(place).alias("first"), F.count("*").alias("times")))
    banded = every.select(F.explode("g").alias("g"), F.col("c").alias("id"))
    # bands that occur once are dropped before any row of theirs moves
    again = stage(banded.groupBy("g").agg(F.count("*").alias("times")).where("times > 1").select("g"))
    members = stage(bounded_join(banded, again, "g", "left_semi").distinct())
    # the most frequent class of a band is its pivot; the set size is not known yet, so 0 passes the size filter
    members = members.join(classes.select(F.col("c").alias("id"), (-F.col("times")).alias("score")), "id").withColumn(
        "n", F.lit(0).cast("long"))

    def texts_of(ids: DataFrame) -> DataFrame:
        at = stage(ids.join(classes.select(F.col("c").alias("id"), "first.rk", "first.pos"), "id").groupBy("rk")
                   .agg(F.collect_list(F.struct("id", "pos")).alias("found")))
        found = bounded_join(texts.select("rk", "text"), at, "rk", items=F.size("found")).select("text", "found")
        return found.mapInArrow(_picked_lines, "id long, text string").dropDuplicates(["id"])

    found = stage(links(members, texts_of, char_sets(gram), num, den, heavy=heavy))
    labels = components(found)
    several = classes.where("times > 1").select("c").unionByName(labels.select(F.col("id").alias("c"))).distinct()
    merged = stage(classes.join(several, "c").join(labels.withColumnRenamed("id", "c"), "c", "left")
                   .withColumn("component", F.coalesce("component", "c")))
    keeper = merged.groupBy("component").agg(F.min("first").alias("keep"))
    keeper = stage(join_summary(merged, keeper, ["component"]).select("c", "keep.rk", "keep.pos"))
    gone = lines.join(keeper.select("c", F.col("rk").alias("krk"), F.col("pos").alias("kpos")), "c").where(
        "rk <> krk or pos <> kpos")
    return gone.groupBy("rk").agg(F.sort_array(F.collect_set("pos")).alias("removed_lines"))


def has_words(text: str | None) -> bool:
    return bool(text and text.strip(" \t\n\v\f\r"))


def _without(text: str, removed: list[int] | None) -> str:
    if not removed:
        return text
    gone = set(removed)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def _rewrite(schema: StructType, removed: str):
    counted = "n_chars" in schema.names and schema["n_chars"].dataType.typeName() in ("long", "integer")

    def run(batches):
        for batch in T.row_runs(batches):
            before, gone = batch.column("text").to_pylist(), batch.column(removed).to_pylist()
            texts = [None if t is None else _without(t, r) for t, r in zip(before, gone)]
            kept = pa.array([not r or has_words(t) for t, r in zip(texts, gone)], pa.bool_())
            columns = {n: batch.column(n) for n in schema.names}
            columns["text"] = pa.array(texts, pa.string())
            if counted:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.column("n_chars").type)
            yield pa.RecordBatch.from_pydict(columns).filter(kept)
    return run


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The rows with their repeated lines removed, those that lose their last word left out;
    n_chars, if an integer, is that of the new text."""
    gone = removed_lines(docs, **options)
    rk, removed = fresh_name("_rk", docs), fresh_name("_removed", docs)
    keyed = docs.withColumn(rk, F.xxhash64("doc_id", "text"))
    joined = keyed.join(gone.select(F.col("rk").alias(rk), F.col("removed_lines").alias(removed)), rk, "left")
    return joined.drop(rk).mapInArrow(_rewrite(docs.schema, removed), docs.schema)


def _digest(batches):
    for batch in T.row_runs(batches):
        texts, removed = batch.column("text").to_pylist(), batch.column("removed_lines").to_pylist()
        kept = [_without(t or "", r) for t, r in zip(texts, removed)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([0 if t is None else t.count("\n") + 1 for t in texts], pa.int64()),
             pa.array([len(r or ()) for r in removed], pa.int64()), pa.array([r or [] for r in removed], pa.list_(pa.int32())),
             pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string())],
            names=["doc_id", "n_lines", "n_removed", "removed_lines", "kept_sha256"])


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (numbers from 0) and kept_sha256 of every row."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk"))
    return rows.join(removed_lines(docs, **options), "rk", "left").select("doc_id", "text", "removed_lines").mapInArrow(
        _digest, "doc_id long, n_lines long, n_removed long, removed_lines array<int>, kept_sha256 string")
