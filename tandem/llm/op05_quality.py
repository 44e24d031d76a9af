"""Quality rules by tokeniser fertility (operator 5).

A public vocabulary with byte fallback encodes the words of a text. Prose in a
language the vocabulary knows splits into few, varied pieces; shouting, symbol
runs, tables and foreign bytes do not. Measured over the whole text:

* characters per token: code points in words / pieces;
* byte-fallback share: pieces that stand for a single byte / pieces;
* token entropy: Shannon entropy of the text's pieces, relative to ``log2`` of
  their number; and the share of the most frequent piece.

Rejection bands are given per language (column ``lang``), else per script (that of
most of the text's letters). Edges widen with 1 / sqrt(words), as the measures of
short texts scatter. Before them, base rules reject texts under 20 words and
texts in which more than 30 % of the words lie in 8-word windows that occur twice.

Words are encoded one by one through a bounded cache, so the cost follows the
number of different words. A row needs nothing but itself: no shuffle.

Defined cases: null and empty texts have no words and fail the base rules;
repeated rows are judged alike; an empty table gives an empty result; extra
columns are not read (``judge``) or returned unchanged (``keep_good``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tandem.llm import textops as T

VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
#: Entries of a worker's cache of encoded words; a memory bound only.
CACHE_WORDS = 200_000

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True
_CONTINUATION = np.zeros(256, dtype=bool)
_CONTINUATION[0x80:0xC0] = True


@dataclass(frozen=True)
class Band:
    """Accepted ranges; outside any of them a text is rejected."""
    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_relative_entropy: float
    max_top_share: float
    widen_chars: float = 1.5   # the lower edge of characters per token falls by this / sqrt(words)
    widen_top: float = 0.35    # the upper edge of the top share rises by this / sqrt(words)

    def accepts(self, n_words: int, measures: tuple[float, float, float, float]) -> bool:
        chars, byte_share, entropy, top = measures
        root = max(1, n_words) ** 0.5
        return (self.min_chars_per_token - self.widen_chars / root <= chars <= self.max_chars_per_token
                and byte_share <= self.max_byte_share and entropy >= self.min_relative_entropy
                and top <= self.max_top_share + self.widen_top / root)


#: Bands of the 32k piece vocabulary. A language's lower edge lies a little under the
#: centre of its running prose; scripts that the vocabulary hardly knows cost more
#: pieces and fall back to bytes more often.
BANDS = {
    "en": Band(2.17, 8.0, 0.10, 0.40, 0.08),
    "de": Band(2.19, 8.0, 0.10, 0.40, 0.08),
    "fr": Band(1.93, 8.0, 0.10, 0.40, 0.08),
    "es": Band(1.89, 8.0, 0.10, 0.40, 0.08),
    "latin": Band(1.60, 8.0, 0.20, 0.35, 0.12),
    "cyrillic": Band(1.2, 8.0, 0.20, 0.35, 0.20),
    "greek": Band(0.8, 6.0, 0.40, 0.35, 0.20),
    "other": Band(0.25, 6.0, 0.95, 0.25, 0.30),
}

#: Lead bytes of two-byte UTF-8 letters by script; ASCII letters are Latin, longer sequences other.
_SCRIPT = np.full(256, 4, dtype=np.int64)  # 4: no letter
_SCRIPT[65:91] = _SCRIPT[97:123] = 0
_SCRIPT[0xC3:0xCA] = 0
_SCRIPT[0xD0:0xD4] = 1
_SCRIPT[0xCD:0xD0] = 2
_SCRIPT[0xD4:0xF5] = 3
SCRIPTS = ("latin", "cyrillic", "greek", "other")


class Pieces:
    """Ids of words from a cache, by one vocabulary."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.IsByte(i) or self.model.IsUnknown(i)
                                 for i in range(self.model.vocab_size())])
        self.cache: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        new = list({w for w in words if w not in cache})
        if new:
            for w, ids in zip(new, self.model.encode([w.decode() for w in new], num_threads=1)):
                cache[w] = np.array(ids, dtype="<i4").tobytes()
        return np.frombuffer(b"".join(map(cache.__getitem__, words)), dtype="<i4")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted order, mark of the first of each equal (own, key) run in that order)."""
    order = np.lexsort((keys, own))
    k, o = keys[order], own[order]
    return order, np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])] if len(k) else np.zeros(0, bool)


def base_counts(s: T.Slice) -> dict[str, np.ndarray]:
    """The base columns of every text of a slice."""
    begin, end, first = s.words()
    n = len(s.offsets) - 1
    words = T.byte_hashes(s.data, begin, end)
    out = {"n_words": np.diff(first),
           "word_chars": _per_text(~T.SEPARATOR[s.data] & ~_CONTINUATION[s.data], s.offsets),
           "n_symbols": _per_text(_SYMBOL[s.data], s.offsets)}
    # lines that hold a word; non-empty runs between newlines cover all of them
    lo, hi, line_first = s.spans(_NEWLINE)
    inside = np.r_[0, np.cumsum(~T.SEPARATOR[s.data], dtype=np.int64)]
    worded = inside[hi] > inside[lo]
    own = T.owners(line_first)[worded]
    _, new = _repeats(T.byte_hashes(s.data, lo[worded], hi[worded]), own)
    out["n_dup_lines"] = np.bincount(own, minlength=n) - np.bincount(own[_order(own)][new], minlength=n)
    # words in 8-word windows that occur twice
    word_own = T.owners(first)
    starts = np.flatnonzero(first[1:][word_own] - np.arange(len(words)) >= REPEAT_WINDOW)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(starts):
        order, new = _repeats(T.window_hashes(words, starts, REPEAT_WINDOW), word_own[starts])
        twice = ~(new & np.r_[new[1:], True])
        hit = starts[order[twice]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(covered)[:-1] > 0, first)
    return out


def _order(own: np.ndarray) -> np.ndarray:
    return np.argsort(own, kind="stable")


def fertility(ids: np.ndarray, is_byte: np.ndarray, chars: int) -> tuple[float, float, float, float]:
    """characters per token, byte-fallback share, relative entropy, share of the top piece."""
    n = len(ids)
    counts = np.bincount(ids)
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    return chars / n, float(is_byte[ids].mean()), entropy / max(1.0, float(np.log2(n))), float(p.max())


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(batch: pa.RecordBatch, model: Pieces, bands: dict[str, Band]) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in (*COLUMNS, "base_failed", "chars_per_token", "byte_share",
                                            "token_entropy", "top_share", "script", "kept")}
    langs = batch.column("lang").to_pylist() if "lang" in batch.schema.names else [None] * batch.num_rows
    for s in T.slices(batch.column("text")):
        base = base_counts(s)
        raw = s.data.tobytes()
        script = _SCRIPT[s.data]
        for i in range(s.hi - s.lo):
            a, b = s.offsets[i], s.offsets[i + 1]
            for c in COLUMNS:
                out[c].append(int(base[c][i]))
            n = out["n_words"][-1]
            failed = n < MIN_WORDS or 100 * out["n_repeat_words"][-1] > REPEAT_PERCENT * n
            ids = model.of(raw[a:b].split())
            letters = np.bincount(script[a:b], minlength=5)[:4]
            name = SCRIPTS[int(letters.argmax())]
            lang = langs[s.lo + i]
            band = bands[lang if lang in bands else name]
            m = fertility(ids, model.is_byte, out["word_chars"][-1]) if len(ids) else (0.0, 0.0, 0.0, 0.0)
            out["base_failed"].append(failed)
            for c, v in zip(("chars_per_token", "byte_share", "token_entropy", "top_share"), m):
                out[c].append(v)
            out["script"].append(name)
            out["kept"].append(not failed and len(ids) > 0 and band.accepts(n, m))
    return out


def judge(docs: DataFrame, bands: dict[str, Band] | None = None, vocabulary: str | None = None) -> DataFrame:
    """Base counts, fertility measures and verdict of every row."""
    bands = bands or BANDS

    def run(batches):
        model = pieces(vocabulary_path(vocabulary))
        for batch in T.row_runs(batches):
            out = _judged(batch, model, bands)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {
                k: pa.array(v, pa.string() if k == "script" else pa.bool_() if k in ("base_failed", "kept")
                            else pa.int64() if k in COLUMNS else pa.float64()) for k, v in out.items()})

    return docs.select("doc_id", "text", *(c for c in docs.columns if c == "lang")).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, chars_per_token double, byte_share double, token_entropy double, "
             "top_share double, script string, kept boolean")


def _good(bands: dict[str, Band], vocabulary: str | None):
    def run(batches):
        model = pieces(vocabulary_path(vocabulary))
        for batch in T.row_runs(batches):
            yield batch.filter(pa.array(_judged(batch, model, bands)["kept"], pa.bool_()))
    return run


def keep_good(docs: DataFrame, bands: dict[str, Band] | None = None, vocabulary: str | None = None) -> DataFrame:
    """The rows that pass, with their columns unchanged."""
    return docs.mapInArrow(_good(bands or BANDS, vocabulary), docs.schema)
