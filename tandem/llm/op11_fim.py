"""Fill-in-the-middle transformation by a wavelet matrix over character classes (operator 11).

A text is cut into units (lines, paragraphs, words or sentences); two cuts between
units part it into prefix, middle and suffix, written out as

    psm   <P>prefix<S>suffix<M>middle        spm   <S>suffix<P>prefix<M>middle

or left as it is (plain). Every character has one of seven classes, and a wavelet
matrix over the classes of some whole texts answers ``rank(class, place)`` for all of
them at once. The boundaries of a unit are the characters of a few classes, so their
ranks added up count the units of a text, and bisection on that sum finds the place of
a cut; no unit is ever built.

Everything is drawn from the sha256 of ``seed:doc_id``, so a lost task draws the same
again. A text never leaves its row and nothing is shuffled; memory is a few dozen times
the longest text of a batch (2 GB of text at most, Arrow's limit for a string).

Defined cases: null and empty texts are plain with 0 units; a text that contains a
marker is plain, as it could not be told apart from the output; a null id draws from
the seed alone; repeated rows give equal rows; extra columns are not read, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm import textops as T

#: Character classes.
INNER, WORD_START, SPACE, LINE_END, BLANK_LINE_END, MARK, MARK_START = range(7)
LEVELS = 3
_STOPS = np.frombuffer(b".!?", dtype=np.uint8)


@dataclass(frozen=True)
class Unit:
    """Classes of the characters that end a unit, or that begin one."""
    classes: tuple[int, ...]
    ends: bool


UNITS = {
    "line": Unit((LINE_END, BLANK_LINE_END), True),
    "paragraph": Unit((BLANK_LINE_END,), True),
    "sentence": Unit((MARK, MARK_START), True),
    "word": Unit((WORD_START, MARK_START), False),
}


@dataclass(frozen=True)
class Settings:
    unit: str = "line"
    seed: str = "7"
    rate: int = 100      # per cent of the texts that are transformed
    spm_rate: int = 50   # per cent of these in suffix-prefix-middle order
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class _Bits:
    """A bit vector with ranks: counts of ones before every 64-bit block."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=bool)
        padded[:len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)]
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & low)


class WaveletMatrix:
    """Ranks of every symbol of a sequence over ``2 ** levels`` symbols."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.shifts = range(levels - 1, -1, -1)
        self.levels = []
        for shift in self.shifts:
            bits = (symbols >> shift & 1).astype(bool)
            self.levels.append(_Bits(bits))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each place."""
        lo, hi = np.zeros_like(at), at
        for shift, bits in zip(self.shifts, self.levels):
            lo_ones, hi_ones = bits.ones(lo), bits.ones(hi)
            if symbol >> shift & 1:
                lo, hi = bits.zeros + lo_ones, bits.zeros + hi_ones
            else:
                lo, hi = lo - lo_ones, hi - hi_ones
        return hi - lo


def classes_of(s: T.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of every code point, its first byte and the end, first code point of every text and the end)."""
    heads = np.flatnonzero((s.data & 0xC0) != 0x80)
    first = np.searchsorted(heads, s.offsets)
    lead = s.data[heads]                      # the classes are told apart by ASCII characters
    edge = np.zeros(len(heads) + 1, dtype=bool)
    edge[first] = True
    gap, newline, stop = T.SEPARATOR[lead], lead == 10, np.isin(lead, _STOPS)
    after_gap = np.r_[True, gap[:-1]] | edge[:-1] if len(heads) else gap
    after_newline = np.r_[True, newline[:-1]] | edge[:-1] if len(heads) else gap
    out = np.full(len(heads), INNER, dtype=np.uint8)
    out[gap] = SPACE
    out[~gap & after_gap] = WORD_START
    out[stop] = MARK
    out[stop & after_gap] = MARK_START
    out[newline] = LINE_END
    out[newline & after_newline] = BLANK_LINE_END
    return out, np.r_[heads, len(s.data)], first


class Cutter:
    """Unit counts and places of cuts for the texts of a slice."""

    def __init__(self, classes: np.ndarray, first: np.ndarray, unit: Unit):
        self.matrix, self.unit = WaveletMatrix(classes), unit
        self.begin, self.end = first[:-1], first[1:]
        self.base = self._boundaries(self.begin)
        inside = self._boundaries(self.end) - self.base
        if unit.ends:  # what follows the last boundary is a unit too
            last = classes[np.maximum(self.end - 1, 0)] if len(classes) else np.zeros(len(self.end), np.uint8)
            open_end = (self.end > self.begin) & ~np.isin(last, unit.classes)
            self.units = inside + open_end
        else:          # what precedes the first boundary belongs to the first unit
            self.units = np.where(self.end > self.begin, np.maximum(inside, 1), 0)

    def _boundaries(self, at: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(c, at) for c in self.unit.classes)

    def place(self, units: np.ndarray) -> np.ndarray:
        """Place after that many units of every text, by bisection on the boundary counts."""
        want = self.base + units + (0 if self.unit.ends else 1)
        lo, hi = self.begin.copy(), self.end.copy()
        while (open_ := lo < hi).any():
            middle = (lo + hi) >> 1
            enough = self._boundaries(middle) >= want
            hi = np.where(open_ & enough, middle, hi)
            lo = np.where(open_ & ~enough, middle + 1, lo)
        if not self.unit.ends:  # the boundary is the first character of the next unit
            lo = np.where(units >= self.units, self.end, np.maximum(lo - 1, self.begin))
        return np.where(units <= 0, self.begin, lo)


_RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                    ("middle_chars", pa.int64()), ("output", pa.string())])


def _transform(settings: Settings):
    p, s, m = (x.encode() for x in (settings.prefix, settings.suffix, settings.middle))
    unit = UNITS[settings.unit]

    def run(batches):
        for batch in batches:
            for part in T.slices(batch.column("text")):
                rows = batch.slice(part.lo, part.hi - part.lo)
                classes, heads, first = classes_of(part)
                cutter = Cutter(classes, first, unit)
                h = [rows.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
                draws = [h[k] % (cutter.units + 1) for k in (0, 1)]
                low, high = (cutter.place(f(*draws)) for f in (np.minimum, np.maximum))
                data = part.data.tobytes()
                forms, outputs, plain = [], [], np.zeros(len(low), dtype=bool)
                for i in range(len(low)):
                    a, b = int(part.offsets[i]), int(part.offsets[i + 1])
                    text = data[a:b]
                    if not text or any(x in text for x in (p, s, m)) or h[2][i] % 100 >= settings.rate:
                        plain[i] = True
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    x, y = int(heads[low[i]]) - a, int(heads[high[i]]) - a
                    spm = h[3][i] % 100 < settings.spm_rate
                    forms.append("spm" if spm else "psm")
                    outputs.append(b"".join((s, text[y:], p, text[:x], m, text[x:y]) if spm
                                            else (p, text[:x], s, text[y:], m, text[x:y])))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").cast(pa.int64()), pa.array(cutter.units, pa.int64()), pa.array(forms, pa.string()),
                     pa.array(low - cutter.begin, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain),
                     pa.array(outputs, pa.binary()).view(pa.string())], schema=_ARROW)
    return run


def fill_in_middle(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output of every row."""
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    return docs.select("doc_id", "text", *draws).mapInArrow(_transform(settings), _RESULT)


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text again, from output and form alone."""
    def parts(lead: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.split_part(output, F.lit(second), F.lit(2))
        head = F.substr(F.split_part(output, F.lit(second), F.lit(1)), F.lit(len(lead) + 1))
        return head, F.split_part(rest, F.lit(settings.middle), F.lit(1)), F.split_part(rest, F.lit(settings.middle), F.lit(2))

    prefix, suffix, middle = parts(settings.prefix, settings.suffix)
    suffix2, prefix2, middle2 = parts(settings.suffix, settings.prefix)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output))


def digest(transformed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The transformed rows with the sha256 of the output and of the text restored from it."""
    back = restored(F.col("output"), F.col("form"), settings)
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                              F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
