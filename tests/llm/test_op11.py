"""Fill-in-the-middle: brute force over regular expressions, round trip, wavelet ranks."""

import hashlib
import re

import numpy as np
import pytest
from helpers import documents, fixture_rows

from tandem.llm.op11_fim import LEVELS, UNITS, Settings, WaveletMatrix, digest, fill_in_middle

UNIT = {
    "line": r"[^\n]*\n|[^\n]+",
    "paragraph": r"(?s:.*?(?:(?<=\n)\n|(?<![\s\S])\n)|.+)",
    "sentence": r"(?s:[^.!?]*[.!?]|[^.!?]+)",
    "word": r"(?s:(?:\A[\x20\x09-\x0D]*)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|.+)",
}
EXTRA = ["a\n\nb\n\n\nc", "\n", "\n\n", "x <P> y\nz", "<M>", "has <S>\n", "P><S\n<\nM>", "a.b! c?\nd . e", "  lead word \n tail ",
         "é\n漢\n🙂\n", "no newline at all", "\r\n\r\n", "x" * 5000 + "\n" + "y" * 9000, "q\n" * 3000]


def brute(doc_id, text, s):
    text = text or ""
    h = hashlib.sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    units = [u for u in re.findall(UNIT[s.unit], text) if u]
    assert "".join(units) == text
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, e = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in (s.prefix, s.suffix, s.middle)) or h3 % 100 >= s.rate:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < s.spm_rate:
        return (doc_id, n, "spm", len(p), len(m), s.suffix + e + s.prefix + p + s.middle + m)
    return (doc_id, n, "psm", len(p), len(m), s.prefix + p + s.suffix + e + s.middle + m)


def rows_of_test():
    return fixture_rows() + [(200 + i, t, None, None, None) for i, t in enumerate(EXTRA)]


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_against_brute_force(spark, unit):
    s = Settings(unit=unit, rate=80 if unit == "word" else 100)
    rows = rows_of_test()
    got = sorted(map(tuple, fill_in_middle(documents(spark, rows), s).collect()), key=str)
    assert got == sorted((brute(r[0], r[1], s) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_text_comes_back(spark):
    rows = rows_of_test()
    got = digest(fill_in_middle(documents(spark, rows))).select("doc_id", "output_sha256", "restored_sha256").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(r[0], sha(brute(r[0], r[1], Settings())[5]), sha(r[1] or "")) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = documents(spark).where("false")
    assert digest(fill_in_middle(df)).collect() == []


def test_ranks():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 7, n).astype(np.uint8)
        matrix = WaveletMatrix(symbols, LEVELS)
        at = np.arange(n + 1)
        for c in range(8):
            assert matrix.rank(c, at).tolist() == np.r_[0, np.cumsum(symbols == c)].tolist()
