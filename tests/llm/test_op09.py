import hashlib
import random
from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
from helpers import documents, fixture_rows, words

from tandem.llm import textops as T
from tandem.llm.op09_simhash import edited, fingerprints, prints, with_near_counts, within_radius


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def term_hashes(text):
    w = words(lower(text))
    data = np.frombuffer(" ".join(w).encode(), np.uint8)
    ends = np.cumsum([len(x.encode()) + 1 for x in w]) - 1 if w else np.zeros(0, np.int64)
    starts = np.array([e - len(x.encode()) for e, x in zip(ends, w)], dtype=np.int64)
    h = T.byte_hashes(data, starts, ends.astype(np.int64))
    return h if len(h) < 2 else T.window_hashes(h, np.arange(len(h) - 1), 2)


def brute(text):
    votes = [0] * 64
    for h, n in Counter(term_hashes(text).tolist()).items():
        for bit in range(64):
            votes[bit] += round(16 * (1 + log2(n))) * (1 if h >> bit & 1 else -1)
    # byte b of the hash, its bits from the highest: as packed
    packed = bytes(sum((votes[8 * b + 7 - i] > 0) << (7 - i) for i in range(8)) for b in range(8))
    return int.from_bytes(packed, "little")


def test_votes_equal_brute_force():
    texts = [t for _, t, *_ in fixture_rows()]
    assert prints(pa.array(texts, pa.string())).tolist() == [brute(t) for t in texts]


def test_edited_texts(spark):
    rows = fixture_rows()
    got = edited(documents(spark)).collect()
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    want = []
    for i, (doc, t, *_) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        a, b, c = brute(t), brute(e), brute(n)
        want.append((doc, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{a:016x}", f"{b:016x}",
                     1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)


def test_few_rows(spark):
    assert edited(documents(spark, [])).collect() == []
    one = edited(documents(spark, [(5, "a b c d", None, None, 7)])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    both = edited(documents(spark, [(5, None, None, None, None), (6, "", None, None, 0)])).collect()
    assert [(r.n_chars, r.fingerprint, r.near_next) for r in both] == [(0, "0" * 16, 1.0)] * 2


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(4)
    values = []
    for _ in range(60):
        v = rng.getrandbits(64)
        values.append(v)
        for _ in range(3):
            w = v
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                w ^= 1 << bit
            values.append(w)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed + signed[:9]], "fp long")
    for radius, blocks in ((3, 5), (2, 4), (0, 1), (4, 6)):
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
        got = within_radius(df, radius, blocks).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    counts = {r.fp: r.n_near for r in with_near_counts(df, 3).collect()}
    near = Counter(x for r in within_radius(df, 3).collect() for x in (r.a, r.b))
    assert counts == {v: near[v] for v in signed}


def test_likeness_follows_the_edit(spark):
    rows = [r for r in fixture_rows() if r[0] is not None and r[0] < 60 and len(words(r[1])) > 100]
    got = edited(documents(spark, rows)).collect()
    mean = lambda k: sum(r[k] for r in got) / len(got)
    assert mean("near_next") < 0.56 < 0.6 < mean("near_edited") < 0.75
    assert {r.doc_id for r in fingerprints(documents(spark, rows)).collect()} == {r[0] for r in rows}
