import hashlib
import random

import numpy as np
import pyarrow as pa
from helpers import documents, fixture_rows, prose, words
from pyspark.sql import functions as F

from tandem.llm import grouplinks
from tandem.llm.op08_lines import band_keys, char_sets, dedup_lines, line_report

OUTER = " \t\n\r\x0b\x0c"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def line_set(line, k):
    line = lower(line).strip(OUTER)
    return frozenset(line[i:i + k] for i in range(len(line) - k + 1)) if len(line) >= k else frozenset([line])


def brute(rows, k=8, num=8, den=10):
    """Removed line numbers of every row, from all pairs of different lines."""
    lines = [(doc is None, doc if doc is not None else 0, str(t), n, line_set(x, k)) for doc, t, *_ in rows if t is not None
             for n, x in enumerate(t.split("\n")) if words(x)]
    sets = list({s[4] for s in lines})
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    where = {}
    for i, s in enumerate(sets):
        near = {j for t in s for j in where.get(t, ())}
        for j in near:
            both = len(s & sets[j])
            if den * both >= num * (len(s) + len(sets[j]) - both):
                label[find(i)] = find(j)
        for t in s:
            where.setdefault(t, []).append(i)
    number = {s: i for i, s in enumerate(sets)}
    keep, out = {}, {}
    for last, doc, t, n, s in lines:
        root = find(number[s])
        keep[root] = min(keep.get(root, (last, doc, t, n)), (last, doc, t, n))
    for last, doc, t, n, s in lines:
        if keep[find(number[s])] != (last, doc, t, n):
            out.setdefault((None if last else doc, t), set()).add(n)
    return out


def lines_fixture():
    rng = random.Random(9)
    pool = [prose(rng, rng.randint(1, 40)).replace("\n", " ") for _ in range(120)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(0, 9)):
            x = rng.choice(pool[:10] if rng.random() < 0.3 else pool)
            kind = rng.random()
            if kind < 0.2:
                x = "  " + x.upper() + "\t"
            elif kind < 0.5 and len(x) > 60:
                at = rng.randrange(len(x))
                x = x[:at] + rng.choice("xyz") + x[at + 1:]
            lines.append(x)
        lines.insert(rng.randint(0, len(lines)), "")
        rows.append((i, "\n".join(lines), "en", "s", None))
    return rows


def test_equals_brute_force(spark):
    for rows in (lines_fixture(), fixture_rows()):
        want = brute(rows)
        for heavy in (64, 3):
            got = line_report(documents(spark, rows), bands=16, rows=2, heavy=heavy).collect()
            assert len(got) == len(rows)
            by_id = {}
            for doc, t, *_ in rows:
                gone = want.get((doc, str(t)), set()) if t is not None else set()
                kept = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone)
                by_id.setdefault(doc, []).append((0 if t is None else t.count("\n") + 1, len(gone), sorted(gone),
                                                  hashlib.sha256(kept.encode()).hexdigest()))
            for r in got:
                assert (r.n_lines, r.n_removed, r.removed_lines, r.kept_sha256) in by_id[r.doc_id]


def test_production_bands_find_nearly_all(spark):
    rows = lines_fixture()
    want = brute(rows)
    got = {r.doc_id: set(r.removed_lines) for r in line_report(documents(spark, rows)).collect()}
    total = sum(map(len, want.values()))
    found = sum(len(got[doc] & gone) for (doc, _), gone in want.items())
    extra = sum(len(got[doc] - want.get((doc, t), set())) for doc, t, *_ in rows)
    assert found >= 0.98 * total and extra == 0


def test_dedup_rewrites_rows(spark):
    docs = documents(spark, lines_fixture() + [(500, None, None, None, None)])
    out = dedup_lines(docs)
    digest = {r.doc_id: r.kept_sha256 for r in line_report(docs).collect()}
    left = {r.doc_id for r in out.collect()}
    texts = {d: t for d, t, *_ in lines_fixture()}
    gone = [d for d in digest if d not in left]
    assert out.schema == docs.schema and out.count() == 81 - len(gone)
    blank = {hashlib.sha256(("\n" * n).encode()).hexdigest() for n in range(200)} | {hashlib.sha256(b" ").hexdigest()}
    assert all(digest[d] in blank or not words(texts[d]) for d in gone)
    for r in out.collect():
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == digest[r.doc_id]
        assert r.n_chars == (None if r.text is None else len(r.text))
    again = dedup_lines(out.where(F.col("doc_id") < 500)).collect()  # only components that survivors form anew
    assert sum(len(r.text) for r in again) <= sum(len(r.text or "") for r in out.collect())
    assert dedup_lines(documents(spark, [])).collect() == []


def test_signatures_agree_like_jaccard():
    rng = random.Random(2)
    agree = total = 0.0
    for _ in range(60):
        x = "".join(rng.choice("abcdefghij ") for _ in range(300))
        y = x[:150] + "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 60))) + x[150:]
        a, b = (set(s.tolist()) for s in char_sets(8)([x, y]))
        data = np.frombuffer((x + y).encode(), np.uint8)
        cut = len(x)
        keys = band_keys(data, np.array([0, cut]), np.array([cut, len(data)]), 8, 64, 1)
        agree += (keys[0] == keys[1]).mean()
        total += len(a & b) / len(a | b)
    assert abs(agree - total) / 60 < 0.03


def test_broadcast_lists_are_bounded_by_their_entries(spark, monkeypatch):
    docs = documents(spark, lines_fixture())
    want = sorted(map(tuple, line_report(docs).collect()))
    limit, sent, broadcast = 90, [], F.broadcast

    def spy(df):
        sent.append(df.agg(F.sum(F.size("found"))).first()[0] if "found" in df.columns else df.count())
        return broadcast(df)
    monkeypatch.setattr(grouplinks, "BROADCAST_KEYS", limit)  # 80 documents, more lines
    monkeypatch.setattr(grouplinks.F, "broadcast", spy)
    assert sorted(map(tuple, line_report(docs).collect())) == want
    assert sent and max(x or 0 for x in sent) <= limit


def test_groups_with_many_open_members_get_new_pivots(spark, monkeypatch):
    """Two centres and strays in one band: pivots level by level find the same components."""
    rng = random.Random(4)
    rows, n = lines_fixture(), 0
    for _ in range(2):
        centre = prose(rng, 40).replace("\n", " ")
        for _ in range(25):
            w = centre.split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "x%d" % rng.randrange(30)
            rows.append((600 + n, " ".join(w), None, None, 1))
            n += 1
    want = sorted(map(tuple, line_report(documents(spark, rows), bands=16, rows=2).collect()), key=str)
    monkeypatch.setattr(grouplinks, "OPEN_PAIRS", 2)
    assert sorted(map(tuple, line_report(documents(spark, rows), bands=16, rows=2, heavy=4).collect()), key=str) == want


def test_clashing_names_survive(spark):
    rows = lines_fixture()
    names = ["_rk", "_removed", "_removed_", "c", "pos", "id", "g", "first", "again", "_again"]
    docs = documents(spark, rows).drop("n_chars").withColumns({**{n: F.lit(7) for n in names}, "n_chars": F.lit("many")})
    out = dedup_lines(docs)
    assert out.schema == docs.schema and out.select(*names, "n_chars").distinct().collect() == [tuple([7] * len(names)) + ("many",)]
    assert {r.doc_id: r.text for r in out.collect()} == {r.doc_id: r.text for r in dedup_lines(documents(spark, rows)).collect()}
    short = dedup_lines(documents(spark, rows).withColumn("n_chars", F.col("n_chars").cast("int")))
    assert all(r.n_chars == len(r.text) for r in short.collect())
