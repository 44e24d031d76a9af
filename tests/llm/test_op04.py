import random

import pytest
from helpers import documents, fixture_rows, words

from tandem.llm.components import components
from tandem.llm.op04_jaccard import jaccard_components, one_of_each


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(s), least.get(find(i))) for i, ((doc, *_), s) in enumerate(zip(rows, sets))), key=str)


def near_group(n=120, length=200, edits=8, seed=1):
    """Copies of one text with random edits: linked, unlinked and in between."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(length)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w), None, None, 0))
    return rows


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10), (1, 1, 2)])
def test_fixture_equals_brute_force(spark, k, num, den):
    rows = fixture_rows()
    for heavy in (64, 2):
        got = jaccard_components(documents(spark), k, num, den, heavy=heavy).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k, num, den)


@pytest.mark.parametrize("edits,seed", [(8, 1), (14, 2)])
def test_a_large_near_group_by_pivots(spark, edits, seed):
    rows = near_group(edits=edits, seed=seed) + [(1000 + i, f"a b {i}", None, None, 0) for i in range(30)]
    for heavy in (4, 20):
        got = jaccard_components(documents(spark, rows), 3, 90, 100, heavy=heavy).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 90, 100)


def test_edits_of_the_pivot_make_no_candidates(spark, monkeypatch):
    """Copies with two edits each, none shared: no two are linked, and the edits of the pivot, which stand in the
    differences of all others, must not make candidates of all pairs. Some more lie nearer to the text itself."""
    from tandem.llm import grouplinks
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(140):
        w = list(base)
        for at in rng.sample(range(10, 140, 4), 2 if i < 120 else 1):
            w[at] = f"edit{i}at{at}"
        rows.append((i, " ".join(w), None, None, 0))
    seen = []
    plain = grouplinks._residual_pairs

    def counted(*args, **kwargs):
        pairs = plain(*args, **kwargs).localCheckpoint()
        seen.append(pairs.count())
        return pairs
    monkeypatch.setattr(grouplinks, "_residual_pairs", counted)
    for part in (rows[:120], rows):
        seen.clear()
        got = jaccard_components(documents(spark, part), 3, 90, 100, heavy=4).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(part, 3, 90, 100)
        assert len(seen) == 1 and seen[0] < 8 * len(part)


def test_one_of_each(spark):
    rows = fixture_rows()
    docs = documents(spark)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    want = set()
    for doc, n, comp in brute(rows, 5, 8, 10):
        if n == 0 or comp is None or doc == comp:
            want.add(doc)
    got = [r.doc_id for r in kept.collect()]
    assert set(got) == want and got.count(7) == 1
    assert one_of_each(documents(spark, [])).collect() == []


def test_one_of_each_with_null_and_tied_ids(spark):
    words_of = [f"w{i}" for i in range(100)]
    def copy(n):
        return " ".join([*words_of, f"end{n}"])
    other = " ".join(f"o{i}" for i in range(100))
    rows = [(None, copy(n), "en", "s", 0) for n in range(3)]               # near copies, no ids
    rows += [(1, other + f" x{n}", "en", "s", 0) for n in range(2)]        # near copies, one id
    rows += [(2, other + " x2", "en", "s", 0), (None, other + " x3", "en", "s", 0)]
    rows += [(None, None, "en", "s", None), (None, "", "en", "s", 0)]      # no words: both stay
    kept = sorted((r.doc_id is None, (r.text or "")[:1]) for r in one_of_each(documents(spark, rows)).collect())
    assert kept == [(False, "o"), (True, ""), (True, ""), (True, "w")]


def test_components_of_long_paths(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 40)] + [(200, 200), (301, 300), (300, 302)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_clashing_names_survive(spark):
    from pyspark.sql import functions as F
    from tandem.llm.op04_jaccard import one_of_each
    names = ["_rk", "_rk_", "c", "component", "first", "times", "_again"]
    docs = documents(spark).withColumns({n: F.lit(7) for n in names})
    out = one_of_each(docs)
    assert out.columns == docs.columns and out.select(*names).distinct().collect() == [tuple([7] * len(names))]
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None) == sorted(
        (r.doc_id, r.text) for r in one_of_each(documents(spark)).collect() if r.doc_id is not None)
