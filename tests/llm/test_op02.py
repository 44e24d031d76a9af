import hashlib

from helpers import documents, fixture_rows, words

from tandem.llm.op02_substring import remove_repeats


def brute(rows, window):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            w = words(t)
            for j in range(len(w) - window + 1):
                g = tuple(w[j:j + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j:j + window])] < i:
                gone.update(range(j, j + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rows = fixture_rows()
    for window in (50, 4, 9):
        got = sorted((tuple(r) for r in remove_repeats(documents(spark), window).collect()), key=str)
        assert got == brute(rows, window)


def test_empty_table(spark):
    assert remove_repeats(documents(spark, [])).collect() == []


def test_ids_with_two_texts_do_not_remove_from_themselves(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, None, None, 0), (1, "x " + text, None, None, 0), (2, text + " y", None, None, 0)]
    got = {(r.doc_id, r.n_words): r.n_removed for r in remove_repeats(documents(spark, rows)).collect()}
    assert got == {(1, 60): 0, (1, 61): 0, (2, 61): 60}
