import random
from collections import Counter
from fractions import Fraction

from helpers import documents, fixture_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandem.llm import op06_mixing
from tandem.llm.op06_mixing import Ideal, block_rows, keep_mixed, mix


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole numbers of slots for every positive weight, summing to the period: largest remainders, 1 at least."""
    weights = {s: w for s, w in weights.items() if w > 0}
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) * period / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))  # furthest below their share first
    i = 0
    while (left := period - sum(out.values())) > 0:
        out[order[i % len(order)]] += 1
        i += 1
    while left < 0:  # the least shares of 1 took too much
        most = max(out, key=lambda s: (out[s] - exact[s], s))
        if out[most] == 1:
            most = max(out, key=lambda s: (out[s], s))
        out[most] -= 1
        left += 1
    return out


def schedule(slots: dict[str, int]) -> dict[str, list[int]]:
    """Slots of one period given to each source."""
    ideal = Ideal(slots, slots)
    at: dict[str, list[int]] = {s: [] for s in slots}
    for slot, i, _ in ideal.walk([0] * len(ideal.names), 0, sum(slots.values())):
        at[ideal.names[i]].append(slot)
    return at


def period_for(sources: int) -> int:
    return max(1000, 8 * sources)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=3), st.floats(1e-6, 1e6), min_size=1, max_size=12), st.integers(20, 300))
def test_every_prefix_is_within_one_block(weights, period):
    slots = shares(weights, period)
    assert sum(slots.values()) == period and min(slots.values()) >= 1
    at = schedule(slots)
    assert sorted(x for xs in at.values() for x in xs) == list(range(period))
    for s, xs in at.items():
        for k, x in enumerate(xs):  # within the window: had k blocks before, k + 1 after
            assert k * period // slots[s] <= x < -(-(k + 1) * period // slots[s])
        had = 0
        for t in range(period + 1):
            while had < len(xs) and xs[had] < t:
                had += 1
            assert abs(had - t * slots[s] / period) < 1


def test_shares_follow_the_weights():
    assert shares({"a": 1, "b": 3, "z": 0}, 1000) == {"a": 250, "b": 750}
    assert shares({"a": 1e-9, "b": 1}, 10) == {"a": 1, "b": 9}


def test_mix_of_a_hot_source(spark):
    rng = random.Random(1)
    rows = [(i, f"t{i}", None, rng.choice(["hot"] * 6 + ["a", "b", None]), 2) for i in range(3000)]
    rows += [rows[0]] * 3
    weights = {"hot": 0.25, "a": 0.25, "b": 0.3, "": 0.2, "absent_zero": 0.0}
    out = mix(documents(spark, rows), weights, block=4).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((i, s) for i, _, _, s, _ in rows)
    mixed = sorted((r for r in out if r.in_mix), key=lambda r: r.mix_position)
    assert [r.mix_position for r in mixed] == list(range(len(mixed)))
    assert all(r.mix_position is None for r in out if not r.in_mix)
    blocks = [mixed[i:i + 4] for i in range(0, len(mixed), 4)]
    had = Counter()
    for n, b in enumerate(blocks, 1):
        assert len({(r.mix_source, r.mix_block, r.mix_slot) for r in b}) == 1 and b[0].mix_slot == n - 1
        had[b[0].mix_source] += 1
        for s, w in weights.items():
            assert abs(had[s] - n * w) < 1
    counts = Counter(r.mix_source for r in out)
    scarce = min(counts[s] / w for s, w in weights.items() if w)
    assert len(mixed) > scarce - 4 * period_for(0) / 100


def test_defaults_and_edges(spark):
    docs = documents(spark)
    out = mix(docs)
    assert out.count() == len(fixture_rows())
    kept = keep_mixed(docs, block=1)
    assert kept.columns == docs.columns and 0 < kept.count() <= len(fixture_rows())
    assert mix(documents(spark, [])).collect() == []
    assert {r.in_mix for r in mix(docs, {"nowhere": 1.0}).collect()} == {False}
    assert {r.in_mix for r in mix(docs, {}).collect()} == {False}


def ideal_after(t, weights, blocks):
    """Blocks of each source after t slots of the ideal mix, drained source by source."""
    had, left = dict.fromkeys(blocks, Fraction(0)), Fraction(t)
    while left > 0:
        flow = {s: Fraction(weights[s]) for s in blocks if had[s] < blocks[s]}
        step = min(left / sum(flow.values()), *((blocks[s] - had[s]) / w for s, w in flow.items()))
        for s, w in flow.items():
            had[s] += step * w
        left -= step * sum(flow.values())
    return had


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text(max_size=2), st.tuples(st.integers(1, 40), st.floats(1e-6, 1e6)), min_size=1, max_size=8))
def test_sources_that_run_dry_go_out(sources):
    blocks, weights = {s: n for s, (n, _) in sources.items()}, {s: w for s, (_, w) in sources.items()}
    ideal, had, total = Ideal(weights, blocks), Counter(), sum(blocks.values())
    for slot, i, k in ideal.walk([0] * len(blocks), 0, total):
        s = ideal.names[i]
        assert had[s] == k
        had[s] += 1
        assert all(abs(had[x] - y) < 1 for x, y in ideal_after(slot + 1, weights, blocks).items())
    assert had == blocks


def test_mixing_keeps_all_rows(spark, monkeypatch):
    monkeypatch.setattr(op06_mixing, "STRETCH", 100)  # several stretches
    rows = [(i, f"t{i}", None, "hot" if i % 3 == 0 else f"s{i % 19}", 2) for i in range(2985)]
    rows += [(3000, "one", None, "tiny", 3)] + [(4000 + i, f"n{i}", None, None, 2) for i in range(14)]
    docs = documents(spark, rows)
    kept = keep_mixed(docs).collect()
    assert Counter(r.doc_id for r in kept) == Counter(r[0] for r in rows)
    out = sorted(mix(docs).collect(), key=lambda r: r.mix_position)
    assert [r.mix_position for r in out] == list(range(len(rows))) and all(r.in_mix for r in out)
    assert [r.source for r in kept] == [r.source for r in out]
    blocks = []
    for r in out:
        if not blocks or r.mix_slot != blocks[-1][0]:
            blocks.append((r.mix_slot, r.mix_source, r.mix_block))
    counts = Counter(r.mix_source for r in out)
    assert [b[0] for b in blocks] == list(range(sum(-(-n // 8) for n in counts.values())))
    had = Counter()
    for _, s, k in blocks:
        assert had[s] == k
        had[s] += 1
    # given weights: rows beyond the mix have a slot all the same
    out = mix(docs, {"hot": 0.5, "s1": 0.25, "": 0.25}).collect()
    assert all((r.mix_slot is not None) == (r.mix_source in ("hot", "s1", "")) for r in out)
    assert 0 < sum(r.in_mix for r in out) < 100
    assert keep_mixed(docs, {"hot": 0.5, "s1": 0.25, "": 0.25}).count() == counts["hot"] + counts["s1"] + counts[""]


def test_given_weights_hold_over_the_whole_length():
    weights = {"a": Fraction(1, 3), "b": Fraction(1, 7), "tiny": Fraction(1, 100000)}
    weights["rest"] = 1 - sum(weights.values())
    ideal = Ideal(weights, {s: 10**9 for s in weights})
    had = [0] * 4
    for slot, i, _ in ideal.walk(had, 0, 250_000):
        if slot % 7 == 0 or ideal.names[i] == "tiny":
            assert all(abs(h - slot * weights[s]) < 1 for h, s in zip(had, ideal.names))
    assert had[ideal.names.index("tiny")] in (2, 3)


def test_mix_holds_weights_that_divide_no_period(spark):
    weights = {"a": 1 / 3, "b": 1 / 7, "tiny": 1e-5}
    weights["rest"] = 1 - sum(weights.values())
    sources = ["a"] * 3000 + ["b"] * 1200 + ["tiny"] * 3 + ["rest"] * 4500
    out = mix(documents(spark, [(i, f"t{i}", None, s, 2) for i, s in enumerate(sources)]), weights, block=1)
    mixed = sorted((r for r in out.collect() if r.in_mix), key=lambda r: r.mix_position)
    assert len(mixed) >= 8390
    had = Counter()
    for n, r in enumerate(mixed, 1):
        had[r.mix_source] += 1
        assert all(abs(had[s] - n * w) < 1 for s, w in weights.items())


def test_clashing_names_and_kept_columns(spark):
    names = ["_at", "_number", "_run", "_order", "_slots", "_starts", "_part", "_p", "_g", "_base", "_first", "_n", "MIX_slot_"]
    docs = documents(spark).withColumns({n: F.lit(777) for n in names})
    out = mix(docs, block=4)
    assert out.select(*names).distinct().collect() == [tuple([777] * len(names))] and out.count() == docs.count()
    plain = {(r.doc_id, r.source, r.mix_position) for r in mix(documents(spark), block=4).collect()}
    assert {(r.doc_id, r.source, r.mix_position) for r in out.collect()} == plain
    assert {(r.doc_id, r.source, r.mix_position) for r in mix(docs, block=4, keep=["doc_id", "source"]).collect()} == plain
    own = documents(spark).withColumns({"mix_slot": F.lit(5), "in_mix": F.lit("x"), "own_mix_slot": F.lit(6)})
    kept = keep_mixed(own)
    assert kept.columns == own.columns and kept.select("mix_slot", "in_mix", "own_mix_slot").distinct().collect() == [(5, "x", 6)]


def test_block_grows_with_the_table():
    assert [block_rows(n, 8, 100) for n in (0, 807, 808, 1615, 1616, 10 ** 6)] == [8, 8, 16, 16, 32, 16384]
