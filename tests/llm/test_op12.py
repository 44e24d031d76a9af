"""Whitening: brute force with exact integers and a Jacobi eigen solver in extended precision."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tandem.llm.op12_whitening import eigenvectors, refine, whiten
from tandem.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n double, v int"


def jacobi(a):
    """All eigenvalues and vectors of a symmetric matrix by cyclic rotations in long double."""
    a = np.array(a, dtype=np.longdouble)
    x = np.eye(len(a), dtype=np.longdouble)
    for _ in range(60):
        if np.sqrt((np.triu(a, 1) ** 2).sum()) <= 1e-19 * np.abs(a).max():
            break
        for p in range(len(a)):
            for q in range(p + 1, len(a)):
                if a[p, q] == 0:
                    continue
                t = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1 if t >= 0 else -1) / (abs(t) + np.sqrt(1 + t * t))
                c = 1 / np.sqrt(1 + t * t)
                g = np.eye(len(a), dtype=np.longdouble)
                g[p, p] = g[q, q] = c
                g[p, q], g[q, p] = c * t, -c * t
                a, x = g.T @ a @ g, x @ g
    return np.diag(a), x


def brute(rows, components=8):
    keep = [(r[0], [float(c) for c in r[1]]) for r in rows
            if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in keep]
    n, dims = len(x), len(x[0])
    total = [sum(v[d] for v in x) for d in range(dims)]
    cov = [[sum((n * v[i] - total[i]) * (n * v[j] - total[j]) for v in x) for j in range(dims)] for i in range(dims)]
    v = np.array([[np.longdouble(Fraction(c, n ** 3).numerator) / np.longdouble(Fraction(c, n ** 3).denominator) for c in line]
                  for line in cov])
    values, vectors = jacobi(v)
    order = np.argsort(-values)[:components]
    trace = np.trace(v)
    out = {}
    for k, at in enumerate(order):
        for (i, _), row in zip(keep, x):
            centred = np.array([np.longdouble(n * c - t) / n for c, t in zip(row, total)])
            out.setdefault(k + 1, []).append((i, n, sum((n * c - t) ** 2 for c, t in zip(row, total)),
                                              float(centred @ vectors[:, at] / np.sqrt(values[at])), float(values[at] / trace)))
    return out


def vectors_of_test(dims=12, count=70):
    rng = np.random.default_rng(4)
    spread = np.geomspace(1, 0.02, dims)
    base = rng.normal(size=(count, dims)) @ np.diag(spread) @ rng.normal(size=(dims, dims)) * 0.2
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1])]                     # repeated rows, a null id
    rows += [(900, None), (901, [None] + rows[0][1][1:]), (902, [math.nan] + rows[0][1][1:]),
             (903, rows[0][1][:-1] + [math.inf]), (904, rows[0][1][:-1]), (905, [])]     # dropped
    return rows


def table(spark, rows):
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(i, v, 1, "c", 2.5, 7) for i, v in rows], SCHEMA).repartition(5)


def test_against_brute_force(spark):
    rows = vectors_of_test()
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 12])
    got = whiten(table(spark, rows)).collect()
    assert len(got) == 73 * 8
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    for k, expected in want.items():
        mine = [r for r in got if r["component"] == k]
        pairs = list(zip(sorted(mine, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0)),
                         sorted(expected, key=lambda r: (r[0] is None, r[0] or 0))))
        sign = 1 if sum(a["whitened"] * b[3] for a, b in pairs) > 0 else -1
        for a, b in pairs:
            assert (a["vec_id"], a["n"], int(a["deviation"])) == b[:3]
            assert abs(sign * a["whitened"] - b[3]) < 1e-11
            assert abs(a["explained"] - b[4]) < 1e-12 * b[4] + 1e-15


def test_partitioning_changes_nothing(spark):
    rows = vectors_of_test()
    first = whiten(table(spark, rows)).select("vec_id", "component", "deviation", "whitened")
    second = whiten(table(spark, rows).coalesce(1)).select("vec_id", "component", "deviation", "whitened")
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


def test_without_variance_and_few_dimensions(spark):
    rows = [(i, [1.0, float(i), 2.0]) for i in range(4)]
    got = whiten(table(spark, rows)).collect()
    assert sorted({r["component"] for r in got}) == [1, 2, 3]
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    assert all(abs(r["whitened"]) < 2 for r in got if r["component"] == 1)
    one = whiten(table(spark, [(1, [0.5, 0.5])])).collect()
    assert [(r["whitened"], r["identity_error"], int(r["deviation"])) for r in one] == [(None, None, 0)] * 2
    assert whiten(table(spark, [(1, None)])).collect() == []
    huge = whiten(table(spark, [(i, [3e38 * (-1) ** i, float(i)]) for i in range(6)])).collect()
    assert len(huge) == 12 and huge[0]["deviation"] is not None


def test_query_casts_deviation(spark):
    df = QUERIES["op12_whitening"][0](spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes)["deviation"] == "bigint" and df.where("deviation is null").isEmpty()


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1, 1, 1, 1, 1], [9, 1 + 3e-9, 1 + 2e-9, 1 + 1e-9, 1], [1e6, 1e6 + 1e-6, 1, 1 + 1e-13, 1e-6], [4, 4, 1, 1, 0]])
def test_clusters(values):
    """Eigenvalues far apart, equal, and in narrow clusters, against rotations in extended precision."""
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(5, 5)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(5, dtype=np.longdouble) - 0.5 * (q.T @ q))  # orthogonal in extended precision
    a = q @ np.diag(np.array(values, dtype=np.longdouble)) @ q.T
    a = (a + a.T) / 2
    found, x = eigenvectors(a)
    top = np.abs(a).max()
    assert np.abs(x.T @ x - np.eye(5)).max() < 1e-17
    assert np.abs(a @ x - x * found).max() < 1e-17 * top
    assert np.abs(np.sort(found) - np.sort(jacobi(a)[0])).max() < 1e-17 * top
    for k, value in enumerate(np.array(values, dtype=float)):   # simple eigenvalues: the vector itself
        gap = min([abs(value - v) for i, v in enumerate(values) if i != k])
        if gap > 1e-10 * top:
            at = int(np.abs(found - np.longdouble(values[k])).argmin())
            assert 1 - abs(q[:, k] @ x[:, at]) < 1e-12


def test_refinement_is_of_second_order():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(40, 40))
    a = (a + a.T).astype(np.longdouble)
    _, rough = np.linalg.eigh(a.astype(np.float32))
    before = np.abs(rough.T.astype(np.longdouble) @ a @ rough - np.diag(np.diag(rough.T @ a @ rough))).max()
    values, x = refine(a, rough, rounds=3)
    assert before > 1e-7 and np.abs(x.T @ a @ x - np.diag(values)).max() < 1e-15
