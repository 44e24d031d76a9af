import zlib

import pytest
from helpers import documents, fixture_rows
from pyspark.sql import functions as F

from tandem.llm import op03_sharding as S


def check(rows, out, shards=8, tolerance=S.TOLERANCE):
    sizes = [len((t or "").encode()) + 1 for _, t, *_ in rows]
    want = sorted(((i, n, zlib.crc32((t or "").encode())) for (i, t, *_), n in zip(rows, sizes)), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=str) == want
    total = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in out:
        total[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    for s in slots:
        assert sorted(s) == list(range(len(s)))
    share = sum(sizes) / shards
    for i, t in enumerate(total):
        assert abs(t - share) <= 2 * (max(sizes) / 2 + 1 + share * tolerance), (i, total)


def test_shards_of_the_fixture(spark):
    check(fixture_rows(), S.shard(documents(spark)).collect())


def test_one_group_of_copies_is_cut(spark):
    rows = [(i % 5, "same text", None, None, 9) for i in range(400)] + [(i, f"t{i}", None, None, 2) for i in range(200)]
    out = S.shard(documents(spark, rows)).collect()
    check(rows, out)
    assert max(sum(r["size"] for r in out if r.shard == s) for s in range(8)) < 700


def test_equal_texts_lie_in_neighbouring_shards(spark):
    out = S.shard(documents(spark)).collect()
    by_text = {}
    for r in out:
        by_text.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert all(len(s) <= 2 for s in by_text.values())


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = [(None, None, None, None, None)] * n
    out = S.shard(documents(spark, rows)).collect()
    assert len(out) == n and all(r["size"] == 1 for r in out)


def test_splitters_are_exact_counts(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("k1"), F.xxhash64("id").alias("k2"), F.col("id").alias("k3"),
                                     (F.col("id") % 50 + 1).alias("size"))
    cuts = S.find_splitters(rows, 8, 0.0005)
    data = sorted((r.k1, r.k2, r.k3, r["size"]) for r in rows.collect())
    total = sum(d[3] for d in data)
    for i, c in enumerate(cuts, 1):
        below = sum(d[3] for d in data if d[:len(c)] < c)
        assert abs(below - total * i / 8) <= max(50, total / 8 * 0.0005)
