"""Workers hold a bounded part of a batch besides the batch itself, and give their results out in small batches."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from helpers import prose
from pyspark.sql.types import StructType

from tandem.llm import op05_quality, op08_lines
from tandem.llm import textops as T
from tandem.llm.grouplinks import _explode_diff, _to_centre

ROWS = 1500


@pytest.fixture(scope="module")
def batch():
    rng = random.Random(4)
    pool = [prose(rng, 60).replace("\n", " ") for _ in range(50)]
    texts = ["\n".join(rng.sample(pool, 3)) for _ in range(ROWS - 2)] + [None, ""]
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(ROWS), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["xx"] * ROWS),
        "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})


def rows_of(batches):
    return [r for b in batches for r in b.to_pylist()]


def check(run, batch):
    """Small batches, in the order and with the rows of a run over each row by itself."""
    out = list(run(iter([batch])))
    assert len(out) >= ROWS // T.RUN_ROWS
    single = rows_of(run(batch.slice(i, 1) for i in range(batch.num_rows)))
    assert rows_of(out) == single
    return out


def test_results_go_out_in_small_batches(batch):
    good = check(op05_quality._good(op05_quality.BANDS, None), batch)
    assert max(b.num_rows for b in good) <= T.RUN_ROWS and sum(b.num_rows for b in good) > ROWS // 2

    removed = batch.append_column("removed_lines", pa.array([[0] if i % 3 else None for i in range(ROWS)], pa.list_(pa.int32())))
    assert max(b.num_rows for b in check(op08_lines._digest, removed)) <= T.RUN_ROWS
    schema = StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("n_chars", "long")
    assert max(b.num_rows for b in check(op08_lines._rewrite(schema, "removed_lines"), removed)) <= T.RUN_ROWS

    line = pa.list_(pa.struct([("id", pa.int64()), ("pos", pa.int32())]))
    found = pa.array([[{"id": 3 * i + n, "pos": n} for n in (2, 0)] if i < ROWS - 2 else [] for i in range(ROWS)], line)
    assert sum(b.num_rows for b in check(op08_lines._picked_lines, batch.append_column("found", found))) == 2 * (ROWS - 2)


def test_differences_go_out_in_small_batches():
    rng = random.Random(5)
    tokens = lambda n: b"".join(rng.randrange(1 << 40).to_bytes(8, "little") for _ in range(n))
    beyond = [rng.randint(0, 9) for _ in range(ROWS)]
    longs = {c: pa.array([rng.randrange(99) for _ in range(ROWS)], pa.int64())
             for c in ("p", "x", "n", "s", "lacks", "take", "a", "b", "na", "nb", "dist")}
    batch = pa.RecordBatch.from_pydict(longs | {
        "beyond": pa.array(beyond, pa.int64()), "diff": pa.array([tokens(n + 5) for n in beyond], pa.binary()),
        "linked": pa.array([i % 2 == 0 for i in range(ROWS)]), "use_r": pa.array([i % 5 == 0 for i in range(ROWS)]),
        "gain": pa.array([1 if i % 4 else None for i in range(ROWS)], pa.int64()),
        "loss": pa.array([1 if i % 4 else None for i in range(ROWS)], pa.int64()),
        "moved": pa.array([tokens(2) if i % 4 else None for i in range(ROWS)], pa.binary())})
    check(_explode_diff, batch)
    assert max(b.num_rows for b in check(_to_centre, batch)) <= T.RUN_ROWS


def test_temporary_arrays_are_bounded():
    rng = random.Random(6)
    base = prose(rng, 20000)
    texts = pa.array([base[i % 9000:i % 9000 + 4000] for i in range(0, 700 * 13, 13)])
    op05_quality.base_counts(next(T.slices(texts)))  # what is kept from now on is there
    tracemalloc.start()
    n = sum(len(op05_quality.base_counts(s)["n_words"]) for s in T.slices(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and peak < 24e6


def test_runs_cover_every_row(batch):
    runs = list(T.row_runs([batch, batch.slice(0, 0), batch.slice(7, 300)], 100))
    assert max(r.num_rows for r in runs) == 100
    assert Counter(map(str, rows_of(runs))) == Counter(map(str, rows_of([batch, batch.slice(7, 300)])))
