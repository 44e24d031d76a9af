import random
import sys
from collections import Counter
from pathlib import Path

from helpers import documents, fixture_rows, prose, words
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
import test_op04  # noqa: E402
import test_op05  # noqa: E402
import test_op07  # noqa: E402
import test_op08  # noqa: E402

from tandem.llm.op05_quality import judge  # noqa: E402
from tandem.llm.op06_mixing import mix  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def fixture():
    return fixture_rows() + [(1000 + i, t, "xx", f"src{i % 3}", len(t)) for i, t, *_ in test_op08.lines_fixture()]


def pipeline_rows():
    """Enough rows in an unknown language for every source to fill blocks of the mix."""
    rng = random.Random(11)
    return fixture() + [(2000 + i, t, "xx", f"src{i % 3}", len(t)) for i in range(300)
                        for t in [prose(rng, rng.randint(60, 300))]]


def near_copies():
    """Documents of lines that are too far from each other for line dedup and whose shingles are not: every
    line is a piece of one text, cut at other places in each document."""
    rng = random.Random(12)
    plain = ("time year people way day man thing woman life child world school state family student group country problem "
             "hand part place case week company system program question work government number night point home water").split()
    text = [rng.choice(plain) for _ in range(400)]
    out = []
    for i in range(4):
        lines, at = [], 0
        while at < len(text):
            n = rng.randint(9, 30)
            lines.append(" ".join(text[at:at + n]))
            at += n
        out.append((3000 + i, "\n".join(lines), "xx", "src1", 1))
    return out


def folders(spark):
    from pathlib import Path
    from tandem.llm.staging import _folder
    root = Path(_folder(spark).removeprefix("file:"))
    return {p.relative_to(root).parts[0]: None for p in root.rglob("*.parquet")} if root.exists() else {}


def test_staged_tables_go(spark, tmp_path):
    """After each stage only its own staged tables are there, and a second run does not touch the first one's."""
    from tandem.llm.staging import _folder, drop_staged
    drop_staged(spark)
    assert _folder(spark) == _folder(spark)
    docs = documents(spark, pipeline_rows()).select(*COLUMNS)
    seen = []
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        from pathlib import Path
        seen.append({p.name for p in Path(_folder(spark), "pipeline").glob("*")})
    assert seen[0] == set() and all(seen[1:])
    assert all(not a & b for i, a in enumerate(seen) for b in seen[i + 1:])
    drop_staged(spark)
    assert folders(spark) == {}
    documents(spark, pipeline_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.run(spark, str(tmp_path))
    second = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


def test_every_stage_equals_its_brute_force(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]
    raw = documents(spark, pipeline_rows() + near_copies()).select(*COLUMNS)
    at = {}
    docs = raw
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        at[name] = spark.read.parquet(str(tmp_path / name))
        docs = at[name]
    before = rows_of(raw)

    good = rows_of(at["quality_rules"])
    verdict = {(r.doc_id, r.n_words): r.kept for r in judge(raw).collect()}
    want = [r for r in before if verdict[(r[0], len(words(r[1])))]]
    assert Counter(good) == Counter(want) and all(not test_op05.brute(r[1])[-1] for r in good)

    # banding may miss a pair now and then, but nothing else may go
    lined = {r[0]: r for r in rows_of(at["line_dedup"])}
    gone = test_op08.brute(good)
    missed = blank = 0
    for doc, text, lang, source, _ in good:
        lines = text.split("\n")
        full = [x for n, x in enumerate(lines) if n not in gone.get((doc, text), ())]
        if doc not in lined:  # it lost its last word
            assert not words("\n".join(full))
            blank += 1
            continue
        got = lined[doc][1].split("\n") if lined[doc][1] else ([""] if not full else [])
        missed += max(0, len(got) - max(1, len(full)))
        assert lined[doc][2:4] == (lang, source) and lined[doc][4] == len(lined[doc][1])
        assert not Counter(full) - Counter(lined[doc][1].split("\n")) or not lined[doc][1]
    assert missed <= 0.02 * sum(map(len, gone.values())) + 1

    assert blank and all(words(r[1]) for r in lined.values())

    rows = rows_of(at["line_dedup"])
    keep = {doc for doc, n, comp in test_op04.brute(rows, 5, 8, 10) if n == 0 or comp is None or comp == doc}
    assert {r[0] for r in rows_of(at["ngram_jaccard_join"])} == keep
    assert len(keep) < len(rows)

    mixed, unmixed = rows_of(at["mixing"]), rows_of(at["ngram_jaccard_join"])
    assert not Counter(mixed) - Counter(unmixed)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in at["packing"].collect()) == pieces_of(mixed)


def pieces_of(rows):
    return sorted(test_op07.brute(rows, 2048))


def test_sequences_follow_the_mix(spark, tmp_path):
    """Another order of the same rows gives other sequences, numbered by the place of their first piece in the mix."""
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randint(20, 900)), "xx", f"src{0 if i < 240 else 1 if i < 290 else 2}", 1) for i in range(300)]
    docs = documents(spark, rows).select(*COLUMNS)
    place = {r.doc_id: r.mix_position for r in mix(docs).collect()}
    corpus_pipeline.mixing(spark, docs, "").repartitionByRange(5, "doc_id").write.parquet(str(tmp_path / "other"))
    corpus_pipeline.mixing(spark, docs, "").write.option("maxRecordsPerFile", 40).parquet(str(tmp_path / "mixed"))
    numbers = {}
    for name in ("mixed", "other"):
        out = corpus_pipeline.packing(spark, spark.read.parquet(str(tmp_path / name)), "").collect()
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces_of(rows)
        test_op07.check_places(out, 2048)
        numbers[name] = out
    first = {}
    for r in numbers["mixed"]:
        first.setdefault(r.sequence_id, []).append((place[r.doc_id], r.piece))
    assert sorted(first) == list(range(len(first))) and len(first) == len({r.sequence_id for r in numbers["other"]})
    order = [min(first[n]) for n in sorted(first)]
    assert order == sorted(order)
    # within a length as well
    by_length = {}
    for r in numbers["mixed"]:
        by_length.setdefault(r.length, []).append((place[r.doc_id], r.piece))
    assert any(len(x) > 1 for x in by_length.values())
    sequence = lambda out: {(r.doc_id, r.piece): r.sequence_id for r in out}
    assert sequence(numbers["mixed"]) != sequence(numbers["other"])
    # a frame that was not read from files has the order of its partitions
    mixed = sorted(rows, key=lambda r: place[r[0]])
    direct = corpus_pipeline.packing(spark, documents(spark, mixed).select(*COLUMNS), "").collect()
    assert sequence(direct) == sequence(numbers["mixed"])


def test_run_and_registration(spark, tmp_path):
    documents(spark, pipeline_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0 and "sequence_id" in got.columns
    names = corpus_pipeline.registered()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_empty_table(spark, tmp_path):
    documents(spark, []).withColumn("n_chars", F.col("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
