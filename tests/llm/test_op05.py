import math
import re
from collections import Counter

from helpers import documents, fixture_rows, words

from tandem.llm.op05_quality import BANDS, judge, keep_good, vocabulary_path


def brute(text):
    w = words(text)
    text = text or ""
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)


def test_base_equals_brute_force(spark):
    rows = fixture_rows() + [(200, "a b #|\na b #|\r\n\n a b #|\na b #|", "en", "s", 0)]
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in judge(documents(spark, rows)).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)


def test_measures_equal_the_vocabulary(spark):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(None))
    langs = {i: lang for i, _, lang, *_ in fixture_rows()}
    texts = {i: t for i, t, *_ in fixture_rows() if i is not None}
    for r in judge(documents(spark)).where("doc_id is not null").collect():
        ids = [x for w in words(texts[r.doc_id]) for x in model.encode(w)]
        if not ids:
            assert not r.kept
            continue
        n, counts = len(ids), Counter(ids)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) / max(1.0, math.log2(n))
        assert math.isclose(r.chars_per_token, r.word_chars / n)
        assert math.isclose(r.byte_share, sum(model.IsByte(i) or model.IsUnknown(i) for i in ids) / n, abs_tol=1e-12)
        assert math.isclose(r.token_entropy, entropy, abs_tol=1e-9)
        assert math.isclose(r.top_share, max(counts.values()) / n)
        lang = langs[r.doc_id]
        m = (r.chars_per_token, r.byte_share, r.token_entropy, r.top_share)
        assert r.kept == (not r.base_failed and BANDS[lang if lang in BANDS else r.script].accepts(r.n_words, m))


def test_keep_good_keeps_rows_whole(spark):
    docs = documents(spark)
    kept = sorted((str(tuple(r)) for r in keep_good(docs).collect()))
    good = Counter(r.doc_id for r in judge(docs).collect() if r.kept)
    assert Counter(r.doc_id for r in keep_good(docs).collect()) == good
    assert set(kept) <= {str(tuple(r)) for r in docs.collect()}
    assert keep_good(documents(spark, [])).columns == docs.columns
