import random
import zlib

import numpy as np
from helpers import documents, prose

from tandem.llm.op10_toxicity import (Bag, Model, Scorer, Settings, clean_words, gradients, score, segment_ends, subwords,
                                      train_model)

SMALL = Settings(buckets=1 << 13, max_rows=300)


def made(n, seed=5):
    """Texts of which a third hold words of a hostile stem with endings never seen twice."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randint(5, 250), 150)
        toxic = int(i % 3 == 0)
        if toxic:
            w = text.split(" ")
            for _ in range(max(1, len(w) // 60)):
                w.insert(rng.randrange(len(w)), "vilescum" + "".join(rng.choice("abcdefgh") for _ in range(4)))
            text = " ".join(w)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_on_unseen_spellings(spark):
    rows, labels = made(500)
    rows += [(1000, None, None, None, None), (1001, "", None, None, 0), (None, "vilescum", None, None, 1)]
    given = spark.createDataFrame([(i, 1, t) for i, t in labels] + [(1000, 1, 0), (None, 0, 1)],
                                  "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in score(documents(spark, rows), given, SMALL).collect()}
    assert len(out) == len(rows)
    for i, r in out.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.3)
    held = [(out[i].predicted, t) for i, t in labels if out[i].held_out]
    assert len(held) > 80
    assert sum(p == t for p, t in held) / len(held) >= 0.95
    assert out[1000].predicted == out[1001].predicted == 0


def test_labels_held_out_are_not_learned(spark):
    rows, labels = made(120)
    flipped = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    a = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    b = spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    few = Settings(buckets=1 << 10, epochs=5, max_rows=50)
    assert sorted(map(tuple, score(docs, a, few).collect())) == sorted(map(tuple, score(docs, b, few).collect()))


def test_without_both_classes(spark):
    rows, labels = made(10)
    one = spark.createDataFrame([(i, 1, 0) for i, _ in labels], "doc_id long, quality int, toxic int")
    assert {r.score for r in score(documents(spark, rows), one, SMALL).collect()} == {0.0}
    assert score(documents(spark, []), one, SMALL).collect() == []


def test_subwords_are_ngrams_of_code_points():
    s = Settings()
    words = [b"ab", "né漢".encode(), b"abcdefgh"]
    grams, first = subwords(words, s)
    for i, w in enumerate(words):
        n = len(w.decode()) + 2
        assert first[i + 1] - first[i] == 1 + sum(max(0, n - k + 1) for k in range(3, 7))
    assert (subwords([b"zz", b"ab"], s)[0][-len(grams[:first[1]]):] == grams[:first[1]]).all()


def brute_logit(text, model, s):
    """A text's segment logits, word by word and n-gram by n-gram."""
    words = clean_words(text)
    if not words:
        return []
    vectors = []
    for w in words:
        grams, _ = subwords([w], s)
        vectors.append(np.mean([model.emb[g] for g in grams], axis=0))
    return [float(np.mean(vectors[a:b], axis=0) @ model.out) + model.bias for a, b in zip(*segment_ends(len(words), s))]


def test_gradients_against_differences():
    s = Settings(buckets=64, dim=3, segment=2)
    rng = np.random.default_rng(1)
    texts = ["one two three four", "", "five", "two two six seven eight nine", "ten one"]
    y, weight = np.array([1.0, 0, 0, 1, 0]), np.array([0.3, 0.1, 0.2, 0.3, 0.1])
    model = Model(rng.normal(size=(64, 3)), rng.normal(size=3), 0.2)
    bag = Bag(texts, s)

    def loss(m):
        total = 0.0
        for t, label, w in zip(texts, y, weight):
            z = np.array(brute_logit(t, m, s))
            if len(z):
                e = np.exp(s.sharpness * (z - z.max()))
                p = 1 / (1 + np.exp(-(e / e.sum() * z).sum()))
                total -= w * np.log(p if label else 1 - p)
        return total

    found, emb, out, bias = gradients(bag, y, weight, model, s)
    assert abs(found - loss(model)) < 1e-12
    step = 1e-6
    for i, j in [(int(g), d) for g in bag.grams[:12] for d in range(3)]:
        up, down = (Model(model.emb.copy(), model.out, model.bias) for _ in range(2))
        up.emb[i, j] += step
        down.emb[i, j] -= step
        assert abs((loss(up) - loss(down)) / (2 * step) - emb[i, j]) < 1e-7
    for j in range(3):
        move = np.eye(3)[j] * step
        assert abs((loss(Model(model.emb, model.out + move, 0.2)) - loss(Model(model.emb, model.out - move, 0.2))) / (2 * step)
                   - out[j]) < 1e-7
    assert abs((loss(Model(model.emb, model.out, 0.2 + step)) - loss(Model(model.emb, model.out, 0.2 - step))) / (2 * step)
               - bias) < 1e-7


def test_training_uses_all_dimensions_and_scores_by_brute_force():
    rows, labels = made(200)
    s = Settings(buckets=1 << 11, dim=4, epochs=30)
    model = train_model([r[1] for r in rows], np.array([t for _, t in labels]), s)
    values = np.linalg.svd(model.emb, compute_uv=False)
    assert values[-1] > 0.01 * values[0]
    texts = [r[1] for r in rows[:40]] + [None, "", "word"]
    for text, got in zip(texts, Scorer((model.emb @ model.out, model.bias), s)(texts)):
        z = max(brute_logit(text, model, s), default=model.bias)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9
