"""Toxicity by subword-bag embeddings and a linear softmax (operator 10).

A word is the mean of the embeddings of its character n-grams (hashed into a
fixed number of buckets, word marks included), a segment of a text the mean of
its words, and a linear softmax over the segment's vector gives its logit. A text
is as toxic as its worst segment, so one phrase in a long text is learned and
found. Misspelt and unseen words share n-gram vectors with known ones.

Embeddings and softmax start as small random vectors and are trained jointly in numpy: gradient
steps with momentum on the logistic loss of the soft maximum over segments. (One mean over a whole
text instead of its worst segment was tried as well: one phrase in 400 words is lost in it, see README.)

Training takes at most ``max_rows`` labelled rows of each class (a documented
bound: those with the least hash of their id), whole texts, in one task; the
labels come only from rows with crc32(doc_id as text) mod 4 <> 2. Scoring covers
every row in one pass without a shuffle; the broadcast model has a fixed size
(``buckets`` numbers, since softmax and embeddings multiply out to one number a
bucket).

Defined cases: null and empty texts get the score of a text without any word
(the bias alone); null ids are never learned from and held_out is false; repeated
rows score alike; without labels of both classes every score is 0. Memory of a task
is a few dozen times the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm import textops as T

THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dim: int = 8
    shortest: int = 3
    longest: int = 6
    segment: int = 3       # words of a segment; segments overlap by half or more
    start: float = 0.1     # standard deviation of the embeddings at the start
    sharpness: float = 4.0  # of the soft maximum over segments
    toxic_weight: float = 0.6  # share of the toxic class in the loss
    epochs: int = 100
    rate: float = 2.0      # largest move of an embedding in a step
    max_rows: int = 1500   # labelled rows of each class, at most
    seed: int = 7


def subwords(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, first n-gram of every word): byte n-grams of <word>
    that begin at a code point, from ``shortest`` to ``longest`` code points, and the word itself."""
    text = b"".join(b"<" + w + b">" for w in words)
    data = np.frombuffer(text, dtype=np.uint8)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    begin = np.r_[0, np.cumsum(size)]
    heads = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]  # first byte of every code point
    head_of = np.searchsorted(heads, begin)                          # code points before each word
    own = np.repeat(np.arange(len(words)), np.diff(head_of))
    left = head_of[1:][own] - np.arange(len(own))
    starts, ends, owner = [begin[:-1]], [begin[1:]], [np.arange(len(words))]
    for n in range(s.shortest, s.longest + 1):
        at = np.flatnonzero(left >= n)
        starts.append(heads[at])
        ends.append(heads[at + n])
        owner.append(own[at])
    owner = np.concatenate(owner)
    bucket = (T.byte_hashes(data, np.concatenate(starts), np.concatenate(ends))
              % np.uint64(s.buckets)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]


def clean_words(text: str | None) -> list[bytes]:
    """Lower-cased words without the punctuation around them."""
    return [w for w in (x.strip(b".,;:!?\"'()[]{}|*%$&#<>-_/\\") for x in (text or "").lower().encode().split()) if w]


def segment_ends(n: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the overlapping segments of n words; the last one ends with the text."""
    step = max(1, s.segment // 2)
    starts = np.arange(0, max(1, n - step), step)
    return starts, np.minimum(starts + s.segment, n)


class Bag:
    """Texts as word numbers, segments and the n-grams of the vocabulary."""

    def __init__(self, texts: list[str | None], s: Settings):
        names: dict[bytes, int] = {}
        numbers, starts, ends, first, size = [], [], [], [0], []
        base = 0
        for t in texts:
            ws = clean_words(t)
            numbers.append(np.fromiter((names.setdefault(w, len(names)) for w in ws), np.int64, len(ws)))
            a, b = segment_ends(len(ws), s) if ws else (np.zeros(0, np.int64),) * 2
            starts.append(a + base)
            ends.append(b + base)
            base += len(ws)
            size.append(len(ws))
            first.append(first[-1] + len(a))
        self.words = np.concatenate(numbers)
        self.text_of_word = np.repeat(np.arange(len(texts)), size)
        self.starts, self.ends = (np.concatenate(x).astype(np.int64) for x in (starts, ends))
        self.first = np.array(first)
        self.size = np.maximum(self.ends - self.starts, 1)
        self.grams, self.gram_first = subwords(list(names), s)
        self.per_word = np.diff(self.gram_first)

    def word_means(self, table: np.ndarray) -> np.ndarray:
        """Mean row of every word's n-grams, one dimension at a time to bound memory."""
        return np.stack([np.add.reduceat(table[:, d][self.grams], self.gram_first[:-1]) / self.per_word
                         for d in range(table.shape[1])], axis=1)

    def segment_means(self, per_word: np.ndarray) -> np.ndarray:
        total = np.r_[0.0, np.cumsum(per_word[self.words])]
        return (total[self.ends] - total[self.starts]) / self.size


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class _Steps:
    """Gradient steps with momentum, scaled by the largest entry of the gradient."""

    def __init__(self, rate: float):
        self.rate, self.mean, self.top, self.t = rate, 0.0, 0.0, 0

    def __call__(self, grad):
        self.t += 1
        self.mean = 0.9 * self.mean + 0.1 * grad
        self.top = 0.9 * self.top + 0.1 * float(np.max(np.abs(grad))) ** 2
        fresh = 1 - 0.9 ** self.t
        return self.rate * (self.mean / fresh) / ((self.top / fresh) ** 0.5 + 1e-9)


@dataclass
class Model:
    """Embeddings (buckets x dim), the difference of the two softmax rows, and its bias."""
    emb: np.ndarray
    out: np.ndarray
    bias: float

    @classmethod
    def start(cls, s: Settings) -> Model:
        rng = np.random.default_rng(s.seed)
        out = rng.normal(0, 1, s.dim)
        return cls(rng.normal(0, s.start, (s.buckets, s.dim)), out / np.linalg.norm(out), -1.0)


def gradients(bag: Bag, y: np.ndarray, weight: np.ndarray, model: Model, s: Settings):
    """(loss, gradients of the embeddings by bucket and dimension, of the softmax row, of the bias)."""
    n = len(y)
    have = np.diff(bag.first) > 0
    doc_of = T.owners(bag.first)
    vectors = bag.word_means(model.emb)
    z = bag.segment_means(vectors @ model.out) + model.bias
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc_of, z)
    e = np.exp(s.sharpness * (z - top[doc_of]))
    share = e / np.bincount(doc_of, e, minlength=n)[doc_of]
    doc_z = np.bincount(doc_of, share * z, minlength=n)
    p = np.clip(_sigmoid(doc_z), 1e-15, 1 - 1e-15)
    loss = -(weight * np.where(y > 0, np.log(p), np.log(1 - p)))[have].sum()
    grad_doc = np.where(have, weight * (_sigmoid(doc_z) - y), 0.0)[doc_of]
    # the soft maximum's weights move with the logits too
    grad_z = grad_doc * share * (1 + s.sharpness * (z - doc_z[doc_of]))
    edge = np.zeros(len(bag.words) + 1)
    np.add.at(edge, bag.starts, grad_z / bag.size)
    np.add.at(edge, bag.ends, -grad_z / bag.size)
    grad_word = np.bincount(bag.words, np.cumsum(edge)[:-1], minlength=len(bag.per_word))
    grad_gram = np.bincount(bag.grams, np.repeat(grad_word / bag.per_word, bag.per_word), minlength=s.buckets)
    return loss, grad_gram[:, None] * model.out[None, :], grad_word @ vectors, float(grad_z.sum())


def train_model(texts: list[str], labels: np.ndarray, s: Settings) -> Model:
    """Embeddings and softmax, trained jointly from small random vectors."""
    y = labels.astype(float)
    sizes = ((y == 0).sum(), (y > 0).sum())
    bag, model = Bag(texts, s), Model.start(s)
    if not len(bag.words):
        return Model(np.zeros_like(model.emb), model.out, 0.0)
    weight = np.where(y > 0, s.toxic_weight / sizes[1], (1 - s.toxic_weight) / sizes[0])
    move_emb, move_out, move_bias = _Steps(s.rate), _Steps(0.3 * s.rate), _Steps(0.3 * s.rate)
    for _ in range(s.epochs):
        _, emb, out, bias = gradients(bag, y, weight, model, s)
        model.emb -= move_emb(emb)
        model.out -= move_out(out)
        model.bias -= float(move_bias(bias))
    return model


def train(texts: list[str], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """(one number per bucket, bias): embeddings x (toxic - clean softmax weights)."""
    model = train_model(texts, labels, s)
    return model.emb @ model.out, float(model.bias)


class Scorer:
    """Scores whole texts; the numbers of known words are kept in a bounded cache."""

    def __init__(self, model: tuple[np.ndarray, float], s: Settings, limit: int = 1_000_000):
        self.table, self.bias = model
        self.settings, self.limit = s, limit
        self.cache: dict[bytes, float] = {}

    def __call__(self, texts: list[str | None]) -> list[float]:
        words = [clean_words(t) for t in texts]
        if len(self.cache) > self.limit:
            self.cache.clear()
        new = list({w for ws in words for w in ws if w not in self.cache})
        if new:
            grams, first = subwords(new, self.settings)
            mean = np.add.reduceat(self.table[grams], first[:-1]) / np.diff(first)
            self.cache.update(zip(new, mean.tolist()))
        out = []
        for ws in words:
            if not ws:
                out.append(float(_sigmoid(self.bias)))
                continue
            v = np.r_[0.0, np.cumsum(np.fromiter(map(self.cache.__getitem__, ws), float, len(ws)))]
            a, b = segment_ends(len(ws), self.settings)
            out.append(float(_sigmoid(((v[b] - v[a]) / (b - a)).max() + self.bias)))
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, float] | None:
    """Train on a bounded sample of the labelled rows that are not held out; None without both classes.

    The sample meets in one task, which returns the model: one number per bucket and the bias.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    parts = []
    for value in (1, 0):
        # the bound is a TopK: each partition keeps max_rows rows at most
        ids = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
        texts = docs.select("doc_id", "text").where("text is not null").join(ids, "doc_id")
        parts.append(texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(settings.max_rows)
                     .select("text", "toxic"))

    def run(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: (-r["toxic"], r["text"]))  # the same sum order in every attempt
        y = np.array([r["toxic"] for r in rows])
        if 0 < y.sum() < len(y):
            table, bias = train([r["text"] for r in rows], y, settings)
            yield pa.RecordBatch.from_pydict({"bias": [bias], "weights": [table.astype("<f8").tobytes()]})

    model = parts[0].unionByName(parts[1]).coalesce(1).mapInArrow(run, "bias double, weights binary").collect()
    return (np.frombuffer(model[0]["weights"], dtype="<f8"), model[0]["bias"]) if model else None


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(),
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(docs, labels, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value, settings) if shared.value is not None else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                texts = rows.column("text").to_pylist()
                scores = scorer(texts) if scorer else [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores, pa.float64())],
                                                 names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
