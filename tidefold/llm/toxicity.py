"""Toxicity by averaged subword embeddings and a linear softmax.

A word is the mean of the vectors of its character n-grams, a passage the mean
of its words. Vectors and softmax are fitted together in numpy on a bounded
sample of labelled texts: first on whole texts, then on the passages that the
fit so far scores highest in each, since one slur in a long text vanishes in
the mean over all its words. A text is scored by its highest passage. For
scoring, the softmax is folded into the vectors, so that what a word adds to
the log-odds is one number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, frugal, text_slices


@dataclass(frozen=True)
class Shape:
    """What the model and its fit are bounded by."""

    buckets: int = 1 << 18
    dim: int = 4
    n_min: int = 3
    n_max: int = 8
    window: int = 4  # words of a passage
    sample_rows: int = 4000  # labelled texts to fit on, at most half of them of one label
    sample_chars: int = 100_000  # of a longer text, a passage of so many characters is fitted on, at a hashed place (all of it is scored)
    text_epochs: int = 2
    passage_epochs: int = 4
    rounds: int = 2
    rate: float = 0.1
    seed: int = 5


def ngram_buckets(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of each character n-gram of <word>, for all words at once."""
    joined = "".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(joined, "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    rolled, at, out = code.copy(), np.arange(len(code)), []
    prime = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for n in range(2, shape.n_max + 1):
            rolled = rolled[:-1] * prime + code[n - 1 :] if len(rolled) > 1 else rolled[:0]
            if n >= shape.n_min and len(rolled):
                inside = word[at[: len(rolled)]] == word[at[: len(rolled)] + n - 1]
                mixed = (rolled[inside] ^ (rolled[inside] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append((word[: len(rolled)][inside], ((mixed >> np.uint64(40)) % np.uint64(shape.buckets)).astype(np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([w for w, _ in out]), np.concatenate([b for _, b in out])


def bag(text: str | None, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, which sum to 1; both empty if it has no word."""
    counts = Counter((text or "").lower().split())
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    word, bucket = ngram_buckets(list(counts), shape)
    of_word = np.fromiter(counts.values(), float, len(counts)) / sum(counts.values()) / np.maximum(np.bincount(word, minlength=len(counts)), 1)
    weight = np.bincount(bucket, weights=of_word[word], minlength=shape.buckets)
    at = np.flatnonzero(weight)
    return at.astype(np.int32), weight[at].astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, shape: Shape, epochs: int) -> tuple[np.ndarray, float]:
    """(log-odds of each bucket, bias). Adagrad over shuffled mini-batches of the joint softmax loss."""
    rng = np.random.default_rng(shape.seed)
    vectors = rng.normal(0, 0.1, (shape.buckets, shape.dim))
    out = rng.normal(0, 0.1, (shape.dim, 2))
    bias = np.zeros(2)
    sums = [np.full(shape.buckets, 1e-8), np.full(out.shape, 1e-8), np.full(2, 1e-8)]
    used = [i for i in range(len(bags)) if len(bags[i][0])]
    for _ in range(epochs):
        rng.shuffle(used)
        for i in range(0, len(used), 32):
            rows = used[i : i + 32]
            at = np.concatenate([bags[r][0] for r in rows])
            value = np.concatenate([bags[r][1] for r in rows]).astype(float)
            ends = np.cumsum([0, *[len(bags[r][0]) for r in rows]])
            hidden = np.add.reduceat(vectors[at] * value[:, None], ends[:-1])
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            g_out, g_hidden, g_bias = hidden.T @ p, p @ out.T, p.sum(0)
            owner = np.repeat(np.arange(len(rows)), np.diff(ends))
            unique, back = np.unique(at, return_inverse=True)
            g = np.empty((len(unique), shape.dim))
            for k in range(shape.dim):
                g[:, k] = np.bincount(back, weights=g_hidden[owner, k] * value, minlength=len(unique))
            sums[0][unique] += (g**2).mean(1)
            vectors[unique] -= shape.rate * g / np.sqrt(sums[0][unique])[:, None]
            for x, gx, sx in ((out, g_out, sums[1]), (bias, g_bias, sums[2])):
                sx += gx**2
                x -= shape.rate * gx / np.sqrt(sx)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


class Scorer:
    """Highest passages of texts. Keeps the numbers of words it has met, up to a bound."""

    def __init__(self, odds: np.ndarray, shape: Shape, most: int = 600_000) -> None:
        self.odds, self.shape, self.most, self.known = odds, shape, most, {}

    def learn(self, words: list[str]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            word, bucket = ngram_buckets(part, self.shape)
            total = np.bincount(word, weights=self.odds[bucket], minlength=len(part)) / np.maximum(np.bincount(word, minlength=len(part)), 1)
            self.known.update(zip(part, total.tolist(), strict=True))

    def of_words(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [(t or "").lower().split() for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = set().union(*split)
        self.learn(sorted(new))
        return [np.fromiter(map(self.known.__getitem__, w), float, len(w)) for w in split]

    def top(self, odds: np.ndarray) -> tuple[float, int]:
        """Score and place of the highest passage; a shorter text counts as padded by neutral words."""
        k = self.shape.window
        if len(odds) <= k:
            return float(odds.sum()) / k, 0
        sums = np.cumsum(np.concatenate([[0.0], odds]))
        means = (sums[k:] - sums[:-k]) / k
        i = int(means.argmax())
        return float(means[i]), i


@dataclass(frozen=True)
class Model:
    odds: np.ndarray
    slope: float
    offset: float
    share: float
    shape: Shape

    def scores(self, texts: list[str | None], scorer: Scorer) -> list[float]:
        """Probability of label 1; for a text without a word, the share of label 1 in the training rows."""
        out = []
        for odds in scorer.of_words(texts):
            z = self.slope * scorer.top(odds)[0] + self.offset
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))) if len(odds) and self.slope else self.share)
        return out


def parts_of(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to fit on and rows to calibrate on: every fifth, or if a part would lack a label, every fifth of each label. If a label has under five rows, all rows for both; if there is one label only, none."""
    kinds, rows = [np.flatnonzero(labels == y) for y in (0, 1)], np.arange(len(labels))
    if not all(map(len, kinds)):
        return rows[:0], rows[:0]
    if min(map(len, kinds)) < 5:
        return rows, rows
    rest = rows[4::5]
    if len(set(labels[rest].tolist())) < 2 or len(set(np.delete(labels, rest).tolist())) < 2:
        rest = np.sort(np.concatenate([k[4::5] for k in kinds]))
    return np.setdiff1d(rows, rest), rest


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted one-dimensional logistic fit with a light pull to 0 (Newton)."""
    w = np.zeros(2)
    a = np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + 1e-2 * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(texts: list[str], labels: np.ndarray, share: float, shape: Shape = Shape()) -> Model:
    """Fit on four fifths of the sample and calibrate on the rest; `share` is that of label 1 among all labelled rows."""
    labels = np.asarray(labels, np.int64)
    fitted, rest = parts_of(labels)
    if not len(fitted):
        return Model(np.zeros(shape.buckets), 0.0, 0.0, share, shape)
    own = [(texts[i], int(labels[i])) for i in fitted]
    odds, _ = fit([bag(t, shape) for t, _ in own], labels[fitted], shape, shape.text_epochs)
    bags, kind = [], []
    for _ in range(shape.rounds):
        scorer = Scorer(odds, shape)
        for text, label in own:
            words = text.lower().split()
            (each,) = scorer.of_words([text])
            for _ in range(1 if label else 2):  # the highest passages of a clean text are what must not be mistaken
                _, i = scorer.top(each)
                bags.append(bag(" ".join(words[i : i + shape.window]), shape))
                kind.append(label)
                each[i : i + shape.window] = -50
        odds, _ = fit(bags, np.array(kind), shape, shape.passage_epochs)
    scorer = Scorer(odds, shape)
    x = np.array([scorer.top(w)[0] for w in scorer.of_words([texts[i] for i in rest])])
    y = labels[rest].astype(float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    slope, offset = calibrate(x, y, weight)
    return Model(odds, slope, offset, share, shape)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int, chars: int) -> tuple[list[str], np.ndarray, float]:
    """(texts, labels, share of label 1): at most rows / 2 texts of each label, first by hash of their ids.

    `allowed` says of a doc_id whether its label may be used. At most `rows`
    texts reach the driver, one per id (the least of several), and of a text
    of more than `chars` characters a passage at a hashed place. The share
    counts all allowed labels. If an id has several labels the highest holds;
    null ids, null texts and null labels are left out. Where ids turn out to
    have no text, the next ones by hash are asked for.
    """
    own = labels.where(allowed & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull())
    n, ones = own.agg(F.count("*"), F.sum("y")).first()
    own = own.withColumn("h", F.xxhash64("doc_id"))
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - chars, F.lit(0)) + 1)
    text = docs.where(F.col("text").isNotNull()).select("doc_id", F.when(F.length("text") <= chars, F.col("text")).otherwise(F.substring("text", at.cast("int") + 1, F.lit(chars))).alias("text"))
    got, want, after = [], {0: rows // 2, 1: rows // 2}, {0: None, 1: None}
    while any(want.values()):
        picked = []
        for y, most in want.items():
            later = F.lit(True) if after[y] is None else F.struct("h", "doc_id") > F.struct(F.lit(after[y][0]).alias("h"), F.lit(after[y][1]).alias("doc_id"))
            picked += own.where((F.col("y") == y) & later).orderBy("h", "doc_id").limit(most).collect() if most else []
        some = docs.sparkSession.createDataFrame(picked, own.schema)  # at most `rows` ids
        found = text.join(F.broadcast(some), "doc_id").groupBy("h", "doc_id", "y").agg(F.make_valid_utf8(F.min("text")).alias("text")).toArrow().to_pylist()
        got += found
        for y, most in want.items():
            asked = [(r["h"], r["doc_id"]) for r in picked if r["y"] == y]
            want[y] = most - sum(r["y"] == y for r in found) if most and len(asked) == most else 0
            after[y] = max(asked, default=after[y])
    got.sort(key=lambda r: (r["h"], r["doc_id"]))
    return [r["text"] for r in got], np.array([r["y"] for r in got], np.int64), (ones or 0) / n if n else 0.0


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, shape: Shape = Shape()) -> Model:
    """A model from the labels whose ids `allowed` accepts, on a sample that `shape` bounds."""
    return train(*labelled_sample(docs, labels, "toxic", allowed, shape.sample_rows, shape.sample_chars), shape)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row, its score (double, 0 to 1) and judged (boolean).

    Every word of a text counts, however long it is. Null, empty and blank
    texts are not judged and get the share of label 1 among the training rows;
    so does every text where training rows of one label only, or none, were to
    be had. Repeated rows score alike, and nothing but the text counts. An
    empty table gives no rows. Columns of `keep` named like a result give way
    to it; other names clash with nothing.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by shape.buckets
    kept = Kept(keep, "score", "judged")
    keep, schema = kept.inner, docs.select(*kept.columns()).schema.add("score", "double").add("judged", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        own = shared.value
        scorer = Scorer(own.odds, own.shape)
        for b in batches:
            scores, judged = [], []
            for texts in text_slices(b.column(kept.text)):
                scores += own.scores(texts, scorer)
                judged += [bool(own.slope and t and not t.isspace()) for t in texts]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(scores, pa.float64()), pa.array(judged, pa.bool_())], [*keep, "score", "judged"])

    return kept.restored(docs.select(*kept.with_text()).mapInArrow(run, schema), "score", "judged")
