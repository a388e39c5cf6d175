"""Quality by a linear support vector machine on naive Bayes features.

A text is the set of its hashed unigrams and bigrams, of words and of word
shapes, with a mark where a word follows itself; each is scaled by the log
ratio of its smoothed frequencies in the two classes. The linear hinge-loss
model over them is fitted by dual coordinate descent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, frugal, text_slices
from .toxicity import calibrate, labelled_sample, parts_of


@dataclass(frozen=True)
class Shape:
    """What the model and its fit are bounded by."""

    bits: int = 18
    smoothing: float = 1.0
    cost: float = 1.0
    passes: int = 15
    sample_rows: int = 4000  # labelled texts to fit on, at most half of them of one label
    sample_chars: int = 100_000  # of a longer text, a passage of so many characters is fitted on, at a hashed place (all of it is scored)
    seed: int = 6


class Grams:
    """Indicator features of texts; keeps the hashes of words it has met, up to a bound."""

    def __init__(self, bits: int, most: int = 600_000) -> None:
        self.mask, self.most, self.known = np.uint64((1 << bits) - 1), most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct feature numbers of a text."""
        words = (text or "").split()
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) > self.most:
                known.clear()
                new = set(words)
            known.update((w, zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) | zlib.crc32(shape_of(w).encode("utf-8", "surrogatepass")) << 32) for w in new)
        both = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        out = []
        for kind, h in enumerate((both & np.uint64(0xFFFFFFFF), both >> np.uint64(32))):
            pair = h[:-1] * np.uint64(31) + h[1:] + np.uint64(7)
            same = h[:-1] == h[1:]
            if kind == 0:  # that a word follows itself, once and twice, whatever the word
                pair[same] = 1
                out.append(np.full(min(1, int((same[:-1] & same[1:]).sum())), 2, np.uint64))
            out += [h + np.uint64(kind << 33), pair + np.uint64(kind << 33)]
        mixed = (np.concatenate(out) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        return np.unique(mixed & self.mask).astype(np.int64)


def shape_of(word: str) -> str:
    """Runs of upper-case, lower-case and other letters and of digits as A, a, o and 0; other characters as they are, runs as two."""
    kind = lambda c: ("A" if c.isupper() else "a" if c.islower() else "o") if c.isalpha() else "0" if c.isdigit() else c
    out = ""
    for c in map(kind, word):
        if not out.endswith(c) or c not in "Aao0" and not out.endswith(c + c):
            out += c
    return out


def log_count_ratio(features: list[np.ndarray], labels: np.ndarray, size: int, smoothing: float) -> np.ndarray:
    """log of the smoothed share of each feature in class 1 over that in class 0."""
    shares = []
    for y in (1, 0):
        rows = [f for f, own in zip(features, labels, strict=True) if own == y]
        count = smoothing + np.bincount(np.concatenate([np.zeros(0, np.int64), *rows]), minlength=size)
        shares.append(count / count.sum())
    return np.log(shares[0] / shares[1])


def dual_coordinate_descent(features: list[np.ndarray], scale: np.ndarray, labels: np.ndarray, cost: np.ndarray, passes: int, seed: int) -> tuple[np.ndarray, float]:
    """(weights, bias) of the L2-regularised hinge loss; `cost` bounds each row's dual variable.

    A row's values are scale[feature], and 1 for the bias. Stops when no
    projected gradient of a pass exceeds 0.01.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    values = [scale[f] for f in features]
    norm = [float(v @ v) + 1.0 for v in values]
    alpha, w, bias = np.zeros(len(features)), np.zeros(len(scale)), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(features)):
            f, v, s = features[i], values[i], sign[i]
            grad = s * (float(w[f] @ v) + bias) - 1
            low, high = alpha[i] <= 0, alpha[i] >= cost[i]
            worst = max(worst, abs(min(grad, 0) if low else max(grad, 0) if high else grad))
            new = min(max(alpha[i] - grad / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * s
                w[f] += step * v  # features of a row are distinct
                bias += step
                alpha[i] = new
        if worst < 0.01:
            break
    return w, bias


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    share: float
    shape: Shape

    def margin(self, features: np.ndarray) -> float:
        """Distance per root of features, so that long texts are not surer by length alone."""
        return float(self.weights[features].sum() + self.bias) / max(1.0, np.sqrt(len(features)))

    def score(self, features: np.ndarray) -> float:
        z = self.slope * self.margin(features) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))) if len(features) and self.slope else self.share


def train(texts: list[str], labels: np.ndarray, share: float, shape: Shape = Shape()) -> Model:
    """Fit on four fifths of the sample and calibrate on the rest; `share` is that of label 1 among all labelled rows."""
    size = 1 << shape.bits
    labels = np.asarray(labels, np.int64)
    fitted, rest = parts_of(labels)
    if not len(fitted):
        return Model(np.zeros(size), 0.0, 0.0, 0.0, share, shape)
    grams = Grams(shape.bits)
    features = [grams(t) for t in texts]
    own, y = [features[i] for i in fitted], labels[fitted]
    ratio = log_count_ratio(own, y, size, shape.smoothing)
    cost = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) * shape.cost
    w, bias = dual_coordinate_descent(own, ratio, y, cost, shape.passes, shape.seed)
    raw = Model(w * ratio, bias, 1.0, 0.0, share, shape)
    x = np.array([raw.margin(features[i]) for i in rest])
    y = labels[rest].astype(float)
    slope, offset = calibrate(x, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return Model(w * ratio, bias, slope, offset, share, shape)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, shape: Shape = Shape()) -> Model:
    """A model from the labels whose ids `allowed` accepts, on a sample that `shape` bounds."""
    return train(*labelled_sample(docs, labels, "quality", allowed, shape.sample_rows, shape.sample_chars), shape)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row and its score (double, 0 to 1).

    All words of a text count, however long it is. Null, empty and blank texts
    get the share of label 1 among the training rows; so does every text where
    training rows of one label only, or none, were to be had. Repeated rows
    score alike, and nothing but the text counts. An empty table gives no
    rows. Columns of `keep` named like a result give way to it; other names
    clash with nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by shape.bits
    kept = Kept(keep, "score")
    keep, schema = kept.inner, docs.select(*kept.columns()).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        grams, own = Grams(shared.value.shape.bits), shared.value
        for b in batches:
            scores = pa.array([own.score(grams(t)) for texts in text_slices(b.column(kept.text)) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], scores], [*keep, "score"])

    return kept.restored(docs.select(*kept.with_text()).mapInArrow(run, schema), "score")
