"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of sample texts; a
text belongs to the language whose dictionary lets it become smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, frugal, text_slices

UNKNOWN = "und"
#: ASCII characters that say nothing of the language are left out, in texts and dictionaries.
PLAIN = str.maketrans("", "", "".join(c for c in map(chr, range(128)) if not c.isalpha() and not c.isspace() and c != "'"))


def plain(text: str) -> bytes:
    return text.lower().translate(PLAIN).encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class Shape:
    """What the dictionaries are bounded by."""

    dictionary_bytes: int = 100_000
    total_bytes: int = 64_000_000  # of all dictionaries; with more languages than fit, each gets a smaller one
    sample_rows: int = 400  # texts per language
    excerpt: int = 1500  # characters taken of each sample text, at a hashed place (texts to be classified are taken whole)
    level: int = 6
    piece: int = 4096  # bytes that are compressed at once, so that the dictionary stays in reach in long texts
    certainty: float = 0.5  # weight of a byte in the score


@dataclass(frozen=True)
class Model:
    dictionaries: dict[str, bytes]  # by language, most frequent first
    shape: Shape = field(default_factory=Shape)


class Classifier:
    def __init__(self, model: Model) -> None:
        self.shape, self.langs, self.packers = model.shape, list(model.dictionaries), []
        for data in model.dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(self.shape.level, source_size=self.shape.piece, dict_size=len(data), min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False)
            d.precompute_compress(compression_params=how)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of a text by language."""
        raw = plain(text)
        pieces = [raw[i : i + self.shape.piece] for i in range(0, len(raw), self.shape.piece)]
        return [sum(len(p.compress(x)) for x in pieces) for p in self.packers]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): the score is a soft share of the smallest size, the margin the relative lead over the next."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        sizes = np.array(self.sizes(text), float)
        best = int(sizes.argmin())  # ties: the language with more training rows
        score = 1 / np.exp(-np.minimum((sizes - sizes[best]) * self.shape.certainty, 60)).sum()
        others = np.delete(sizes, best)
        margin = float((others.min() - sizes[best]) / others.min()) if len(others) else 1.0
        return self.langs[best], float(score), margin


def learn(docs: DataFrame, allowed: Column, shape: Shape = Shape()) -> Model:
    """Dictionaries from the rows that `allowed` accepts, with non-null text and lang.

    Per language, the texts that are first by hash of id and text reach the
    driver as excerpts, `sample_rows` at most. They are joined with the most
    telling part (the first excerpts by hash) last, where zstandard finds
    matches cheapest; the last `dictionary_bytes` of that are used, which is
    some 70 excerpts. Every language has a dictionary, however little text it
    has, but one whose texts are all empty. No rows: an empty
    model, which answers `und`. Repeated rows count once in a dictionary.
    """
    df = docs.where(allowed & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = df.groupBy("lang").count()
    langs = [r["lang"] for r in counts.orderBy(F.desc("count"), "lang").collect()]
    size = max(8, min(shape.dictionary_bytes, shape.total_bytes // max(1, len(langs))))
    key = F.xxhash64("doc_id", "text")
    at = F.pmod(F.col("h"), F.greatest(F.length("text") - shape.excerpt, F.lit(0)) + 1).cast("int")
    df = df.withColumn("h", key)
    # of a frequent language, rows beyond four times the sample by hash are left out first, so that it is not ranked in one task
    portion = F.least(F.lit(1.0), F.lit(4.0 * shape.sample_rows) / F.col("count"))
    df = df.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 30)) < portion * (1 << 30))  # one row per language
    df = df.select("lang", "h", F.make_valid_utf8(F.substring("text", at + 1, F.lit(min(shape.excerpt, max(1, size))))).alias("excerpt"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "excerpt"))
    got = df.withColumn("rank", rank).where(F.col("rank") <= shape.sample_rows).select("lang", "h", "excerpt").toArrow().to_pylist()
    got.sort(key=lambda r: (r["h"], r["excerpt"]))
    own: dict[str, list] = {}
    for r in reversed(got):
        own.setdefault(r["lang"], []).append(plain(r["excerpt"]))
    found = {lang: b"\n".join(dict.fromkeys(own.get(lang, ())))[-size:] for lang in langs}
    # a dictionary has 8 bytes at least, so what is shorter is repeated
    return Model({k: v * -(-8 // len(v)) for k, v in found.items() if v}, shape)


def predict(docs: DataFrame, model: Model, keep: list[str], min_margin: float = 0.01, reject: bool = True) -> DataFrame:
    """The columns `keep` of every row and lang_pred, score, margin, narrow.

    `narrow` says that the lead is below `min_margin`; such a text is rejected
    (lang_pred `und`) unless `reject` is off. Null texts and texts
    without a letter are `und` with score 0. Whole texts are compressed, in
    pieces, however long they are. Ties go to the language with more training
    rows. Repeated rows get equal answers, and nothing but the text counts. An
    empty table gives no rows. Columns of `keep` named like a result give way
    to it; other names clash with nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by shape.total_bytes
    results = ["lang_pred", "score", "margin", "narrow"]
    kept = Kept(keep, *results)
    keep = kept.inner
    schema = docs.select(*kept.columns()).schema.add("lang_pred", "string").add("score", "double").add("margin", "double").add("narrow", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        classify = Classifier(shared.value)
        for b in batches:
            lang, score, margin, narrow = [], [], [], []
            for text in (t for texts in text_slices(b.column(kept.text)) for t in texts):
                found, s, m = classify(text)
                narrow.append(found != UNKNOWN and m < min_margin)
                lang.append(UNKNOWN if narrow[-1] and reject else found)
                score.append(s)
                margin.append(m)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(narrow, pa.bool_())], [*keep, "lang_pred", "score", "margin", "narrow"])

    return kept.restored(docs.select(*kept.with_text()).mapInArrow(run, schema), *results)
