"""The classifiers against plain loops, what they may learn from, and the odd cases."""

import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.test_llm import ODD, docs
from tidefold.llm import langid, quality_nbsvm, toxicity
from tidefold.llm.common import held_out

LONG = "lorem ipsum dolor " * 9000  # 162,000 characters
M64 = (1 << 64) - 1


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


# --- language --------------------------------------------------------------


def test_language_is_one_dictionary_at_a_time(spark, real):
    model = langid.learn(real, ~held_out(F.col("doc_id"), 4, 2))
    rows = [r for r in langid.predict(real, model, ["text"], reject=False).collect() if r.text and any(map(str.isalpha, r.text))]
    assert len(rows) > 150
    for r in rows[:60]:
        raw = langid.plain(r.text)
        sizes = {}
        for lang, data in model.dictionaries.items():
            size = 0
            for i in range(0, len(raw), model.shape.piece):
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters.from_level(model.shape.level, source_size=model.shape.piece, dict_size=len(data), min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False)
                size += len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(raw[i : i + model.shape.piece]))
            sizes[lang] = size
        best = min(sizes, key=sizes.get)  # of ties the first, which has more rows
        others = [s for k, s in sizes.items() if k != best]
        assert r.lang_pred == best and r.margin == (min(others) - sizes[best]) / min(others)
        assert r.score == pytest.approx(1 / sum(np.exp(-min((s - sizes[best]) * model.shape.certainty, 60)) for s in sizes.values()))


def test_every_language_has_a_dictionary(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of language number "), F.col("id") % 300).alias("text"), F.concat(F.lit("l"), F.col("id") % 300).alias("lang"))
    model = langid.learn(many, F.lit(True), langid.Shape(total_bytes=30_000))
    assert len(model.dictionaries) == 300 and max(map(len, model.dictionaries.values())) <= 100


def test_language_learns_from_allowed_rows_only(spark, real):
    out = held_out(F.col("doc_id"), 4, 2)
    other = real.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert langid.learn(real, ~out) == langid.learn(other, ~out)


def test_language_odd_tables(spark, real):
    model = langid.learn(real, ~held_out(F.col("doc_id"), 4, 2))
    df = docs(spark, [*ODD, LONG, LONG]).withColumn("margin", F.lit("clash"))
    rows = langid.predict(df, model, [c for c in df.columns if c != "lang"], reject=False).collect()
    assert len(rows) == len(ODD) + 2 and rows[-1].lang_pred == rows[-2].lang_pred
    assert all(r.text == t for r, t in zip(sorted(rows, key=lambda r: r.doc_id), [*ODD, LONG, LONG], strict=True))
    assert langid.predict(df.limit(0), model, ["doc_id"]).count() == 0


# --- toxicity ----------------------------------------------------------------


def plain_buckets(word, shape):
    """Hash of each character n-gram of <word>, one at a time."""
    code, out = [ord(c) for c in f"<{word}>"], []
    for n in range(shape.n_min, shape.n_max + 1):
        for i in range(len(code) - n + 1):
            h = code[i]
            for c in code[i + 1 : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + c) & M64
            h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & M64
            out.append((h >> 40) % shape.buckets)
    return out


def test_toxicity_is_a_plain_loop(spark, real, labels):
    model = toxicity.learn(real, labels, ~held_out(F.col("doc_id"), 4, 2))
    shape = model.shape
    for text in ("one two two", "é 漢字", "a"):
        expected, words = {}, text.lower().split()
        for w in words:
            own = plain_buckets(w, shape)
            for b in own:
                expected[b] = expected.get(b, 0) + 1 / len(own) / len(words)
        at, weight = toxicity.bag(text, shape)
        assert dict(zip(at.tolist(), weight.tolist(), strict=True)) == pytest.approx(expected)
    rows = toxicity.score(real, model, ["text"]).collect()
    for r in rows[:25]:
        odds = [np.mean([model.odds[b] for b in plain_buckets(w, shape)]) for w in (r.text or "").lower().split()]
        if not odds:
            assert r.score == model.share and not r.judged
            continue
        k = shape.window
        best = sum(odds) / k if len(odds) <= k else max(sum(odds[i : i + k]) / k for i in range(len(odds) - k + 1))
        z = model.slope * best + model.offset
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), rel=1e-6, abs=1e-9)


# --- quality -----------------------------------------------------------------


def test_quality_is_dense_algebra(spark, real, labels):
    shape = quality_nbsvm.Shape(bits=12)
    model = quality_nbsvm.learn(real, labels, ~held_out(F.col("doc_id"), 5, 0), shape)
    mask = (1 << shape.bits) - 1

    def plain(text):
        words, found = (text or "").split(), set()
        mixed = lambda x: (((x & M64) * 0x9E3779B97F4A7C15 & M64) >> 40) & mask
        for kind, of in enumerate((str.lower, quality_nbsvm.shape_of)):
            h = [zlib.crc32(of(w).encode("utf-8", "surrogatepass")) for w in words]
            found |= {mixed(x + (kind << 33)) for x in h}
            same = [a == b for a, b in zip(h, h[1:], strict=False)]
            for a, b, s in zip(h, h[1:], same, strict=False):
                found.add(mixed((1 if s and kind == 0 else a * 31 + b + 7) + (kind << 33)))
            if kind == 0 and any(a and b for a, b in zip(same, same[1:], strict=False)):
                found.add(mixed(2))
        return sorted(found)

    grams = quality_nbsvm.Grams(shape.bits)
    texts = [r.text for r in real.limit(40).collect()] + ["a a a a", "A b A b", None, "x"]
    features = [grams(t) for t in texts]
    assert [f.tolist() for f in features] == [plain(t) for t in texts]
    y = np.arange(len(texts)) % 2
    dense = np.zeros((len(texts), 1 << shape.bits))
    for i, f in enumerate(features):
        dense[i, f] = 1
    counts = [1 + dense[y == k].sum(0) for k in (0, 1)]
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    assert np.allclose(quality_nbsvm.log_count_ratio(features, y, 1 << shape.bits, 1.0), ratio)
    for r in quality_nbsvm.score(real, model, ["text"]).collect()[:40]:
        x = np.zeros(1 << shape.bits)
        x[plain(r.text)] = 1
        z = model.slope * (x @ model.weights + model.bias) / max(1.0, np.sqrt(x.sum())) + model.offset
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))) if x.any() else model.share)


# --- both --------------------------------------------------------------------


@pytest.mark.parametrize(("kind", "label", "modulus", "rest"), [(toxicity, "toxic", 4, 2), (quality_nbsvm, "quality", 5, 0)])
def test_scores_learn_from_allowed_labels_only(spark, real, labels, kind, label, modulus, rest):
    out = held_out(F.col("doc_id"), modulus, rest)
    model = kind.learn(real, labels, ~out)
    other = kind.learn(real.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label))), ~out)
    assert [r.score for r in kind.score(real, model, []).collect()] == [r.score for r in kind.score(real, other, []).collect()]
    df = docs(spark, [*ODD, LONG, LONG])
    rows = sorted(kind.score(df, model, df.columns).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in rows] == [*ODD, LONG, LONG] and rows[-1].score == rows[-2].score
    assert kind.score(df.limit(0), model, ["doc_id"]).count() == 0


def test_samples(spark):
    df = spark.createDataFrame([(i, None if i < 50 else f"t{i} " + "x" * (300 if i == 60 else 3)) for i in range(100)] + [(70, "a"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (71, None)], "doc_id long, toxic int")
    texts, y, share = toxicity.labelled_sample(df, labels, "toxic", F.lit(True), 1000, 100)
    assert len(texts) == 50 and y.sum() == 25 and share == 0.5 and "a" in texts and max(map(len, texts)) == 100
    texts, y, _ = toxicity.labelled_sample(df, labels, "toxic", F.lit(True), 20, 100)
    assert len(texts) == 20 and y.sum() == 10  # ids without a text do not shrink the sample


def test_calibration_rows_are_of_both_labels():
    fitted, rest = toxicity.parts_of(np.array([0] * 50 + [1] * 5))
    assert len(rest) == 11 and 54 in rest and not set(fitted) & set(rest)
    assert [len(x) for x in toxicity.parts_of(np.array([0] * 50 + [1] * 2))] == [52, 52]
    assert [len(x) for x in toxicity.parts_of(np.array([1] * 5))] == [0, 0]
