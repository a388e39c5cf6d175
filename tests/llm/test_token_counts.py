"""Token counts against the library's encoding of whole texts."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from tidefold.llm import queries
from tidefold.llm.token_counts import Shape, Units, load, token_counts

ODD = [
    None, "", " ", "\n\n  \n", "one", "it's we're 'r 'll", "é ü 漢字 😀 ▁ \x00 end" * 30, "a" * 3000, "ab " * 900, " " * 900 + "x", ("x" + " " * 37) * 40,
    "<|endoftext|>", ("word  <|endoftext|>  " * 90), ("  <|endoftext|>" * 100), "<|endof" * 200, "don't you're  they'll\n\n" * 60, "١٢٣ 456 " * 120, "漢字" * 700, "tie", "tie",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return lambda text: len(t.encode(text or "", add_special_tokens=False))


@pytest.mark.parametrize("shape", [Shape(), Shape(64, 16, 2), Shape(100, 40, 8, 1), Shape(257, 64, 3)])
def test_pieces_give_the_librarys_counts(spark, library, shape):
    """Small strides cut words, contractions, white space and special tokens; words longer than a stride widen the overlap."""
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, digest string")
    for c in ("n_tokens", "piece", "number", "_text", "_bytes"):
        df = df.withColumn(c, F.lit(7))
    got = {r.doc_id: r for r in token_counts(df, ["doc_id", "digest", "_text", "n_tokens"], load(), shape).collect()}
    assert {i: (r.n_bytes, r.n_tokens, r.digest, r["_text"]) for i, r in got.items()} == {i: (len((t or "").encode()), library(t), "clash", 7) for i, t in enumerate(ODD)}


def test_hot_long_text_and_repeats(spark, library):
    """A third of the rows is one long text, with null ids; it is cut into pieces once."""
    text = "an odd sentence of some words, " * 400
    df = spark.createDataFrame([(None, text)] * 40 + [(i, f"{i} {text[: i * 9]}") for i in range(80)], "doc_id long, text string")
    got = token_counts(df, ["doc_id"], load(), Shape(512, 64)).collect()
    assert len(got) == 120 and {r.n_tokens for r in got if r.doc_id is None} == {library(text)}
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id is not None} == {i: library(f"{i} {text[: i * 9]}") for i in range(80)}


@pytest.mark.parametrize("most", [300_000, 5])
def test_units_give_the_librarys_counts(library, most):
    """White space of all kinds beside a space, at both ends, special tokens, contractions; repeated units are encoded once."""
    blanks = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\u200b", "\ufeff", "\u180e"]
    texts = [t or "" for t in ODD] + [f"{a}w{b} {c}x y{d}" for w in blanks for a, b, c, d in ((w, "", "", ""), ("", w, "", ""), ("", "", w, ""), ("", "", "", w), (w, w, w, w))]
    texts += [" a", "a ", "a b c a b", "it 's we 're", "x <|endoftext|> y <|endoftext|>z", "1 23 4a é ü 漢 字 😀 .", "a\nb c\nd"]
    units = Units(load(), most)
    for _ in range(2):
        assert units(texts).tolist() == [library(t) for t in texts]
    asked = []
    own, units = Units(load()), None
    encoded = own.encoded
    own.encoded = lambda u: asked.extend(u) or encoded(u)
    own(["one two two", "one two three"]), own(["one three four"])
    assert sorted(asked) == [" four", " three", " two", "one"]


def test_bad_bytes_empty_table_and_other_tokenizers(spark, library):
    df = spark.sql("SELECT 1 AS doc_id, CAST(X'61FF20C3' AS STRING) AS text")
    assert token_counts(df, ["doc_id"], load()).first()[1:] == (4, library("a� �"))
    assert token_counts(df.limit(0), ["doc_id"], load()).count() == 0
    with pytest.raises(ValueError, match="byte-level"):
        load(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op13_token_counts(spark, DATA).collect():
        assert (r.n_bytes, r.n_tokens) == (len((texts[r.doc_id] or "").encode()), library(texts[r.doc_id])) and r.over_limit == (r.n_tokens > 1024)
