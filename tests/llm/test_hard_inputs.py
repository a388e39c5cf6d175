"""Inputs that broke operators before: tiny classes, bytes that are no UTF-8, equal rows by the thousand, lines at the limit."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tidefold.llm import langid, line_rules, pieces, quality_nbsvm, repeats, simhash, toxicity
from tidefold.llm.common import block_of_row, text_slices


def test_tiny_languages_have_dictionaries(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog " * 40, "en"), (2, "ñandú", "es"), (3, "æ", "da"), (4, "", "xx"), (5, None, "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(langid.learn(docs, F.lit(True)).dictionaries) == ["da", "en", "es"]
    assert sorted(langid.learn(docs, F.lit(True), langid.Shape(total_bytes=9)).dictionaries) == ["da", "en", "es"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.learn(docs, F.lit(True)), ["doc_id"], reject=False).collect()}
    assert got[1] == "en" and got[4] == got[5] == "und"


def test_bytes_that_are_no_utf8(spark):
    """They count as U+FFFD wherever Python reads texts."""
    good = [(i, f"some good words number {i} and more of them here") for i in range(6)]
    df = spark.createDataFrame(good, "doc_id long, text string").unionByName(spark.sql("SELECT 99L AS doc_id, CAST(X'61C32062FF20F09F9820636420656667' AS STRING) AS text")).repartition(2).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    assert next(text_slices(pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, 2], np.int32)), pa.py_buffer(b"a\xff")))) == ["a�"]
    for out in (
        pieces.encoded(df, ["doc_id"], pieces.load_pieces()),
        langid.predict(df, langid.learn(df, F.lit(True)), ["doc_id"]),
        toxicity.score(df, toxicity.learn(df, labels, F.lit(True)), ["doc_id"]),
        quality_nbsvm.score(df, quality_nbsvm.learn(df, labels, F.lit(True)), ["doc_id"]),
        simhash.near_duplicates(df),
        repeats.removed(df, ["doc_id"]),
    ):
        assert sorted(r[0] for r in out.select("doc_id").collect()) == [0, 1, 2, 3, 4, 5, 99]


def test_equal_rows_go_to_many_blocks(spark):
    """A third of all rows, equal and without id, are in as many blocks as partitions; op2 and op3 answer all of them."""
    text = "one text that a third of the rows have, without any id, and more than fifty bytes of it"
    rows = [(None, text)] * 300 + [(i, f"{i} {text[: i % 80]} row {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(30).withColumn("lang", F.lit("x")).withColumn("source", F.lit("s"))
    spread = df.where("doc_id IS NULL").groupBy(block_of_row(64).alias("b")).count().collect()
    assert len(spread) > 15 and max(r["count"] for r in spread) < 60
    cut = repeats.removed(df, ["doc_id", "text"], block_bytes=2000).collect()
    assert len(cut) == 900 and {(bytes(r.kept), tuple(map(tuple, r.spans))) for r in cut if r.doc_id is None and r.text == text} and len({bytes(r.kept) for r in cut if r.doc_id is None}) == 1
    ids = pieces.encoded(df, ["doc_id", "text"], pieces.load_pieces(), block_bytes=2000).collect()
    assert len(ids) == 900 and all(r.exact for r in ids) and len({tuple(r.ids) for r in ids if r.doc_id is None}) == 1


def test_ids_shifted_between_units_are_inexact():
    parts = [b"ab", b"cd", b"abc", b"d"]
    units = pa.array([b"ab", b"cd"], pa.binary())
    wrong = lambda ids, ends: pieces.inexact(np.array(ids), np.array(ends), units, parts).tolist()
    assert wrong([0, 1], [0, 1, 2]) == [False, False] and wrong([2, 3], [0, 1, 2]) == [True, True] and wrong([0, 0], [0, 1, 2]) == [False, True]


def test_documents_deplete_at_the_limit(spark):
    """Just below min_left of its word characters a document goes, at it and above it stays; base rules pass all."""
    common = "a line that all of these documents have in common and that is rather long indeed"
    own = lambda k: " ".join(f"w{i:03d}" for i in range(k))  # noqa: E731  4 characters a word
    lost = len(common.replace(" ", ""))
    texts = {0: f"{common}\n{common}\n{common}\n{own(20)}"}
    for i, k in ((1, 59), (2, 60), (3, 61)):
        texts[i] = f"{common}\n{own(k)}"
    left = {i: 1 - t.count(common) * lost / len("".join(t.split())) for i, t in texts.items()}
    filler = {10 + i: f"{common}\n" + " ".join(f"f{i}x{j}" for j in range(70)) for i in range(12)}
    df = spark.createDataFrame(list((texts | filler).items()), "doc_id long, text string").withColumn("source", F.lit("s"))
    for limit in (left[1], left[2], left[3], left[1] + 1e-9, left[2] + 1e-9):
        rows = {r.doc_id: r for r in line_rules.line_verdicts(df, max_docs=10, max_share=0.0, min_left=limit).collect()}
        for i in (1, 2, 3):
            assert not rows[i].base_failed and rows[i].removed_chars == lost and rows[i].kept == (left[i] >= limit - 1e-15), (i, limit)
    default = {r.doc_id: r for r in line_rules.line_verdicts(df, max_docs=10, max_share=0.0).collect()}
    assert left[0] < 0.3 and not default[0].kept and default[3].kept


def test_stages_take_empty_and_very_long_texts(spark):
    """Of the copies one stays, texts of 100,000 characters and more go through, null and empty texts too."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(25_000))
    rows = [(1, long), (2, long), (3, ""), (4, None), (5, long + " tail of its own"), (6, "short one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))
    near = corpus_pipeline.drop_near_copies(spark, df, "")
    assert sorted(r.doc_id for r in near.collect()) == [1, 3, 6]  # empty and null texts are one group, as both have no words
    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, df, "").collect()}
    assert cut[1].text == long and cut[2].text == "" and cut[3].text == "" and cut[4].text is None and cut[5].text in (" tail of its own", "tail of its own", long[-49:] + " tail of its own") and cut[6].n_chars == 9
    ids = {r.doc_id: r for r in corpus_pipeline.encode(spark, df, "").collect()}
    assert all(r.exact for r in ids.values() if r.text is not None) and ids[1].ids == ids[2].ids and ids[3].ids == []
