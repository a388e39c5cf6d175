"""The stages of the pipeline: no row is lost that a stage does not mean to leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.test_llm import DOCS

corpus_pipeline = pytest.importorskip("corpus_pipeline")
RNG = np.random.default_rng(8)
OWN = [" ".join(f"w{x}" for x in RNG.integers(0, 9999, 60)) for _ in range(30)]
CLASH = ["_first", "_place", "_copy", "_none", "fp", "component", "component_id", "score", "judged", "repeats", "size", "kept", "spans", "_block", "_text", "target", "n_bytes", "_keep0"]


@pytest.fixture(scope="module")
def table(spark):
    """Null ids, one id for different texts, equal rows, null and empty texts, null sources, and columns named like those of the operators."""
    rows = [(None, t, "en", None, None) for t in OWN[:10]]
    rows += [(5, t, None, "a", 7) for t in OWN[10:15]]
    rows += [(i, t, "de", "b", len(t)) for i, t in enumerate(OWN[15:], 100)]
    rows += [(300, OWN[20], "de", "b", 1), (300, OWN[20], "de", "b", 1), (301, None, None, None, None), (302, "", "en", "a", 0), (None, None, None, None, None), (303, " \n", "en", "a", 2)]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def run(spark, name, df):
    out = dict(corpus_pipeline.STAGES)[name](spark, df, DATA)
    return out.columns, out.collect()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_pass_columns_on(spark, table, name):
    columns, rows = run(spark, name, table)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert columns == (table.columns + ["ids", "exact"] if last else table.columns)
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASH)
    assert run(spark, name, table.limit(0))[1] == []


def texts(rows):
    return sorted((str(r.doc_id), str(r.text)) for r in rows)


def test_toxicity_keeps_clean_rows(spark, table):
    assert texts(run(spark, "toxicity", table)[1]) == texts(table.collect())


def test_near_copies_leave_one_of_each(spark, table):
    rows = run(spark, "simhash near-dedup", table)[1]
    assert sorted(r.text for r in rows if r.text and r.text.strip()) == sorted(OWN)
    assert len(rows) == len(OWN) + 1  # null, empty and blank texts are one group
    assert [r.doc_id for r in rows if r.text == OWN[20]] == [105]


def test_repeats_are_cut_once(spark, table):
    rows = run(spark, "suffix-array dedup", table)[1]
    assert len(rows) == table.count() and all((r.text is None) == (r.doc_id in (None, 301) and r.n_chars is None and r.source is None and r.lang is None) for r in rows if r.doc_id == 301)
    assert [r.text for r in rows if r.doc_id == 300] == ["", ""] and [r.text for r in rows if r.doc_id == 105] == [OWN[20]]
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)


def test_mixing_repeats_whole_rows(spark, table):
    rows = run(spark, "source mixing", table)[1]
    kept = {(r.doc_id, r.text) for r in table.collect()}
    assert {(r.doc_id, r.text) for r in rows} <= kept and len(rows) > len(kept)
    assert max(sum(1 for r in rows if (r.doc_id, r.text) == k) for k in kept if k[0] != 300) <= 2


def test_encoding_keeps_every_row(spark, table):
    rows = run(spark, "sentencepiece encoding", table)[1]
    assert texts(rows) == texts(table.collect()) and all(r.exact and (len(r.ids) > 0) == bool(r.text) for r in rows)


def test_whole_run_leaves_one_copy_behind(spark):
    out = corpus_pipeline.run(spark, DATA)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = out.collect()
    assert rows and all(r.exact and r.source == docs[r.doc_id].source and r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "ids", "exact"}


def test_batches_are_small_inside_a_block_only(spark):
    key, longest = "spark.sql.execution.arrow.maxBytesPerBatch", 3_000_000
    own = spark.conf.get(key)
    df = spark.range(0, 400, 1, 1).select(F.when(F.col("id") == 7, F.repeat(F.lit("x"), longest)).otherwise(F.repeat(F.lit("y"), 20_000)).alias("t"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    with pytest.raises(KeyError), corpus_pipeline.small_batches(spark, "1m"):
        got = df.mapInArrow(sizes, "rows long, bytes long").collect()
        raise KeyError
    assert sum(r.rows for r in got) == 400
    assert len(got) > 6 and max(r.bytes for r in got) < longest + 1_100_000
    assert spark.conf.get(key) == own
