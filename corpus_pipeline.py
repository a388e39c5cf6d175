"""A corpus pipeline over `documents`: each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns
of docs, the last one with token ids; `run` writes each result as Parquet in
the shared folder and reads it back; what a stage stores on its way, and its
input, are deleted when its result is written. All stages accept nulls in any
column, empty tables, repeated rows (each is a row of its own unless a stage
says otherwise) and further columns of any name, which they pass on.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm import mixing, pieces, repeats, simhash, toxicity
from tidefold.llm.common import dropped, held_out, scratch, stored


def aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with all but the columns that operators read under other names, and the columns that give the first names back."""
    own = {c: c if c in ("doc_id", "text", "lang", "source", "n_chars") else f"_more{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]), [F.col(n).alias(c) for c, n in own.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents with a toxicity score of 0.3 or more; the model learns from the labels of the documents it gets.

    Texts that no model judges (null, blank, or all where labels of one kind
    are missing) stay. Equal texts stay or go together.
    """
    docs, back = aside(docs)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id"), 4, 2))
    return toxicity.score(docs, model, docs.columns).where((F.col("score") < 0.3) | ~F.col("judged")).select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the row of the least (doc_id, text) stays, null ids last; of rows equal in both, one.

    Texts without a word (null, empty, blank) have the fingerprint zero, so they are one component and one of them stays.
    """
    docs, back = aside(docs)
    # ranked before the shuffle too (a group limit), so that a component of a third of all rows does not gather in one task
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.col("doc_id").asc_nulls_last(), "text"))
    return simhash.grouped(docs, docs.columns).withColumn("_place", place).where(F.col("_place") == 1).select(*back)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 50 bytes or more that also start in a document of smaller doc_id, by whole characters; n_chars follows the text. Null texts stay null, empty texts empty; a text of which nothing is left stays as an empty one."""
    docs, back = aside(docs)
    rest = [c for c in docs.columns if c != "text"]
    df = repeats.removed(docs.withColumn("_none", F.col("text").isNull()), [*rest, "_none"], whole_characters=True)
    df = df.withColumn("text", F.when(~F.col("_none"), F.col("kept").cast("string")))
    if "n_chars" in rest:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be not at all. Rows that share a doc_id are taken equally often."""
    docs, back = aside(docs)
    df = mixing.mixed(docs, docs.columns).where(F.col("repeats") > 0)
    return df.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("_copy")).select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and the piece ids of every text (`ids`, null texts have none) and whether decoding gives the text again (`exact`); columns of these names give way."""
    docs, back = aside(docs)
    back = [c for c, name in zip(back, [f.name for f in docs.select(*back).schema], strict=True) if name not in ("ids", "exact")]
    return pieces.encoded(docs, docs.columns, pieces.load_pieces()).select(*back, "ids", "exact")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("source mixing", mix_sources),
    ("sentencepiece encoding", encode),
]

#: Trained scores, fingerprints and segmentation are beyond SQL.
ORACLE_SQL = None


#: Bytes of rows that travel to a Python worker at a time; Spark's 64 MB take several times as much on both sides.
BATCH_BYTES = "2m"


@contextmanager
def small_batches(spark: SparkSession, size: str = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of about `size` inside the block, of one row at least; afterwards the session's own setting is back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, own)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`. Each is written inside this call, with small Arrow batches, as the rows of a batch may hold long texts."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(), small_batches(spark):
            made = stage(spark, docs, sf_dir)
            docs = stored(made, name.replace(" ", "-"), apart=True)
        if before is not None:
            dropped(before)
        before = docs
    return docs
