"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, words_of


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import formatted, linear_replies, loss_text, read_back

    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, i, role, tricky) for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # longer answers count more; a chain has but one path
    df = formatted(linear_replies(turns), F.length("text"))
    df = df.withColumn("back", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("mask")))
    plain = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return df.select(
        F.when(~F.col("tree.none"), F.col("tree.id")).alias("conv_id"),
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import removed

    df = removed(_read(spark, sf_dir, "documents"), ["doc_id"])
    return df.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encoded, load_pieces

    df = encoded(_read(spark, sf_dir, "documents"), ["doc_id"], load_pieces())
    return df.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "exact")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import learn, predict

    docs = _read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    # `und` is reserved here, so a narrow lead is told and not rejected
    return predict(docs, learn(docs, ~out), ["doc_id"], reject=False).select("doc_id", out.alias("held_out"), "lang_pred", "score", "margin", "narrow")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs, out = _read(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 4, 2)
    scored = score(docs, learn(docs, _read(spark, sf_dir, "labels"), ~out), ["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_nbsvm import learn, score

    docs, out = _read(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    scored = score(docs, learn(docs, _read(spark, sf_dir, "labels"), ~out), ["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_rules import line_verdicts

    return line_verdicts(_read(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    df = mixed(_read(spark, sf_dir, "documents"), ["doc_id"])
    return df.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex16, near_duplicates

    df = near_duplicates(_read(spark, sf_dir, "documents"))
    return df.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    df = whitened(_read(spark, sf_dir, "embeddings"), ["vec_id"])
    df = df.select("vec_id", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    return df.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error")


def _looped(docs: DataFrame) -> DataFrame:
    """docs of which a tenth, by crc32 of the id (null: of the empty text), go round in a loop from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    df = docs.select("doc_id", "text", h.alias("h"), words_of(F.col("text")).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    looped = F.array_join(F.concat(F.slice("w", F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return df.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), looped).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs

    df = periodic_runs(_looped(_read(spark, sf_dir, "documents")), ["doc_id"])
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    longer = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)  # noqa: E731  runs come by start, then period
    best = F.aggregate("runs", F.try_element_at("runs", F.lit(1)), longer)
    df = df.select("doc_id", "runs", best.alias("best"), "collapsed")
    return df.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import load, token_counts

    df = token_counts(_read(spark, sf_dir, "documents"), ["doc_id"], load())
    return df.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .line_rules import LINE_VERDICTS_SQL
    from .mixing import MIXED_SQL

    from .chat import FORMATTED_SQL

    return {"op1_chat_format": FORMATTED_SQL, "op7_quality_rules": LINE_VERDICTS_SQL, "op9_mixing": MIXED_SQL}
