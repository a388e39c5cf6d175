"""Quality rules on words and lines, with line frequencies across documents.

Built-in DataFrame functions only: word and window rules are evaluated inside
each row; what crosses documents is a count per (host, line hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, words_of

SALTS = 16
BLANKS = " \t\n\x0b\x0c\r"


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Number of words inside windows of `width` words that occur twice or more in the array.

    Windows are compared by the 64-bit hash of their words. Sorting the
    (hash, start) pairs brings equal windows together; starts with an equal
    neighbour are then put in order and their spans added up without overlap.
    """
    n = F.size(words) - (width - 1)

    def spans(keyed: Column) -> Column:
        # two windows in a row of equal hash: both starts are hits
        same = lambda x, k: (x["h"] == F.get(keyed, k - 1)["h"]) | (x["h"] == F.get(keyed, k + 1)["h"])
        hits = F.transform(F.filter(keyed, same), lambda x: x["i"])
        zero = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("at"))
        return F.aggregate(F.sort_array(hits), zero, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["at"])).alias("n"), i.alias("at")), lambda acc: acc["n"])

    def count(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_named(keyed, spans))

    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(n < 2, F.lit(0)).otherwise(_named(hashes, count)).cast("long")


def _named(value: Column, use) -> Column:
    """use(value), with the value computed once and not again wherever `use` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def lines_of(text: Column) -> Column:
    """The \\n-split lines that have a word; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_hash(line: Column) -> Column:
    """Hash of a line with A-Z lowered, separators collapsed and the ends trimmed."""
    return F.xxhash64(F.trim(F.regexp_replace(ascii_lower(line), SPACE, " ")))


def base_rules(docs: DataFrame, *cols: str | Column) -> DataFrame:
    """doc_id, `cols` and the counts of the word rules, one row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", *cols, text.alias("_text")).withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", lines_of(F.col("_text")))
    return df.select(
        *[c for c in df.columns if c not in ("_text", "_words", "_lines")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("_words")).alias("n_repeat_words"),
    )


def line_sums(text: Column) -> Column:
    """Array of (hash, n) of a text's distinct normalised lines, n being the word characters of all occurrences. Lines that are equal once normalised have as many each."""
    each = F.sort_array(F.transform(lines_of(text), lambda x: F.struct(line_hash(x).alias("hash"), F.length(F.translate(x, BLANKS, "")).cast("long").alias("n"))))

    def sums(pairs: Column) -> Column:
        # places where a run of equal hashes begins; how far it is to the next tells how often the line occurs
        first = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: (i == 0) | (F.get(pairs, i)["hash"] != F.get(pairs, i - 1)["hash"]))
        run = lambda at: F.transform(at, lambda i, k: F.struct(F.get(pairs, i)["hash"].alias("hash"), (F.get(pairs, i)["n"] * (F.coalesce(F.get(at, k + 1), F.size(pairs)) - i)).alias("n")))
        return F.when(F.size(pairs) > 0, _named(first, run))

    return _named(each, sums)


def common_lines(docs: DataFrame, host: str, max_docs: int, max_share: float) -> DataFrame:
    """(_doc, _copy, _host, _hash, _n): the lines to be removed from each document, once for all equal rows.

    A row is known by doc_id, host and a hash of its text (_copy), so rows
    that repeat all three count once and rows that share a doc_id only each
    lose their own lines.
    """
    rows = docs.select("doc_id", copy_of().alias("_copy"), host_of(host).alias("_host"), F.explode(line_sums(F.col("text"))).alias("_line"))
    # the condition, which always holds, is what Spark would else add to one of the uses below only
    rows = rows.select("doc_id", "_copy", "_host", F.col("_line.hash").alias("_hash"), F.col("_line.n").alias("_n")).where(F.col("_hash").isNotNull())
    # one row per document and line; the document is part of the key, so no line gathers in one task
    lines = rows.groupBy("doc_id", "_host", "_hash", "_copy").agg(F.max("_n").alias("_n"))
    # both uses read the same columns (a line has a word, so _n is above 0), so the explosion and its shuffle are done once
    documents = lines.groupBy("doc_id", "_host", "_hash").agg(F.max("_n").alias("_n"), F.max("_copy").alias("_copy"))
    counts = documents.groupBy("_host", "_hash").agg(F.count("*").alias("_docs"), F.max("_n").alias("_n"), F.max("_copy").alias("_copy"))
    counts = counts.where((F.col("_docs") > max_docs) & (F.col("_n") > 0) & F.col("_copy").isNotNull())
    sizes = docs.groupBy(host_of(host).alias("_host")).agg(F.count("*").alias("_rows"))
    counts = counts.join(sizes, "_host").where(F.col("_docs") > F.lit(max_share) * F.col("_rows")).select("_host", "_hash")
    # the few common lines are repeated over salts, so that a line of a third of all documents joins in SALTS tasks
    counts = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # the salt takes _n in, so that the join stays above the aggregation and both uses share it
    salted = lines.withColumn("_salt", F.xxhash64("_copy", "_n").bitwiseAND(F.lit(SALTS - 1)).cast("int"))
    return salted.join(counts, ["_host", "_hash", "_salt"], "left_semi").select(F.col("doc_id").alias("_doc"), "_copy", "_host", "_hash", "_n")


def copy_of() -> Column:
    """Names a text among those of a doc_id: a hash of both."""
    return F.xxhash64("doc_id", "text", F.col("text").isNull())


def host_of(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit(""))


def line_verdicts(docs: DataFrame, host: str = "source", max_docs: int = 50, max_share: float = 0.001, min_left: float = 0.3, with_text: bool = False) -> DataFrame:
    """Apply the base rules and the cross-document line rule.

    A line is normalised (A-Z lowered, separators collapsed, trimmed) and
    hashed; lines found in more than `max_docs` distinct documents of the same
    host, and in more than `max_share` of its rows, are removed from all of
    them, every occurrence. A document is rejected if less than `min_left` of
    its word characters is left, or if the base rules reject it. Frequencies
    count all documents, also rejected ones.

    Result, one row per input row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, removed_chars (long), base_failed, kept
    (boolean), and with `with_text` cleaned (string): the text without those
    lines. Null text: as empty, thus base_failed (cleaned stays null). Null
    hosts form one host. Rows that share a doc_id count as one document and
    each lose their own lines; so do all rows with a null doc_id. An empty
    table gives no rows. Long texts are taken whole. Extra columns are
    ignored, whatever their names.
    """
    text = [F.col("text").alias("_whole")] if with_text else []
    base = base_rules(docs, host_of(host).alias("_host"), copy_of().alias("_copy"), *text)
    lost = common_lines(docs, host, max_docs, max_share).groupBy("_doc", "_copy", "_host")
    lost = lost.agg(F.sum("_n").alias("_lost"), *([F.collect_set("_hash").alias("_gone")] if with_text else []))
    lost = lost.select("_doc", "_lost", F.col("_copy").alias("_lost_copy"), F.col("_host").alias("_lost_host"), *(["_gone"] if with_text else []))
    df = base.join(lost, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_copy") == F.col("_lost_copy")) & (F.col("_host") == F.col("_lost_host")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed = F.coalesce("_lost", F.lit(0)).cast("long")
    wordless = lambda x: ~x.rlike(r"[^\x20\x09-\x0D]")
    left = F.filter(F.split("_whole", "\n"), lambda x: wordless(x) | ~F.array_contains("_gone", line_hash(x)))
    cleaned = [F.when(F.col("_gone").isNull(), F.col("_whole")).otherwise(F.array_join(left, "\n")).alias("cleaned")] if with_text else []
    return df.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        removed.alias("removed_chars"),
        failed.alias("base_failed"),
        (~failed & ((F.col("word_chars") - removed) >= F.lit(min_left) * F.col("word_chars"))).alias("kept"),
        *cleaned,
    )


LINE_VERDICTS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT r, i, w[i:i+2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), ln AS (
  SELECT r, doc_id, host,
         trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
         length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS n
  FROM (SELECT r, doc_id, host, unnest(lines) AS l FROM d)
), sizes AS (
  SELECT host, count(*) AS n_rows FROM d GROUP BY host
), common AS (
  SELECT host, norm FROM ln JOIN sizes USING (host) GROUP BY host, norm, n_rows
  HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) > 50 AND count(DISTINCT coalesce(doc_id::VARCHAR, '')) > 0.001::DOUBLE * n_rows
), lost AS (
  SELECT r, sum(n) AS n FROM ln SEMI JOIN common USING (host, norm) GROUP BY r
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost.n, 0)::BIGINT AS removed_chars
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars - removed_chars >= 0.3::DOUBLE * word_chars AS kept
FROM counted
"""
