"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, stored, words_of

#: Sources whose plan is broadcast (about 100 bytes each); with more, the plan is joined by source and bucket of the key.
FEW_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(_src, source_size, target) from (_src, source_size), one row per source.

    Sources in order of `_src` take the weights in turn. `share` times the
    total is dealt by weight; a source never gets more than `max_epochs` times
    its size, and the excess goes to the others by weight until none is above.
    With sources sorted by cap over weight, the water level is the first
    quotient of what is left that no later source's cap is under, so no loop
    is needed. If all caps together are too small, every source gets its cap.
    The two windows order sources, not documents; the order of all sources is
    one task's, with spilling.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    df = sizes.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_src")) - 1)
    df = df.withColumn("_w", w).withColumn("_cap", F.lit(max_epochs) * F.col("source_size"))
    df = df.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.partitionBy(F.lit(0)).orderBy("_ratio", "_src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_total", F.lit(share) * F.sum("source_size").over(everything))
    df = df.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    df = df.withColumn("_at", F.row_number().over(order))
    fits = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_at", "_level"))
    df = df.withColumn("_level", F.min(fits).over(everything)["_level"])
    return df.select("_src", "source_size", F.coalesce(F.least("_cap", F.col("_level") * F.col("_w")), F.col("_cap")).alias("target"))


def mixed(docs: DataFrame, keep: list[str], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The columns `keep` and size, source_size, target, repeats for each row.

    A document's size is its number of words (null: 0). Each source repeats
    all its documents floor(target / size) times; the rest of its target is
    met by one more copy of the documents first in the order of
    md5(seed:doc_id), up to the one whose middle word is past it. So each
    source misses its target by at most half of one document (half of all the
    rows that share one doc_id), and reruns agree. Documents of size 0 take
    whole repetitions only. A null source is a source of its own, last in
    order; a null doc_id counts as the empty text. Empty input: no rows. Long
    texts are counted whole. Columns of `keep` named like a result give way.
    """
    src = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("name"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    results = ["size", "source_size", "target", "repeats"]
    kept = Kept(keep, *results)
    df = docs.select(*kept.columns(), src.alias("_src"), key.alias("_key"), F.size(words_of(F.col("text"))).cast("long").alias("size"))
    # a source's documents are spread over buckets of their key, whose sums are put in order first
    keys = df.groupBy("_src", F.substring("_key", 1, 3).alias("_bucket"), "_key").agg(F.sum("size").alias("_n"))
    keys = stored(keys, "mixing-keys")  # the texts are read for the sizes once, and once for the result
    buckets = keys.groupBy("_src", "_bucket").agg(F.sum("_n").alias("_n"))
    in_order = Window.partitionBy("_src").orderBy("_bucket")
    buckets = buckets.select("_src", "_bucket", (F.sum("_n").over(in_order) - F.col("_n")).alias("_before"))
    sizes = keys.groupBy("_src").agg(F.sum("_n").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("_whole", whole.cast("int")).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    within = Window.partitionBy("_src", "_bucket").orderBy("_key")
    # a source may hold a third of all rows, so nothing is joined by source alone but buckets: few sources are broadcast, many joined by bucket too
    few = keys.select("_src").distinct().limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    small = F.broadcast if few else lambda df: df
    buckets = buckets.join(small(targets.select("_src", "_rest")), "_src")
    placed = keys.withColumn("_upto", F.sum("_n").over(within)).join(buckets, ["_src", "_bucket"])
    extra = placed.where((2 * (F.col("_before") + F.col("_upto")) - F.col("_n") <= 2 * F.col("_rest")) & (F.col("_rest") > 0))
    last = extra.groupBy("_src").agg(F.max("_key").alias("_last"))
    plan = targets.join(last, "_src", "left")
    if few:
        df = df.join(F.broadcast(plan), "_src")
    else:
        df = df.withColumn("_bucket", F.substring("_key", 1, 3)).join(buckets.select("_src", "_bucket").join(plan, "_src"), ["_src", "_bucket"])
    more = ((F.col("size") > 0) & (F.col("_key") <= F.coalesce("_last", F.lit("")))).cast("int")
    return kept.restored(df.withColumn("repeats", F.col("_whole") + more), *results)


MIXED_SQL = r"""
WITH d AS (
  SELECT doc_id, (source IS NULL, coalesce(source, '')) AS src, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS k,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents
), s AS (
  SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src) - 1 AS rk FROM d GROUP BY src
), w AS (
  SELECT *, [3, 1, 2][rk % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / [3, 1, 2][rk % 3 + 1] AS ratio,
         1.5::DOUBLE * sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, src) AS pos,
         (total - coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM w
), level AS (SELECT arg_min(lam, pos) AS lam FROM l WHERE lam <= ratio),
t AS (
  SELECT src, source_size, coalesce(least(cap, level.lam * w), cap) AS target,
         CASE WHEN source_size > 0 THEN floor(coalesce(least(cap, level.lam * w), cap) / source_size) ELSE 0 END AS whole
  FROM l, level
), g AS (
  SELECT src, k, sum(size) AS n FROM d GROUP BY ALL
), c AS (
  SELECT g.*, sum(n) OVER (PARTITION BY src ORDER BY k) AS upto FROM g
), x AS (
  SELECT c.src, max(k) AS last FROM c JOIN t USING (src)
  WHERE 2 * upto - n <= 2 * (target - whole * source_size) AND target - whole * source_size > 0 GROUP BY c.src
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN size > 0 AND k <= coalesce(last, '') THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t USING (src) LEFT JOIN x USING (src)
"""
