"""SimHash near-duplicates: fingerprints in tasks, links by Burkhard-Keller trees.

Two fingerprints that differ in at most `radius` of 64 bits agree entirely on
one of `radius + 1` blocks of bits, so fingerprints are dealt out by (block,
value) and each such shard gets a tree of its own. Shards are not broadcast,
as their sum grows with the data: each goes to one task by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, components, frugal, local_roots, stored, text_slices

SEED = 42


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks part words
    n = len(words) - width + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        counts += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, fp long): one row per input row; a null text counts as empty."""
    kept = Kept(keep, "fp")
    schema = docs.select(*kept.columns()).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for b in batches:
            fps = np.array([fingerprint(t) for texts in text_slices(b.column(kept.text)) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept.inner], pa.array(fps)], [*kept.inner, "fp"])

    return kept.restored(docs.select(*kept.with_text()).mapInArrow(run, schema), "fp")


def forest_links(shard: np.ndarray, fp: np.ndarray, query: np.ndarray, member: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, root of i) that join the same rows as all pairs within the radius.

    Rows of one `shard` form one tree of those with `member`; rows with
    `query` look up their neighbours in it. All trees grow level by level at
    once: a row moves from node to node along the edge of its distance, and
    the first to arrive where there is no child becomes it. A look-up follows
    only the edges within the radius of its own distance to the node.
    """
    n = len(fp)
    rows = np.flatnonzero(member)
    rows = rows[np.argsort(shard[rows], kind="stable")]
    first = np.ones(len(rows), bool)
    first[1:] = shard[rows[1:]] != shard[rows[:-1]]
    roots = rows[first]
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    node = np.repeat(roots, np.diff(np.append(np.flatnonzero(first), len(rows))))[~first]
    left = rows[~first]
    while len(left):
        d = np.bitwise_count(fp[left] ^ fp[node]).astype(np.int64)
        order = np.lexsort((left, d, node))
        left, node, d = left[order], node[order], d[order]
        new = np.ones(len(left), bool)
        new[1:] = (node[1:] != node[:-1]) | (d[1:] != d[:-1])
        parent[left[new]], edge[left[new]] = node[new], d[new]
        node = np.repeat(left[new], np.diff(np.append(np.flatnonzero(new), len(left))))[~new]
        left = left[~new]
    kids = np.flatnonzero(parent >= 0)
    kids = kids[np.lexsort((edge[kids], parent[kids]))]
    key = parent[kids] * 128 + edge[kids]  # children of a node lie together, in order of their edges
    root_of = dict(zip(shard[roots].tolist(), roots.tolist(), strict=True))
    top = np.array([root_of.get(s, -1) for s in shard.tolist()], np.int64)
    label = np.arange(n)
    asking = np.flatnonzero(query & (top >= 0))
    for i in range(0, len(asking), 2048):
        q = asking[i : i + 2048]
        at = top[q]
        near_q, near = [], []
        while len(q):
            d = np.bitwise_count(fp[q] ^ fp[at]).astype(np.int64)
            hit = (d <= radius) & (q != at)
            near_q.append(q[hit])
            near.append(at[hit])
            lo = np.searchsorted(key, at * 128 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(key, at * 128 + np.minimum(d + radius, 64), "right")
            many = hi - lo
            q = np.repeat(q, many)
            at = kids[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())] if len(q) else q
        label = local_roots(n, np.concatenate(near_q), np.concatenate(near), label)
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def fingerprint_links(fps: DataFrame, radius: int = 4, chunk: int = 20_000, portion: int = 200_000) -> DataFrame:
    """(a, b): links between distinct values of `fp` that give the components of all pairs within the radius.

    A shard of more than `chunk` fingerprints is cut into chunks, and each
    pair of chunks (one as the tree, one to look up) is a shard of its own. A
    task reads its shards in order and holds `portion` rows and one pair of
    chunks at most.
    """
    blocks = radius + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    value = lambda j: F.shiftrightunsigned(F.col("fp"), cuts[j]).bitwiseAND(F.lit((1 << (cuts[j + 1] - cuts[j])) - 1))
    keys = F.array(*[F.struct(F.lit(j).alias("block"), value(j).alias("value")) for j in range(blocks)])
    dealt = fps.select("fp").distinct().select("fp", F.inline(keys))
    sizes = dealt.groupBy("block", "value").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"))
    dealt = dealt.join(sizes, ["block", "value"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least(x, "own").alias("lo"), F.greatest(x, "own").alias("hi")))
    dealt = dealt.select("fp", "block", "value", "own", F.inline(pairs))
    columns = ["block", "value", "lo", "hi"]

    def linked(df: pd.DataFrame) -> pd.DataFrame:
        shard = df.groupby(columns, sort=False).ngroup().to_numpy()
        member, query = (df.own == df.lo).to_numpy(), (df.own == df.hi).to_numpy()
        fp = df.fp.to_numpy().view(np.uint64)
        a, b = forest_links(shard, fp, query, member, radius)
        return pd.DataFrame({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frugal()
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if len(held) >= portion:
                last = (held[columns] == held[columns].iloc[-1]).all(axis=1)  # its shard may go on
                yield linked(held[~last].reset_index(drop=True))
                held = held[last].reset_index(drop=True)
        if held is not None:
            yield linked(held)

    return dealt.repartition(*columns).sortWithinPartitions(*columns).mapInPandas(run, "a long, b long").distinct()


def grouped(docs: DataFrame, keep: list[str], radius: int = 4) -> DataFrame:
    """(keep, fp long, component long, component_id long), one row per input row.

    `component` is a fingerprint that names the component, also where ids are
    null; all else is as in `near_duplicates`. `keep` holds doc_id.
    """
    kept = Kept(keep, "fp", "component", "component_id")
    keep = kept.names
    fps = stored(fingerprints(docs, keep), "fingerprints")
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("_first"))
    found = components(fingerprint_links(fps, radius), "a", "b").withColumnRenamed("node", "fp")
    groups = groups.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # a component may hold a third of all fingerprints: both sides are salted
    least = groups.groupBy("component").agg(F.min("_first").alias("component_id")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(7))))
    named = groups.withColumn("_part", F.pmod(F.xxhash64("fp"), F.lit(8)).cast("int")).join(least, ["component", "_part"]).select("fp", "component", "component_id")
    # equal fingerprints may be a third of all rows, with null ids or one id too: both sides are salted, rows by their place in the stored files
    named = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    fps = fps.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(8)).cast("int"))
    return fps.join(named, ["fp", "_salt"]).select(*[F.col(f"`{c}`") for c in keep], "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, fp long, component_id long), one row per input row.

    component_id is the smallest doc_id reachable by links of at most `radius`
    differing bits; equal fingerprints are linked. Null and empty texts have
    fingerprint 0 and are linked like any other. Rows with a null doc_id take
    part, but never name a component unless it has no other id (then null).
    Rows that share a doc_id are rows of their own. Long texts are read whole.
    An empty table gives no rows; further columns are ignored, whatever their
    names.
    """
    return grouped(docs, ["doc_id"], radius).select("doc_id", "fp", "component_id")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
