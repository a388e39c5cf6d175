"""Embedding near-duplicates by spherical k-means cells.

Vectors are compared only within cells, yet no link is lost: a vector also
visits every other cell whose border it is so near that a linked vector might
lie behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, local_roots, scratch, stored


@dataclass(frozen=True)
class Shape:
    threshold: float = 0.98
    balance: float = 32.0  # a label of n vectors has about sqrt(n / balance) cells: more would mean more visits than they save comparisons
    sample_rows: int = 16  # vectors for each cell that the centroids are fitted on
    sample_bytes: int = 64_000_000  # of all vectors fitted on; where that is not enough, all labels get fewer cells
    max_labels: int = 10_000  # largest labels that have cells of their own; the others are one cell each
    nearest: int = 8  # centroids whose borders are looked at
    passes: int = 8
    chunk: int = 2048  # rows of a cell that one task compares with as many others
    seed: int = 8


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, key, unit): vectors of norm 1 as packed doubles; `key` names equal vectors.

    Vectors that are null, empty, zero or hold null or non-finite components
    are left out, and rows whose label is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, keys, good = [], [], []
            for i, v in enumerate(b.column(2).to_pylist()):
                if not v or any(x is None for x in v):
                    continue
                x = np.array(v, float)
                top = np.abs(x).max()
                if not np.isfinite(top) or top == 0:
                    continue
                x = x + 0.0  # -0.0 equals 0.0
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                x = x / top  # no overflow or underflow in the norm
                units.append((x / np.sqrt(x @ x)).tobytes())
                good.append(i)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "label", "key", "unit"])

    df = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    df = df.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>"))
    return df.mapInArrow(run, "vec_id long, label string, key binary, unit binary")


def spherical_centroids(units: np.ndarray, cells: int, passes: int, seed: int) -> np.ndarray:
    """Spherical k-means: assignment to the greatest dot product, centroids normalised; empty cells keep theirs."""
    rng = np.random.default_rng(seed)
    centre = units[rng.choice(len(units), min(cells, len(units)), replace=False)].copy()
    for _ in range(passes):
        home = (units @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, home, units)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centre)
    return np.unique(centre, axis=0)


def fitted_centroids(reps: DataFrame, shape: Shape) -> dict[tuple[str, int], np.ndarray]:
    """Centroids by label and vector length, fitted on a hashed sample that `shape` bounds. Labels without are one cell."""
    dim = (F.length("unit") / 8).cast("int")
    sizes = reps.groupBy("label", dim.alias("dim")).agg(F.count("*").alias("n")).where(F.col("n") >= 4 * shape.balance).orderBy(F.desc("n"), "label", "dim").limit(shape.max_labels).collect()
    cells = {(r["label"], r["dim"]): np.sqrt(r["n"] / shape.balance) for r in sizes}
    scale = min(1.0, shape.sample_bytes / max(1.0, sum(8 * d * shape.sample_rows * k for (_, d), k in cells.items())))
    cells = {key: int(k * scale) for key, k in cells.items() if int(k * scale) > 1}
    if not cells:
        return {}
    rows = [(r["label"], r["dim"], min(1.0, cells[r["label"], r["dim"]] * shape.sample_rows / r["n"])) for r in sizes if (r["label"], r["dim"]) in cells]
    wanted = reps.sparkSession.createDataFrame(rows, "label string, dim int, portion double")
    h = F.pmod(F.xxhash64("key", "label"), F.lit(1 << 30))
    got = reps.withColumn("dim", dim).join(F.broadcast(wanted), ["label", "dim"]).where(h < F.col("portion") * (1 << 30)).select("label", "dim", "unit").toArrow()
    by: dict[tuple[str, int], list] = {}
    for label, d, u in zip(*[got.column(c).to_pylist() for c in ("label", "dim", "unit")], strict=True):
        by.setdefault((label, d), []).append(np.frombuffer(u))
    return {key: spherical_centroids(np.stack(sorted(v, key=bytes)), cells[key], shape.passes, shape.seed) for key, v in by.items()}


def cells_of(x: np.ndarray, centre: np.ndarray, threshold: float, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each row, and (row, cell) of the other cells it visits.

    A vector y linked to x lies within the chord sqrt(2 - 2t). If y's home is
    c, y is on c's side of the plane between c and any other centroid, so x is
    at most that chord beyond each such plane; the planes to the centroids
    that are nearest to x are looked at. Only cells before the home are
    visited: the pair then meets in the smaller of its two homes, once.
    """
    chord = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    homes, rows, cols = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    span = np.sqrt(np.maximum(0.0, (centre**2).sum(1)[:, None] + (centre**2).sum(1)[None, :] - 2 * centre @ centre.T))
    for i in range(0, len(x), 1024):
        dots = x[i : i + 1024] @ centre.T
        home = dots.argmax(1)
        near = np.arange(len(centre))[None, :] < home[:, None]
        top = np.argpartition(-dots, min(nearest, len(centre)) - 1, axis=1)[:, :nearest]
        for j in range(top.shape[1]):
            near &= np.take_along_axis(dots, top[:, j : j + 1], 1) - dots <= chord * span[top[:, j]] + 1e-9
        r, c = np.nonzero(near)
        homes.append(home)
        rows.append(r + i)
        cols.append(c)
    return np.concatenate(homes), np.concatenate(rows), np.concatenate(cols)


def cell_links(reps: DataFrame, centroids: dict[tuple[str, int], np.ndarray], shape: Shape) -> DataFrame:
    """(rep, links, root): partial counts of linked vectors (copies counted), and a link that joins rep to its block's smallest."""
    shared = reps.sparkSession.sparkContext.broadcast(centroids)  # bounded by shape.sample_bytes

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for (label, dim), part in df.groupby(["label", df.unit.str.len() // 8]):
                x = np.stack([np.frombuffer(u) for u in part.unit])
                centre = shared.value.get((label, int(dim)), np.zeros((1, int(dim))))
                home, row, cell = cells_of(x, centre, shape.threshold, shape.nearest)
                for at, c, own in ((np.arange(len(x)), home, True), (row, cell, False)):
                    out = part.iloc[at][["label", "rep", "copies", "unit"]].copy()
                    out["dim"], out["cell"], out["home"] = int(dim), c, own
                    yield out

    dealt = reps.mapInPandas(assign, "label string, rep long, copies long, unit binary, dim int, cell long, home boolean")
    dealt = stored(dealt, "cells")
    cell = ["label", "dim", "cell"]
    sizes = dealt.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(shape.chunk)).cast("int").alias("chunks"))
    dealt = dealt.join(sizes, cell).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least(x, "own").alias("lo"), F.greatest(x, "own").alias("hi")))
    dealt = dealt.select(*cell, "rep", "copies", "unit", "home", "own", F.inline(pairs))

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("rep", ignore_index=True)
        x = np.stack([np.frombuffer(u) for u in df.unit])
        n, copies, home = len(df), df.copies.to_numpy(), df.home.to_numpy()
        low, high = (df.own == df.lo).to_numpy(), (df.own == df.hi).to_numpy()
        a, b = np.flatnonzero(low), np.flatnonzero(high)
        links, root = np.zeros(n, np.int64), np.arange(n)
        # two visitors meet elsewhere: home rows are compared with all, visitors with home rows
        for own, others in ((a[home[a]], b), (a[~home[a]], b[home[b]])):
            for i in range(0, len(own), 1024):
                rows = own[i : i + 1024]
                hit = x[rows] @ x[others].T >= shape.threshold
                hit &= rows[:, None] != others[None, :]
                links[rows] += hit @ copies[others]
                if df.lo[0] != df.hi[0]:
                    links[others] += hit.T @ copies[rows]
                r, c = np.nonzero(hit)
                root = local_roots(n, rows[r], others[c], root)
        rep = df.rep.to_numpy()
        out = pd.DataFrame({"rep": rep, "links": links, "root": rep[root]})
        return out[(out.links > 0) | (out.root != out.rep)]

    return dealt.groupBy(*cell, "lo", "hi").applyInPandas(compare, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Vectors of equal, non-null label are linked if their cosine in double
    precision reaches the threshold. n_links counts the other vectors linked
    directly, component_id is the smallest vec_id reachable, kept says that it
    is the row's own. Vectors that are null, zero, empty or hold null or
    non-finite components, and rows without label, have no link and are kept.
    Vectors of different lengths are not linked. Equal vectors count as links
    of each other, but only one of them is compared with others. Rows that
    repeat a vec_id count as vectors of their own. Rows with a null vec_id
    take part, but name a component only if it has no other id (then null;
    its rows, as others that share the component's id, are all kept). An empty
    table gives no rows; further columns are ignored, whatever their names.
    """
    units = stored(unit_vectors(vectors), "units")
    reps = units.groupBy("label", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")  # vec_id is no key; rep is fixed by the files
    with scratch():
        links = stored(cell_links(reps, fitted_centroids(reps, shape), shape), "cell-links", apart=True)
    counts = links.groupBy("rep").agg(F.sum("links").alias("n_links"))
    found = components(links.where(F.col("root") != F.col("rep")), "rep", "root")
    reps = reps.join(counts, "rep", "left").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    reps = reps.withColumn("component", F.coalesce("component", "rep"))
    reps = reps.join(reps.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    reps = reps.select("label", "key", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # a vector may be that of a third of all rows: both sides are salted
    reps = reps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    named = units.select("vec_id", "label", "key", F.pmod(F.monotonically_increasing_id(), F.lit(8)).cast("int").alias("salt"))
    named = named.join(reps, ["label", "key", "salt"]).select("vec_id", "n_links", "component_id")
    # the rest: what unit_vectors leaves out, row by row
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(usable & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rest = vectors.where(~usable).select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return named.unionByName(rest).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
