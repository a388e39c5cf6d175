"""One deep forest over all rows: large nodes from histograms, small ones each in one task.

Deep in a tree there are as many nodes as rows, and a histogram of each of
them from every task is many times the input. So only nodes of more than
`small` rows are split by sums over all tasks. The rows of every other node
are brought together once, in one task a node, which grows what is below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .trees import Shape, bin_edges

#: 100 trees of depth 20, of which each leaf has five training rows.
DEEP = Shape(trees=100, depth=20, bins=32, least=5)

#: Distribution of a Poisson number with mean 1: how often a row is drawn.
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7]))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 hashed bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(h: np.ndarray, tree: int, bootstrap: bool) -> np.ndarray:
    """How often a tree draws each row, from the row's hash."""
    if not bootstrap:
        return np.ones(len(h), np.int64)
    u = mixed(h.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (tree + 1) % (1 << 64))) >> np.uint64(11)
    return np.searchsorted(POISSON, u / float(1 << 53), side="right")


def lots(seed: int, tree: int, node: np.ndarray, d: int, few: int) -> np.ndarray:
    """The features that each node tries, in rising order."""
    if few >= d:
        return np.tile(np.arange(d), (len(node), 1))
    start = mixed(mixed(np.array([(seed << 20) + tree], np.uint64)) + node.astype(np.uint64))
    ranks = mixed(start[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, d + 1, dtype=np.uint64))
    return np.sort(np.argsort(ranks, axis=1, kind="stable")[:, :few], axis=1)


def histograms(slot: np.ndarray, nodes: int, bins: np.ndarray, tried: np.ndarray, w: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """(2, nodes, tried features, bins): drawn rows and those of label 1."""
    few = tried.shape[1]
    own = np.take_along_axis(bins, tried[slot], axis=1)
    cell = ((slot[:, None] * few + np.arange(few)) * width + own).ravel()
    size = nodes * few * width
    return np.stack([np.bincount(cell, np.repeat(v, few), size) for v in (w, w * y)]).reshape(2, nodes, few, width)


def best_splits(hist: np.ndarray, tried: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """Of each node: feature (-1: no split), the last bin that goes left, rows on both sides, share of label 1.

    The largest gain wins, ties go to the lower feature, then the lower bin.
    """
    n, g = hist.cumsum(axis=-1)
    h, s = n[..., -1:], g[..., -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g * g / n + (s - g) ** 2 / (h - n) - s * s / h
        share = (s / h)[:, 0, 0]
    gain = np.round(np.where((n >= least) & (h - n >= least), gain, -1.0), 9).reshape(len(hist[0]), -1)
    at = gain.argmax(axis=1)
    k, split = np.arange(len(at)), gain[np.arange(len(at)), at] > 1e-9
    feature, left = tried[k, at // n.shape[-1]], n.reshape(len(at), -1)[k, at]
    return {"feature": np.where(split, feature, -1), "bin": at % n.shape[-1], "left": left, "right": h[:, 0, 0] - left, "share": share}


@dataclass
class Top:
    """The large nodes of all trees, level by level: key (tree * 2^40 + node, in order), feature (-1: a leaf), bin, share."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def descend(self, tree: int, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node that each row gets to, its share if it is a leaf, else NaN)."""
        node, share = np.ones(len(bins), np.int64), np.full(len(bins), np.nan)
        on = np.arange(len(bins))
        for key, feature, last, value in self.levels:
            own = (tree << 40) + node[on]
            at = np.minimum(np.searchsorted(key, own), len(key) - 1)
            on, at = on[key[at] == own], at[key[at] == own]
            leaf = feature[at] < 0
            share[on[leaf]] = value[at[leaf]]
            on, at = on[~leaf], at[~leaf]
            node[on] = 2 * node[on] + (bins[on, feature[at]] > last[at])
        return node, share


def finished(node: int, tree: int, bins: np.ndarray, y: np.ndarray, w: np.ndarray, test: np.ndarray, shape: Shape, few: int) -> np.ndarray:
    """Shares of label 1 that the tree below a node gives to test rows, grown level by level from the node's training rows."""
    share = np.full(len(test), np.nan)
    row_slot, test_slot = np.zeros(len(y), np.int64), np.zeros(len(test), np.int64)
    rows, tests, nodes = np.arange(len(y)), np.arange(len(test)), np.array([node], np.int64)
    for level in range(node.bit_length() - 1, shape.depth + 1):
        tried = lots(shape.seed, tree, nodes, bins.shape[1], few)
        found = best_splits(histograms(row_slot, len(nodes), bins[rows], tried, w[rows], y[rows], shape.bins), tried, shape.least)
        split = (found["feature"] >= 0) & (level < shape.depth)
        on = split[test_slot]
        share[tests[~on]] = found["share"][test_slot[~on]]
        tests, test_slot = tests[on], test_slot[on]
        if not len(tests):
            break
        # a node that no test row reaches is not grown further
        wanted = 2 * test_slot + (test[tests, found["feature"][test_slot]] > found["bin"][test_slot])
        own = split[row_slot]
        rows, row_slot = rows[own], row_slot[own]
        side = 2 * row_slot + (bins[rows, found["feature"][row_slot]] > found["bin"][row_slot])
        kids, test_slot = np.unique(wanted, return_inverse=True)
        at = np.minimum(np.searchsorted(kids, side), len(kids) - 1)
        own = kids[at] == side
        rows, row_slot = rows[own], at[own]
        nodes = 2 * nodes[kids // 2] + kids % 2
    return share


def deep_forest(rows: DataFrame, late: str, features: list[str], keep: list[str], shape: Shape = DEEP, small: int = 50_000) -> DataFrame:
    """The columns `keep` and p of test rows: the mean over all trees of the share of label 1 in the row's leaf.

    `rows` has series_id, pos, y, the features, and in the column `late`
    true for test rows, false for training rows. Each tree draws every training row a
    Poisson number of times with mean 1, by a hash of seed, tree, series_id
    and pos; each node tries the root of the number of features. Features are
    binned by quantiles of all training rows. Nodes of up to `small` drawn
    rows are finished in one task each; the forest is the same whatever
    `small` is. Without training rows p is null.
    """
    d = len(features)
    few = d if shape.features == 0 else min(d, shape.features or max(1, round(d**0.5)))
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = [F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)]
    own = rows.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(late).alias("late"), F.col("y").cast("int").alias("y"), F.xxhash64(F.lit(shape.seed), "series_id", "pos").alias("h"), *x)
    base = stored(own.repartition(tasks).withColumn("id", F.monotonically_increasing_id()), "forest").df
    train = base.where("NOT late")
    edges = [np.array(e or [], float) for e in bin_edges(train, [], d, shape.bins).first()[0]]

    def read(b: pa.RecordBatch) -> np.ndarray:
        return np.stack([np.searchsorted(e, b.column(f"x{j}").to_numpy(zero_copy_only=False)) for j, e in enumerate(edges)], axis=1).astype(np.uint8)

    top, total = Top(), train.count()
    large = np.arange(shape.trees, dtype=np.int64) << 40 | 1 if total > small else np.zeros(0, np.int64)
    for level in range(shape.depth + 1):
        if not len(large):
            break
        shared = spark.sparkContext.broadcast((top, large))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top, large = shared.value
            held: dict[int, np.ndarray] = {}
            for b in batches:
                bins, y, h = read(b), b.column("y").to_numpy(), b.column("h").to_numpy()
                for tree in np.unique(large >> 40).tolist():
                    nodes = large[large >> 40 == tree] & ((1 << 40) - 1)
                    w = drawn(h, tree, shape.bootstrap)
                    node, _ = top.descend(tree, bins)
                    at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                    on = np.flatnonzero((w > 0) & (nodes[at] == node))
                    hist = histograms(at[on], len(nodes), bins[on], lots(shape.seed, tree, nodes, d, few), w[on], y[on], shape.bins)
                    held[tree] = held[tree] + hist if tree in held else hist
            for tree, hist in held.items():
                keys = large[large >> 40 == tree]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([hist[:, i].astype("<i8").tobytes() for i in range(len(keys))], pa.binary())], ["key", "hist"])

        def choose(table: pa.Table) -> pa.Table:
            key = table.column("key")[0].as_py()
            hist = sum(np.frombuffer(v, "<i8") for v in table.column("hist").to_pylist()).reshape(2, 1, few, shape.bins).astype(float)
            found = best_splits(hist, lots(shape.seed, key >> 40, np.array([key & ((1 << 40) - 1)]), d, few), shape.least)
            return pa.table({"key": [key], **{c: v.astype(float) for c, v in found.items()}})

        counted = train.select("y", "h", *[f"x{j}" for j in range(d)]).mapInArrow(count, "key long, hist binary")
        found = counted.groupBy("key").applyInArrow(choose, "key long, feature double, bin double, left double, right double, share double").toPandas().sort_values("key")
        key, feature, last = (found[c].to_numpy().astype(np.int64) for c in ("key", "feature", "bin"))
        if level == shape.depth:
            feature[:] = -1
        top.levels.append((key, feature, last, found["share"].to_numpy()))
        kids = np.concatenate([(((key >> 40) << 40) | (2 * (key & ((1 << 40) - 1)) + side))[(feature >= 0) & (found[c].to_numpy() > small)] for side, c in ((0, "left"), (1, "right"))])
        large = np.sort(kids)
    model = spark.sparkContext.broadcast(top)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each node, packed: training rows (draws, y, bins), test rows (id, bins)."""
        for number, b in enumerate(batches):
            bins, y, h, ids = read(b), b.column("y").to_numpy(zero_copy_only=False), b.column("h").to_numpy(), b.column("id").to_numpy()
            test = b.column("late").to_numpy(zero_copy_only=False)
            out = []
            for tree in range(shape.trees):
                w = drawn(h, tree, shape.bootstrap)
                node, share = model.value.descend(tree, bins)
                on = np.flatnonzero(test | ((w > 0) & np.isnan(share)))
                on = on[np.argsort(node[on], kind="stable")]
                for part in np.split(on, np.flatnonzero(np.diff(node[on])) + 1) if len(on) else []:
                    i, j = part[~test[part]], part[test[part]]
                    value = share[part[0]]
                    # the test rows of a large leaf need no training rows, so they need not meet
                    place = (tree, int(node[part[0]]), -1 if np.isnan(value) else number % 64, None if np.isnan(value) else float(value))
                    out.append((*place, np.column_stack([w[i], y[i], bins[i]]).astype(np.uint8).tobytes(), ids[j].astype("<i8").tobytes(), bins[j].tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], ["tree", "node", "part", "value", "train", "ids", "test"])

    def finish(table: pa.Table) -> pa.Table:
        whole = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        ids, test = whole("ids", "<i8"), whole("test", np.uint8).reshape(-1, d)
        value = table.column("value")[0].as_py()
        if value is not None:
            share = np.full(len(ids), value)
        else:
            rows = whole("train", np.uint8).reshape(-1, d + 2)
            own = rows[:, 2:], rows[:, 1].astype(float), rows[:, 0].astype(float)
            share = finished(table.column("node")[0].as_py(), table.column("tree")[0].as_py(), *own, test, shape, few) if len(ids) else np.zeros(0)
        return pa.table({"id": ids, "share": pa.array(share, from_pandas=True)})

    places = ("tree", "node", "part")
    dealt = base.select("id", "late", "y", "h", *[f"x{j}" for j in range(d)]).mapInArrow(deal, "tree int, node long, part int, value double, train binary, ids binary, test binary")
    shares = dealt.repartition(tasks, *places).groupBy(*places).applyInArrow(finish, "id long, share double")
    mean = shares.groupBy("id").agg(F.avg("share").alias("p"))
    return base.where("late").join(mean, "id").select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "p")
