"""Forests and boosted trees of all folds at once, from histograms.

Features are binned by the quantiles of each fold's training rows. A level of
all trees of all folds is one aggregation over (fold, tree, node, feature,
bin), added up in the tasks before the shuffle, so that neither the number of
folds nor the size of one decides how many jobs there are or what a task
holds. Trees are stored tables of (fold, tree) with their nodes as an array,
in the order of a heap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import SPLIT
from .store import Stored, stored

#: A node: the feature and the last bin that goes left, null for a leaf, and its value.
NODES = "array<struct<feature:int,bin:int,value:double>>"


@dataclass(frozen=True)
class Shape:
    trees: int = 50
    depth: int = 6
    bins: int = 32
    least: int = 5  # training rows of a leaf
    features: int | None = None  # that a node may split by; None: the root of their number
    bootstrap: bool = True
    rate: float = 0.1  # of boosting
    seed: int = 42


def bin_edges(train: DataFrame, keys: list[str], d: int, bins: int) -> DataFrame:
    """(keys, edges): of each feature x0.. the quantiles that part its bins, one array per feature."""
    asked = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return train.groupBy(*keys).agg(F.array(*[F.array_sort(F.array_distinct(F.percentile_approx(f"x{j}", asked, F.lit(100 * bins)))) for j in range(d)]).alias("edges"))


def binned(rows: DataFrame, edges: DataFrame, keys: list[str], d: int) -> DataFrame:
    """rows with bins: for each feature the number of edges below its value."""
    rows = rows.join(edges, keys)
    one = lambda j: F.size(F.filter(F.col("edges")[j], lambda e: e < F.col(f"x{j}")))
    return rows.withColumn("bins", F.array(*[one(j) for j in range(d)])).drop("edges", *[f"x{j}" for j in range(d)])


def reached(nodes: Column, bins: Column, depth: int) -> Column:
    """The number of the node (from 1) that a row is in after at most `depth` steps."""

    def step(at: Column, _: Column) -> Column:
        node = F.element_at(nodes, at)
        return F.when(node["feature"].isNull(), at).otherwise(2 * at + F.when(F.element_at(bins, node["feature"] + 1) > node["bin"], 1).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step) if depth else F.lit(1)


def grown(points: DataFrame, keys: list[str], d: int, shape: Shape, few: int, leaf: Column) -> Stored:
    """(keys, tree, nodes) for points (keys, tree, bins, g, h, n): g and h are what a split parts, n the rows.

    A split has the largest gain G^2/H on both sides over that of the node,
    ties by feature and bin; it leaves `least` rows on both sides. `few`
    features of each node are tried, by a seeded hash. `leaf` is the value of
    a node from G and H.
    """
    tree = [*keys, "tree"]
    model = stored(points.select(*tree).distinct().withColumn("nodes", F.array(F.struct(F.lit(None).cast("int").alias("feature"), F.lit(None).cast("int").alias("bin"), F.lit(0.0).alias("value")))), "trees")
    for level in range(shape.depth + 1):
        at = points.join(model.df, tree).withColumn("node", reached(F.col("nodes"), F.col("bins"), level)).where(F.col("node") >= 1 << level)
        cell = at.select(*tree, "node", "g", "h", "n", F.posexplode("bins").alias("feature", "bin"))
        hist = cell.groupBy(*tree, "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        whole = Window.partitionBy(*tree, "node", "feature")  # bins of one feature of one node
        upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sides = hist.select(*tree, "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(whole).alias(c) for c in "ghn"])
        score = lambda g, h: F.try_divide(g * g, h)
        gain = score(F.col("gl"), F.col("hl")) + score(F.col("g") - F.col("gl"), F.col("h") - F.col("hl")) - score(F.col("g"), F.col("h"))
        lot = F.row_number().over(Window.partitionBy(*tree, "node").orderBy(F.xxhash64(F.lit(shape.seed), *tree, "node", "feature"), "feature"))
        tried = hist.select(*tree, "node", "feature").distinct().withColumn("_lot", lot).where(F.col("_lot") <= few).select(*tree, "node", "feature", F.lit(True).alias("_tried"))
        sides = sides.join(tried, [*tree, "node", "feature"], "left")
        fits = F.coalesce("_tried", F.lit(False)) & (F.col("nl") >= shape.least) & (F.col("n") - F.col("nl") >= shape.least) & (gain > 1e-12) & F.lit(level < shape.depth)
        best = sides.groupBy(*tree, "node").agg(F.max(F.when(fits, F.struct(F.round(gain, 9).alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin")))).alias("_best"), F.first("g").alias("g"), F.first("h").alias("h"))
        made = F.struct((-F.col("_best.feature")).cast("int").alias("feature"), (-F.col("_best.bin")).cast("int").alias("bin"), leaf.alias("value"))
        made = best.groupBy(*tree).agg(F.map_from_entries(F.collect_list(F.struct("node", made.alias("made")))).alias("_made"))
        empty = F.lit(None).cast("struct<feature:int,bin:int,value:double>")
        row = F.transform(F.sequence(F.lit(1 << level), F.lit((2 << level) - 1)), lambda i: F.coalesce(F.try_element_at("_made", i), empty))
        above = F.slice("nodes", 1, (1 << level) - 1) if level else F.array().cast(NODES)
        new = stored(model.df.join(made, tree, "left").select(*tree, F.when(F.col("_made").isNull(), F.col("nodes")).otherwise(F.concat(above, row)).alias("nodes")), "trees")
        # trees that no longer grow keep their nodes, as their heap has no such row
        model.drop()
        model = new
        split = F.exists("nodes", lambda x: x["feature"].isNotNull())
        if level == shape.depth or model.df.where(F.size("nodes") >= 1 << level).where(split).isEmpty():
            break
    return model


def value_of(nodes: Column, bins: Column, depth: int) -> Column:
    return F.element_at(nodes, reached(nodes, bins, depth))["value"]


def _prepared(rows: DataFrame, splits: DataFrame, features: list[str], keys: list[str], bins: int) -> DataFrame:
    """(keys, pos, y, role, bins) of all rows of folds whose training rows have both labels."""
    d = len(features)
    both = splits.join(rows.select("series_id", "pos", F.col("y").cast("int").alias("y"), *[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)]), ["series_id", "pos"])
    both = both.select(*keys, "pos", "y", "role", *[f"x{j}" for j in range(d)])
    train = both.where("role = 'train'")
    fair = train.groupBy(*keys).agg(F.min("y").alias("_a"), F.max("y").alias("_b")).where("_a < _b").select(*keys)
    edges = stored(bin_edges(train.join(fair, keys, "left_semi"), keys, d, bins), "edges")
    return stored(binned(both, edges.df, keys, d), "binned").df


def grouped_forest(rows: DataFrame, splits: DataFrame, features: list[str], keys: list[str] | None = None, shape: Shape = Shape()) -> DataFrame:
    """(keys, pos, y, p) on test rows: the mean share of label 1 in the leaves of `trees` trees, each on rows drawn by a seeded Poisson weight.

    Folds without both classes in training are left out. Reruns agree: what
    is random is a hash of seed, fold, tree and position.
    """
    keys = keys or SPLIT
    d = len(features)
    few = min(d, shape.features or max(1, round(d**0.5))) if shape.features != 0 else d
    own = _prepared(rows, splits, features, keys, shape.bins)
    each = F.explode(F.sequence(F.lit(0), F.lit(shape.trees - 1))).alias("tree")
    points = own.where("role = 'train'").select(*keys, "pos", "y", "bins", each)
    if shape.bootstrap:
        u = F.pmod(F.xxhash64(F.lit(shape.seed), *keys, "tree", "pos"), F.lit(1 << 30)) / float(1 << 30)
        mass, total, weight = 0.36787944117144233, 0.0, F.lit(0)  # exp(-1): Poisson with mean 1
        for k in range(8):
            total += mass
            weight = weight + F.when(u >= total, 1).otherwise(0)
            mass /= k + 1
        points = points.withColumn("n", weight).where("n > 0")
    else:
        points = points.withColumn("n", F.lit(1))
    points = points.select(*keys, "tree", "bins", (F.col("n") * F.col("y")).cast("double").alias("g"), F.col("n").cast("double").alias("h"), "n")
    model = grown(points, keys, d, shape, few, F.try_divide("g", "h"))
    test = own.where("role = 'test'").join(model.df, keys).withColumn("_v", value_of(F.col("nodes"), F.col("bins"), shape.depth))
    return test.groupBy(*keys, "pos", "y").agg(F.avg("_v").alias("p"))


def grouped_boosting(rows: DataFrame, splits: DataFrame, features: list[str], keys: list[str] | None = None, shape: Shape = Shape(trees=20, depth=3)) -> DataFrame:
    """(keys, pos, y, p) on test rows: `trees` rounds of trees on the gradient of the log loss, with Newton steps as leaves, all folds in each round.

    Rows carry their score from round to round in a stored table. Folds
    without both classes in training are left out.
    """
    keys = keys or SPLIT
    d = len(features)
    own = _prepared(rows, splits, features, keys, shape.bins)
    share = own.where("role = 'train'").groupBy(*keys).agg(F.avg("y").alias("_share"))
    scored = stored(own.join(share, keys).withColumn("s", F.log(F.col("_share") / (1 - F.col("_share")))).drop("_share"), "boosted")
    p = 1 / (1 + F.exp(-F.col("s")))
    for _ in range(shape.trees):
        points = scored.df.where("role = 'train'").select(*keys, F.lit(0).alias("tree"), "bins", (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"), F.lit(1).alias("n"))
        model = grown(points, keys, d, shape, d, F.coalesce(F.try_divide("g", "h"), F.lit(0.0)))
        moved = scored.df.join(model.df.drop("tree"), keys).withColumn("s", F.col("s") + shape.rate * value_of(F.col("nodes"), F.col("bins"), shape.depth)).drop("nodes")
        new = stored(moved, "boosted")
        scored.drop()
        model.drop()
        scored = new
    return scored.df.where("role = 'test'").select(*keys, "pos", "y", p.alias("p"))
