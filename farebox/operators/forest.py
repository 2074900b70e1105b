"""A regression forest as a table of nodes, grown level by level with grouped sums.

Values are binned once. A level counts rows and sums the target per tree, node, feature and bin, picks each
node's best split and writes only the splits; the next level routes the rows through them again. What is
written, joined and broadcast is bounded by trees x 2^depth splits, whatever the number of rows, and all
draws depend on a hash of the row's key, so that reruns, lost executors and other partitions give the same forest.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.session import shared_dir
from farebox.sources.sinks import write_and_read

#: Bins per feature, and the equal cells of a feature's range that bins are made of.
BINS, CELLS = 32, 4096

#: Shares of 2^32 below which a Poisson(1) draw is 0, 1, 2, ...
DRAWS = [int(2 ** 32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(11)]


def bin_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """The largest value of each bin, per feature: at most `bins` numbers a feature reach the driver.

    Each range is cut into equal cells. Up to `bins` occupied cells are a bin each; more are joined to bins of
    about equally many rows.
    """
    values = rows.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in features])).alias("f", "x"))
    bounds = values.groupBy("f").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * F.lit(float(CELLS))
    cells = (values.join(bounds, "f")
             .groupBy("f", F.least(F.coalesce(F.floor(place), F.lit(0)), F.lit(CELLS - 1)).alias("cell"))
             .agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("edge")))
    whole, ordered = Window.partitionBy("f"), Window.partitionBy("f").orderBy("cell")  # at most CELLS rows each
    numbered = cells.select(
        "f", "edge", F.row_number().over(ordered).alias("i"), F.count(F.lit(1)).over(whole).alias("cells"),
        F.expr(f"{bins} * (sum(n) OVER (PARTITION BY f ORDER BY cell) - n) DIV sum(n) OVER (PARTITION BY f)").alias("q"))
    edges = (numbered.groupBy("f", F.when(F.col("cells") <= bins, F.col("i")).otherwise(F.col("q")).alias("bin"))
             .agg(F.max("edge").alias("edge")).collect())
    return [sorted(e["edge"] for e in edges if e["f"] == f) for f in range(len(features))]


def _bin(column: str, edges: list[float]) -> Column:
    """Number of edges below the value: x lies in bin b or lower when x <= edges[b]."""
    below = F.filter(F.array(*map(F.lit, edges or [0.0])), lambda e: e < F.col(column).cast("double"))
    return F.size(below).cast("tinyint")


def _draws(keys: list[str], trees: int, seed: int) -> Column:
    """How often each tree draws the row: Poisson(1) by a hash of seed, tree and key."""
    share = lambda t: F.conv(F.substring(F.md5(F.concat_ws(
        ":", F.lit(str(seed)), t.cast("string"), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long")
    number = lambda t: F.size(F.filter(F.array(*map(F.lit, DRAWS)), lambda d: d <= share(t)))
    return F.transform(F.sequence(F.lit(1), F.lit(trees)), lambda t: number(t).cast("tinyint"))


def _best_splits(routed: DataFrame) -> DataFrame:
    """The split of each (Tree, Node) that lowers the squared error most; ties to the first feature, then bin."""
    sums = (routed.select("Tree", "Node", "w", (F.col("w") * F.col("y")).alias("wy"), F.posexplode("x").alias("f", "b"))
            .groupBy("Tree", "Node", "f", "b").agg(F.sum("w").alias("n"), F.sum("wy").alias("s")))
    one = Window.partitionBy("Tree", "Node", "f")  # a row per bin
    running = one.orderBy("b")
    sides = sums.select(
        "Tree", "Node", "f", "b", F.sum("n").over(running).alias("ln"), F.sum("s").over(running).alias("ls"),
        F.sum("n").over(one).alias("n"), F.sum("s").over(one).alias("s"),
    ).withColumns({"rn": F.col("n") - F.col("ln"), "rs": F.col("s") - F.col("ls")}).where("rn > 0")
    ln, rn, ls, rs, n = (F.col(c).cast("double") for c in ("ln", "rn", "ls", "rs", "n"))
    apart = ls * rn - rs * ln
    gains = sides.withColumn("gain", apart * apart / (ln * rn) / n).where("gain > 0")
    best = F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), "ln", "ls", "rn", "rs"))
    return (gains.groupBy("Tree", "Node").agg(best.alias("best"))
            .select("Tree", "Node", (-F.col("best.f")).alias("f"), (-F.col("best.b")).alias("b"),
                    "best.gain", "best.ln", "best.ls", "best.rn", "best.rs"))


def grow_forest(rows: DataFrame, features: list[str], target: str, keys: list[str],
                trees: int, depth: int, seed: int, bins: int = BINS) -> DataFrame:
    """Nodes of a forest: Tree, Node, Rows, Prediction, and Feature, Threshold and Gain where the node splits.

    Rows with Feature <= Threshold go to node 2 * Node, the others to 2 * Node + 1; the root is 1. Rows is the
    number of draws, Gain the loss of squared error. Features and target hold no nulls, the target is integral;
    rows with equal `keys` are drawn alike. Without rows there are no nodes.
    """
    spark = rows.sparkSession
    shared = shared_dir(spark)
    if shared is None:
        raise ValueError("the forest writes its levels: set spark.checkpoint.dir to a folder that all executors share")
    path = f"{shared}/farebox/{spark.sparkContext.applicationId}/forest-{uuid.uuid4().hex[:12]}"
    edges = bin_edges(rows, features, bins)
    base = write_and_read(rows.repartition(spark.sparkContext.defaultParallelism, *keys).select(
        F.col(target).cast("long").alias("y"), _draws(keys, trees, seed).alias("draws"),
        F.array(*[_bin(c, e) for c, e in zip(features, edges)]).alias("x")), f"{path}/rows")
    routed = (base.select("y", "x", F.posexplode("draws").alias("t", "w")).where("w > 0")
              .select("y", "x", "w", (F.col("t") + 1).alias("Tree"), F.lit(1).alias("Node")))
    split = None
    roots = routed.groupBy("Tree", "Node").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"))
    for level in range(depth):
        found = write_and_read(_best_splits(routed), f"{path}/level-{level}")
        split = found if split is None else split.unionByName(found)
        side = F.col("x")[F.col("f")] > F.col("b")
        routed = (routed.join(found.select("Tree", "Node", "f", "b"), ["Tree", "Node"])
                  .select("y", "x", "w", "Tree", (2 * F.col("Node") + side.cast("int")).alias("Node")))
    nodes = roots if split is None else roots.unionByName(
        split.select("Tree", (2 * F.col("Node")).alias("Node"), F.col("ln").alias("n"), F.col("ls").alias("s"))).unionByName(
        split.select("Tree", (2 * F.col("Node") + 1).alias("Node"), F.col("rn").alias("n"), F.col("rs").alias("s")))
    if split is None:
        none = F.lit(None)
        return nodes.select("Tree", "Node", *_totals(), none.cast("string").alias("Feature"),
                            none.cast("double").alias("Threshold"), none.cast("double").alias("Gain"))
    names = F.array(*map(F.lit, features))
    limits = F.array(*[F.array(*map(F.lit, e or [0.0])) for e in edges])  # no edges without rows
    named = split.select("Tree", "Node", F.get(names, "f").alias("Feature"),
                         F.get(F.get(limits, "f"), F.col("b").cast("int")).alias("Threshold"), F.col("gain").alias("Gain"))
    return nodes.join(named, ["Tree", "Node"], "left").select("Tree", "Node", *_totals(), "Feature", "Threshold", "Gain")


def _totals() -> list[Column]:
    return [F.col("n").alias("Rows"), (F.col("s").cast("double") / F.col("n")).alias("Prediction")]


def importance(nodes: DataFrame, features: list[str]) -> DataFrame:
    """Share of each feature in the gain of a tree, averaged over the trees that split; all shares sum to 1.

    Without a split every share is 0.
    """
    per_tree = Window.partitionBy("Tree")  # a row per feature
    gains = nodes.where("Feature IS NOT NULL").groupBy("Tree", "Feature").agg(F.sum("Gain").alias("g"))
    shares = gains.select("Feature", (F.col("g") / F.sum("g").over(per_tree)).alias("share"))
    trees = nodes.where("Feature IS NOT NULL").agg(F.count_distinct("Tree").alias("k"))
    total = shares.groupBy("Feature").agg(F.sum("share").alias("share"))
    every = nodes.sparkSession.createDataFrame([(c,) for c in features], "Feature string")
    mean = F.col("share") / trees.select("k").scalar()
    return every.join(total, "Feature", "left").select(
        "Feature", F.round(F.coalesce(mean, F.lit(0.0)), 9).alias("Importance"))


def predict(rows: DataFrame, nodes: DataFrame, features: list[str], keys: list[str], trees: int, depth: int) -> DataFrame:
    """Mean prediction of all trees per distinct `keys`: rows join the node table once per level.

    A row whose feature is null at a split goes right.
    """
    values = F.create_map(*[v for c in features for v in (F.lit(c), F.col(c).cast("double"))])
    spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *keys)  # a row becomes `trees` rows
    at = spread.select(*keys, values.alias("values"), F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("Tree"),
                     F.lit(1).alias("Node"))
    splits = nodes.where("Feature IS NOT NULL").select("Tree", "Node", "Feature", "Threshold")
    left = F.coalesce(F.col("values")[F.col("Feature")] <= F.col("Threshold"), F.lit(False))
    below = 2 * F.col("Node") + F.when(left, 0).otherwise(1)
    for _ in range(depth):
        at = at.join(splits, ["Tree", "Node"], "left").select(
            *keys, "values", "Tree", F.when(F.col("Feature").isNull(), F.col("Node")).otherwise(below).alias("Node"))
    fitted = at.join(nodes.select("Tree", "Node", "Prediction"), ["Tree", "Node"])
    return fitted.groupBy(*keys).agg(F.round(F.avg("Prediction"), 4).alias("Fitted"))
