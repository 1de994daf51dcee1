"""Clusters of embeddings by density, with outliers.

Two points reach each other at the greatest of their distance and their core
distances (the distance to the k-th neighbour).  Clusters are what a spanning
forest of points that reach each other within a cut connects, if large enough;
all other points are outliers.

Neighbours are searched in cells of a bounded size, never among all pairs:
several times over, random planes through the medians part the points into
cells, and cells that are still too large, as of equal points, are dealt into
parts.  Up to ``cell`` points are one cell, where the search is exact.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.topics import LABEL_WORDS, SEED, class_tfidf, topic_labels, topic_weights
from parley.session import attach, checkpointed, saved, ship_package

NEIGHBOURS = 5
LEAST_SIZE = 5
#: Points of a cell; cells of one search hold about half as many to twice as many.
CELL = 1024
SEARCHES = 6
#: The part of the points whose core distance may lie above the cut.
SPARSE = 0.1
DIGITS = 6


def _projected(planes: np.ndarray):
    def run(batches):
        for batch in batches:
            vectors = np.array(batch.column("vec").to_pylist(), dtype=float).reshape(batch.num_rows, planes.shape[1])
            sides = vectors @ planes.T
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(sides.tolist(), pa.list_(pa.float64()))], names=["id", "vec", "sides"])

    return run


def _cell_neighbours(k: int):
    def run(cell: pa.Table) -> pa.Table:
        ids = cell["id"].to_numpy()
        points = np.array(cell["vec"].to_pylist(), dtype=float)
        norms = (points * points).sum(axis=1)
        out: list[tuple[np.ndarray, ...]] = []
        for i in range(0, len(ids), 256):
            near = norms[i : i + 256, None] + norms[None, :] - 2 * points[i : i + 256] @ points.T
            near[np.arange(len(near)), np.arange(i, i + len(near))] = np.inf
            # a few more than k by the fast formula, then in order of the exact distance, then of the id
            some = np.argsort(near, axis=1, kind="stable")[:, : 2 * k + 8]
            far = np.sqrt(((points[i : i + 256, None, :] - points[some]) ** 2).sum(axis=2)).round(DIGITS)
            far[np.isinf(np.take_along_axis(near, some, axis=1))] = np.inf
            order = np.lexsort((ids[some], far), axis=1)[:, :k]
            own = np.repeat(ids[i : i + 256], order.shape[1])
            out.append((own, np.take_along_axis(ids[some], order, axis=1).ravel(), np.take_along_axis(far, order, axis=1).ravel()))
        a, b, d = (np.concatenate(x) for x in zip(*out, strict=True))
        real = np.isfinite(d)
        return pa.table([pa.array(a[real]), pa.array(b[real]), pa.array(d[real])], names=["id", "other", "distance"])

    return run


def nearest_neighbours(points: DataFrame, k: int = NEIGHBOURS, cell: int = CELL, searches: int = SEARCHES, seed: int = SEED) -> DataFrame:
    """(id, other, distance): the k nearest points found for each point (id bigint, vec array<double>)."""
    ship_package(points.sparkSession)
    n = points.count()
    bits = max(0, math.ceil(math.log2(n / cell))) if n else 0
    searches = searches if bits else 1
    if bits:
        width = points.select(F.size("vec")).first()[0]
        planes = np.random.default_rng(seed).standard_normal((searches * bits, width))
        sided = checkpointed(points.select("id", "vec").mapInArrow(_projected(planes), "id bigint, vec array<double>, sides array<double>"))
        middle = sided.agg(*(F.percentile_approx(F.get("sides", i), 0.5).alias(f"m{i}") for i in range(searches * bits))).first()
        code = [reduce(Column.__add__, [F.when(F.get("sides", s * bits + j) > middle[s * bits + j], 1 << j).otherwise(0) for j in range(bits)]) for s in range(searches)]
    else:
        sided, code = points, [F.lit(0)]
    places = F.array(*(F.struct(F.lit(s).alias("search"), c.cast("bigint").alias("code")) for s, c in enumerate(code)))
    dealt = sided.select("id", "vec", F.explode(places).alias("p")).select("id", "vec", "p.search", "p.code")
    sizes = dealt.groupBy("search", "code").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell)).alias("pieces"))
    dealt = attach(dealt, sizes, ["search", "code"], "inner")
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("id", "search"), F.col("pieces")))
    found = dealt.select("search", "code", "piece", "id", "vec").groupBy("search", "code", "piece")
    found = found.applyInArrow(_cell_neighbours(k), "id bigint, other bigint, distance double")
    order = Window.partitionBy("id").orderBy("distance", "other")
    return found.distinct().withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).drop("rn")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The least spanning forest of edges (a, b, w): its edges, and (node, root) with
    the least node of each tree.

    Boruvka rounds: every tree takes its least edge to another tree (of equal ones
    the one of the least nodes, so that no circle closes), which at least halves
    the trees that are not done.  Trees only meet as keys of joins and sums.
    """
    both = edges.filter("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "w")
    now = saved(both.groupBy("x", "y").agg(F.min("w").alias("w")).select(F.col("x").alias("ra"), F.col("y").alias("rb"), "w", "x", "y"), "edges")
    nodes = saved(now.select(F.col("x").alias("node")).union(now.select("y")).distinct().withColumn("root", F.col("node")), "nodes")
    forest = now.select("x", "y", "w").limit(0)
    while not now.isEmpty():
        ends = now.union(now.select(F.col("rb").alias("ra"), F.col("ra").alias("rb"), "w", "x", "y"))
        taken = saved(ends.groupBy("ra").agg(F.min(F.struct("w", "x", "y", "rb")).alias("e")), "taken")
        forest = forest.union(taken.select("e.x", "e.y", "e.w").distinct())
        up = taken.select(F.col("ra").alias("tree"), F.col("e.rb").alias("up"))
        back = up.select(F.col("tree").alias("up"), F.col("up").alias("upper"))
        # two trees that took the same edge: the lesser is the root
        up = up.join(back, "up").select("tree", F.when((F.col("upper") == F.col("tree")) & (F.col("tree") < F.col("up")), F.col("tree")).otherwise(F.col("up")).alias("up"))
        up = saved(up, "up")
        while True:
            above = up.select(F.col("tree").alias("up"), F.col("up").alias("upper"))
            further = saved(up.join(above, "up").select("tree", "up", "upper"), "up")
            up = further.select("tree", F.col("upper").alias("up"))
            if further.filter("up <> upper").isEmpty():
                break
        nodes = saved(nodes.join(up.withColumnRenamed("tree", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "nodes")
        left = now.join(up.select(F.col("tree").alias("ra"), F.col("up").alias("na")), "ra").join(up.select(F.col("tree").alias("rb"), F.col("up").alias("nb")), "rb")
        left = left.filter("na <> nb").groupBy(F.least("na", "nb").alias("ra"), F.greatest("na", "nb").alias("rb")).agg(F.min(F.struct("w", "x", "y")).alias("e"))
        now = saved(left.select("ra", "rb", "e.w", "e.x", "e.y"), "edges")
    least = nodes.groupBy("root").agg(F.min("node").alias("least"))
    return forest, nodes.join(least, "root").select("node", F.col("least").alias("root"))


def density_clusters(
    points: DataFrame,
    k: int = NEIGHBOURS,
    least_size: int = LEAST_SIZE,
    sparse: float = SPARSE,
    cell: int = CELL,
    searches: int = SEARCHES,
    seed: int = SEED,
) -> DataFrame:
    """(id, cluster, core, strength) of points (id bigint, unique, and vec array<double>).

    cluster: the least id of the cluster, null for outliers.  The cut is the core
    distance that ``sparse`` of the points exceed.  core: distance to the k-th
    neighbour, null with fewer; strength: the densest core distance of the cluster
    by the own one, 0 for outliers.  Vectors that are null, hold null or NaN, or
    have another length than most are outliers.
    """
    clean = F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v)) & (F.size("vec") > 0)
    points = checkpointed(points.select("id", F.col("vec").cast("array<double>").alias("vec")))
    usual = points.filter(clean).groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    sound = points.filter(clean & (F.size("vec") == (usual["n"] if usual else 0)))
    near = checkpointed(nearest_neighbours(sound, k, cell, searches, seed))
    core = checkpointed(near.groupBy("id").agg(F.max("distance").alias("core"), F.count(F.lit(1)).alias("found")).filter(F.col("found") >= k).select("id", "core"))
    cut = core.agg(F.percentile_approx("core", 1 - sparse, 1_000_000)).first()[0]
    dense = core.filter(F.col("core") <= F.lit(cut).cast("double"))
    reach = near.join(dense.withColumnRenamed("core", "c1"), "id").join(dense.select(F.col("id").alias("other"), F.col("core").alias("c2")), "other")
    edges = reach.select(F.col("id").alias("a"), F.col("other").alias("b"), F.greatest("distance", "c1", "c2").alias("w")).filter(F.col("w") <= F.lit(cut).cast("double"))
    _, trees = spanning_forest(edges)
    sizes = trees.join(dense.withColumnRenamed("id", "node"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("core").alias("densest"))
    large = sizes.filter(F.col("n") >= least_size).select("root", "densest")
    members = trees.join(large, "root").select(F.col("node").alias("id"), F.col("root").alias("cluster"), "densest")
    out = points.select("id").join(core, "id", "left").join(members, "id", "left")
    strength = F.when(F.col("cluster").isNull(), 0.0).when(F.col("core") > 0, F.col("densest") / F.col("core")).otherwise(1.0)
    return out.select("id", "cluster", "core", strength.alias("strength"))


def topics_density(messages: DataFrame, embedding: str, keys=("group_name",), tokens: str = "tokens", **options) -> tuple[DataFrame, DataFrame]:
    """Topics by density: (messages + topic_id, topic_score; topic table).

    Clusters are numbered by size, then by their first message; outliers, -1,
    count as topic 0 with score 0, members have the strength of their membership.
    """
    # written before anything reads the numbers, so that they stay as they are
    numbered = checkpointed(messages.withColumn("_id", F.monotonically_increasing_id()))
    found = checkpointed(density_clusters(numbered.select(F.col("_id").alias("id"), F.col(embedding).alias("vec")), **options))
    clusters = found.filter("cluster is not null").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    # one row per cluster
    ranked = clusters.withColumn("raw", F.row_number().over(Window.orderBy(F.desc("n"), "cluster")) - 1).select("cluster", "raw")
    placed = attach(found, ranked, ["cluster"]).select(F.col("id").alias("_id"), F.coalesce("raw", F.lit(-1)).alias("_raw"), "strength")
    given = [c for c in messages.columns if c not in ("topic_id", "topic_score")]
    annotated = numbered.join(placed, "_id").select(*given, F.greatest("_raw", F.lit(0)).alias("topic_id"), F.col("strength").alias("topic_score"))
    filler = F.lit(" / ".join(f"word{i}" for i in range(LABEL_WORDS)))
    weights = topic_weights(annotated, None, keys)
    if tokens not in messages.columns:
        return annotated, weights.select(*keys, "topic_id", filler.alias("topic_label"), "weight")
    labels = topic_labels(class_tfidf(annotated, ("topic_id",), tokens))
    return annotated, attach(weights, labels, ["topic_id"]).select(*keys, "topic_id", F.coalesce("topic_label", filler).alias("topic_label"), "weight")
