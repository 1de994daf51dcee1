import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import density as D


def blobs(rng, n, far=8.0, width=6, centres=3):
    middles = rng.standard_normal((centres, width)) * far
    return [(i, (middles[i % centres] + rng.standard_normal(width) * 0.5).tolist()) for i in range(n)]


def by_hand(points, k, least_size, sparse):
    ids = [i for i, _ in points]
    x = np.array([v for _, v in points])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).round(D.DIGITS)
    near = [sorted((far[i, j], ids[j], j) for j in range(len(ids)) if j != i)[:k] for i in range(len(ids))]
    core = [n[-1][0] for n in near]
    cut = sorted(core)[math.ceil((1 - sparse) * len(core)) - 1]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, found in enumerate(near):
        for d, _, j in found:
            if max(d, core[i], core[j]) <= cut:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    members = {}
    for i in range(len(ids)):
        members.setdefault(find(i), []).append(i)
    out = {}
    for i, key in enumerate(ids):
        group = members[find(i)]
        inside = len(group) >= least_size and core[i] <= cut
        densest = min(core[j] for j in group)
        out[key] = (min(ids[j] for j in group) if inside else None, (densest / core[i] if core[i] else 1.0) if inside else 0.0)
    return out


def frame(spark, points):
    return spark.createDataFrame(points, "id bigint, vec array<double>").repartition(3)


def test_clusters_of_one_cell(spark):
    rng = np.random.default_rng(1)
    points = blobs(rng, 140) + [(500 + i, (rng.standard_normal(6) * 60).tolist()) for i in range(12)] + [(600 + i, [1.0] * 6) for i in range(7)]
    got = {r.id: (r.cluster, r.strength) for r in D.density_clusters(frame(spark, points)).collect()}
    want = by_hand(points, 5, 5, 0.1)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert all(got[i][1] == pytest.approx(s, abs=1e-6) for i, (_, s) in want.items())
    assert len({c for c, _ in got.values()}) >= 4 and all(got[500 + i] == (None, 0.0) for i in range(12))


def test_many_cells_and_a_hot_point(spark):
    rng = np.random.default_rng(2)
    points = blobs(rng, 600) + [(1000 + i, [50.0] * 6) for i in range(300)]
    got = {r.id: r.cluster for r in D.density_clusters(frame(spark, points), cell=64, sparse=0.02).collect()}
    kinds = {}
    for i, c in got.items():
        kinds.setdefault(c, set()).add("hot" if i >= 1000 else i % 3)
    kinds.pop(None, None)
    assert all(len(k) == 1 for k in kinds.values())  # no cluster holds two kinds
    assert sum(c is None for c in got.values()) < 60
    near = D.nearest_neighbours(frame(spark, points[:600]), 5, 64).groupBy("id").agg(F.collect_list("other").alias("o")).collect()
    x = np.array([v for _, v in points[:600]])
    exact = np.argsort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, 1:6]
    right = sum(len(set(r.o) & set(exact[r.id].tolist())) for r in near)
    assert right >= 0.6 * 600 * 5


def test_spanning_forest(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(9))) for _ in range(90)] + [(100 + i, 101 + i, 1.0) for i in range(40)]
    forest, trees = D.spanning_forest(spark.createDataFrame(edges, "a bigint, b bigint, w double"))
    root = {v: v for a, b, _ in edges if a != b for v in (a, b)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = 0.0
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if a != b and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
            total += w
    assert {r.node: r.root for r in trees.collect()} == {v: find(v) for v in root}
    kept = forest.collect()
    assert sum(r.w for r in kept) == total and len(kept) == len(root) - len({find(v) for v in root})


def test_a_forest_of_many_rounds_keeps_small_plans(spark):
    # neighbours are joined first, then pairs of them, and so on: five rounds
    edges = [(i, i + 1, float((i + 1) & -(i + 1))) for i in range(31)]
    forest, trees = D.spanning_forest(spark.createDataFrame(edges, "a bigint, b bigint, w double"))
    assert trees._jdf.queryExecution().optimizedPlan().constraints().size() < 100
    assert {r.node: r.root for r in trees.collect()} == {i: 0 for i in range(32)}
    assert sorted(map(tuple, forest.collect())) == edges


def test_odd_points(spark):
    rng = np.random.default_rng(4)
    points = blobs(rng, 40, centres=1) + [(90, None), (91, []), (92, [1.0]), (93, [float("nan")] * 6), (94, [None] * 6)]
    got = {r.id: (r.cluster, r.core, r.strength) for r in D.density_clusters(frame(spark, points)).collect()}
    assert len(got) == 45 and all(got[i] == (None, None, 0.0) for i in range(90, 95))
    assert D.density_clusters(frame(spark, points[:4])).filter("cluster is not null").count() == 0
    assert D.density_clusters(frame(spark, []).limit(0)).collect() == []


def test_topics(spark):
    rng = np.random.default_rng(5)
    rows = [("g", v, [f"kind{i % 2}"], 3) for i, v in blobs(rng, 60, centres=2)] + [("h", [900.0 * (i + 1)] * 6, ["odd"], 3) for i in range(4)]
    messages = spark.createDataFrame(rows, "group_name string, embedding array<double>, tokens array<string>, topic_id int")
    placed, table = D.topics_density(messages, "embedding", sparse=0.1)
    out = placed.collect()
    assert len(out) == 64 and placed.columns == ["group_name", "embedding", "tokens", "topic_id", "topic_score"]
    assert all(r.topic_id == 0 and r.topic_score == 0.0 for r in out if r.group_name == "h")
    inside = [r for r in out if r.topic_score > 0]
    assert len(inside) > 50 and len({(r.topic_id, r.tokens[0]) for r in inside}) == 2
    assert sum(r.weight for r in table.filter("group_name = 'g'").collect()) == pytest.approx(1)
    assert {r.topic_label.split(" / ")[0] for r in table.collect()} <= {"kind0", "kind1", "odd"}
