"""Components, related sets, splits, running sums, linkage and sampling."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import linkage, sampling, similarity
from ticketloom.operators.components import connected_components
from ticketloom.operators.running import running_sum


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in rng.sample(range(100, 140), 40)]
    edges = path + [(500, k) for k in range(501, 530)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3), (1, 2), (1, 2), (2, 1)], "a bigint, b bigint")
    want = union_find([(a, b) for a, b in [*edges, (1, 2)] if a != b])
    assert {r["id"]: r["component"] for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).isEmpty()


def test_running_sum(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), i, rng.choice([1, 2, 5, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v bigint").withColumn("_g", F.lit(1)).withColumn("_part", F.lit(2))
    got = {(r["g"], r["k"]): r["running"] for r in running_sum(df, "v", "g", ["k"]).collect()}
    total, want = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        total[g] = total.get(g, 0) + (v or 0)
        want[(g, k)] = total[g]
    assert got == want
    assert running_sum(df.limit(0), "v", "g", ["k"]).isEmpty()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    m = np.vstack([centres[i % 12] + 0.25 * rng.normal(size=16) for i in range(180)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "vec_id bigint, embedding array<float>")


@pytest.mark.parametrize("t", [0.5, 0.9])
def test_similarity_edges(vectors, t):
    m, df = vectors
    sim = m.astype(np.float32).astype(float) @ m.astype(np.float32).astype(float).T
    want = {(i, j) for i, j in itertools.combinations(range(len(m)), 2) if sim[i, j] >= t}
    got = {(r["a"], r["b"]) for r in similarity.similarity_edges(df, "vec_id", "embedding", t).collect()}
    assert len(got ^ want) <= 1  # one at the threshold, by rounding


def test_nearest_neighbours(vectors):
    m, df = vectors
    got = similarity.nearest_neighbours(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", 2).toPandas()
    sim = m @ m.T
    np.fill_diagonal(sim, -1)
    for q in (0, 50, 100, 150):
        assert list(got[got["query"] == q].sort_values("rank").neighbour) == list(np.argsort(-sim[q])[:2])


def test_complete_linkage_groups_are_cliques(vectors):
    m, df = vectors
    edges = similarity.similarity_edges(df, "vec_id", "embedding", 0.7).localCheckpoint()  # a fixture, not an operator
    groups = linkage.complete_linkage(edges, df, "vec_id").toPandas()
    assert len(groups) == 181
    linked = {(r["a"], r["b"]) for r in edges.collect()}
    members = groups.groupby("group_id").vec_id.apply(sorted)
    for ms in members:
        assert all((a, b) in linked for a, b in itertools.combinations(ms, 2))
    for a, b in itertools.combinations(members.index, 2):  # no two groups could still merge
        pairs = [(min(x, y), max(x, y)) for x in members[a] for y in members[b]]
        assert not all(p in linked for p in pairs)
    assert (groups.groupby("group_id").vec_id.min() == groups.groupby("group_id").vec_id.min().index).all()


def test_folds_and_samples(spark):
    rows = [(i, i % 97 if i % 3 else 5, ["a", "b", None][i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "k bigint, g bigint, l string")
    folds = sampling.stratified_group_folds(df, "k", "g", "l", 5).join(df, "k").toPandas()
    assert len(folds) == 900 and folds.groupby("g").fold.nunique().max() == 1
    s = sampling.stratified_sample(df, "k", [F.col("l")], 7, "x").toPandas()
    assert s.groupby("l", dropna=False).size().tolist() == [7, 7, 7]
    again = sampling.stratified_sample(df.repartition(3), "k", [F.col("l")], 7, "x").toPandas()
    assert sorted(s.k) == sorted(again.k)
    draws = sampling.group_bootstrap(spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (0.0, 1.0)], "x double, y double"), ["x", "y"], 50).toPandas()
    assert ((draws.x + draws.y) == 3).all() and draws.x.std() > 0


def test_bootstrap_means_draw_over_all_users(spark, tmp_path):
    from ticketloom.plans.grouping import stratified_bootstrap_means

    users = [*range(1000, 1300)]
    spark.createDataFrame([("view", u, float(u)) for u in users], "event_type string, user_id bigint, value double").write.parquet(str(tmp_path / "events.parquet"))
    dice = lambda it, j: int(hashlib.md5(f"view-{it}-{j}:boot".encode()).hexdigest()[:8], 16) % len(users)
    want = {it: sum(users[dice(it, j)] for j in range(len(users))) / len(users) for it in range(20)}
    got = {r["iteration"]: r["mean"] for r in stratified_bootstrap_means(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-5)
