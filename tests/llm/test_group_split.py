"""Splits that keep related records together."""


import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.llm.group_split import entity_id, mixed_sets, related_sets, split_shares, stratified_group_split

HEX = "0123456789abcdef0123456789abcdef0123456"


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


def test_entity_spellings(spark):
    h = HEX + "a"
    rows = [(h,), (" " + h.upper() + " ",), ("SHA1:" + h.upper(),), ("sha1: " + h,), (h + "b",), ("",), ("<missing>",), (None,), ("nan",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(entity_id(F.col("x"))).collect()]
    assert got == [h] * 4 + [None] * 5


def related(n, seed):
    rng = random.Random(seed)
    ids = lambda k, p: None if rng.random() < p else HEX + f"{rng.randrange(k):x}"[-1:] if k <= 16 else f"{rng.randrange(k):040x}"
    rows = []
    for i in range(1, n + 1):
        hot = f"{1:040x}" if rng.random() < 0.3 else ids(200, 0.1)
        rows.append((i, hot, ids(300, 0.1), rng.choice(["low", "LOW ", "high", None, "medium", ""])))
    return rows


def test_related_sets(spark):
    rows = related(300, 5)
    df = spark.createDataFrame(rows, "record_id bigint, semantic_group_id string, text_group_id string, priority string")
    edges = [(("r", i), ("s", s)) for i, s, _, _ in rows if s] + [(("r", i), ("t", t)) for i, _, t, _ in rows if t]
    names = {x: k for k, x in enumerate(sorted({e for pair in edges for e in pair} | {("r", i) for i, *_ in rows}))}
    root = union_find([(names[a], names[b]) for a, b in edges] + [(names[("r", i)],) * 2 for i, *_ in rows])
    sets = {}
    for i, *_ in rows:
        sets.setdefault(root[names[("r", i)]], []).append(i)
    want = {i: min(m) for m in sets.values() for i in m}
    got = related_sets(df, "record_id", ["semantic_group_id", "text_group_id"])
    assert {r["id"]: r["set_id"] for r in got.collect()} == want
    sem = {i: s for i, s, _, _ in rows}
    mixed = {(i, min(m)) for m in sets.values() if len(m) > 1 and (len({sem[i] for i in m}) > 1 or None in {sem[i] for i in m}) for i in m}
    assert {tuple(r) for r in mixed_sets(df).collect()} == mixed


def test_split_keeps_sets_and_mix(spark):
    rng = random.Random(1)
    rows = [(i, f"{rng.randrange(900):040x}" if rng.random() < 0.9 else None, None if rng.random() < 0.5 else f"{rng.randrange(2000):040x}", rng.choice(["low", "high", " High", "medium", None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "record_id bigint, semantic_group_id string, text_group_id string, priority string").withColumn("split", F.lit("x")).withColumn("size", F.lit(1))
    out = stratified_group_split(df)
    got = out.toPandas()
    assert len(got) == 2000 and got.record_id.is_unique
    assert got.groupby("set_id").split.nunique().max() == 1
    shares = got.split.value_counts(normalize=True)
    assert abs(shares["training"] - 0.7) < 0.03 and abs(shares["holdout"] - 0.15) < 0.03
    report = split_shares(out).toPandas()
    assert (abs(report.label_share - report.label_share_all) < 0.06).all()
    again = stratified_group_split(df.repartition(7)).toPandas()
    assert dict(zip(got.record_id, got.split)) == dict(zip(again.record_id, again.split))
    assert stratified_group_split(df.limit(0)).isEmpty()


