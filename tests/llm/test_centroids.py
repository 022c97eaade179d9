import hashlib
import math
import random

import numpy as np
from pyspark.sql import types as T

from glossaflow.llm import centroids

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType())])


def plain(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        label = [near(v)[1] for _, v in kept]
        new = []
        for j, c in enumerate(at):
            mine = [v for (_, v), x in zip(kept, label) if x == j]
            new.append([sum(col) // len(mine) for col in zip(*mine)] if mine else c)
        at = new
    done = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, j in done if j == c) for c in range(len(at))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    fit = lambda n: n if n < 2**63 else None
    return sorted(((i, j, fit(d), fit(inertia[j]), fit(sum(inertia)), digest[j]) for i, d, j in done), key=repr)


def vectors(rng, n, dims, size):
    return [(rng.choice([i, i, i, i // 2]), [rng.gauss(0, 1) * size for _ in range(dims)], "x") for i in range(n)]


def check(spark, rows, dims=4, k=3, rounds=4, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = centroids.cluster(df, dims=dims, k=k, rounds=rounds, **more)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, k, rounds, dims)


def test_against_plain_at_all_magnitudes(spark):
    rng = random.Random(3)
    for size in (0.2, 40.0, 1e5, 1e9, 1e15, 1e33):
        check(spark, vectors(rng, 120, 4, size), block_rows=16)
    check(spark, vectors(rng, 60, 4, 1.0) + vectors(rng, 60, 4, 1e12) + vectors(rng, 3, 4, 1e307))


def test_odd_rows(spark):
    v = [0.5, -0.25, 0.0, 1.0]
    odd = [(1, None, ""), (2, [], ""), (3, v[:3], ""), (4, [*v, 1.0], ""), (5, [None, 1.0, 1.0, 1.0], ""), (6, [math.nan, 1.0, 1.0, 1.0], ""), (7, [math.inf, 1.0, 1.0, 1.0], ""), (None, v, ""), (None, [1.0, 1.0, 1.0, 1.0], "")]
    check(spark, odd)
    check(spark, odd + [(8, v, "")] * 50 + [(9, [-x for x in v], "")] * 3, k=8)
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert centroids.cluster(spark.createDataFrame(odd[:7], SCHEMA), dims=4).count() == 0


def test_ties_go_to_the_smaller_number():
    block = np.array([[1.0, 0.0], [0.0, 5.0]])
    for at in ([[0, 0], [2, 0]], [[0, 10**9], [2, 10**9]]):
        label, distance = centroids.nearest(block, at)
        assert label.tolist() == [0, 0 if at[0][1] == 0 else 0]
        assert distance[0] == 1 + at[0][1] ** 2


def test_bound_splits_rows():
    rng = np.random.default_rng(0)
    block = np.concatenate([rng.integers(-900, 900, (50, 64)), rng.integers(-(2**40), 2**40, (50, 64))]).astype(float)
    at = rng.integers(-900, 900, (8, 64)).tolist()
    small = centroids._bounded(block, at)
    assert small[:50].all() and not small[50:].any()
    label, distance = centroids.nearest(block, at)
    for row, j, d in zip(block.tolist(), label.tolist(), distance):
        every = [sum((int(a) - b) ** 2 for a, b in zip(row, c)) for c in at]
        assert (d, j) == (min(every), every.index(min(every)))


def test_blocks_are_packed_without_loss():
    for block in (np.array([[1.0, -32767.0]]), np.array([[1.0, 2.0**20]]), np.array([[1.0, 2.0**52 + 1]]), np.array([[10**400, -5]], dtype=object)):
        kind, data = centroids.packed(block)
        back = centroids.unpacked(kind, data, 2)
        assert (back == block).all() and back.dtype == block.dtype
