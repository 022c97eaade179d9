"""Centroid clustering of integer vectors, exact at any magnitude.

Every component x becomes the integer floor(scale * x). Distances come from the
expansion |x|^2 - 2 x.c + |c|^2 as one float64 matrix product over a block of rows.
For a row of magnitude m and centroids of magnitude c, every partial sum of the
expansion, in any order, is at most dims * (m + c)^2; where that is below 2^53 float64
holds all of them exactly. Rows beyond the bound are worked out in Python integers,
and only those.

A round is one job: an RDD treeAggregate over blocks, which were written once to the
shared folder in the smallest type that holds them without loss. What leaves a task is
a count and a sum of components for each centroid; the driver holds the k centroids.
Nothing is keyed by a vector, so copies and hot vectors weigh as other rows do.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, spread, stored

#: A float64 holds every integer up to this exactly; half of it leaves room for rounding in the test itself.
_EXACT = 2.0**52
_LONG = 2**63

SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole(values: np.ndarray, scale: int = 1024) -> np.ndarray:
    """floor(scale * x) as float64, or as Python integers where a product leaves float64."""
    with np.errstate(over="ignore"):
        done = np.floor(values * float(scale))
    if np.isfinite(done).all():
        return done
    flat = [math.floor(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(values.shape)


def packed(block: np.ndarray) -> tuple[str, bytes]:
    """A block in the smallest of int16, float32 and float64 that holds it exactly; else pickled integers."""
    if block.dtype == object:
        return "O", pickle.dumps(block.tolist())
    with np.errstate(over="ignore", invalid="ignore"):
        for kind in ("<i2", "<f4"):
            if kind == "<i2" and np.abs(block).max(initial=0) >= 1 << 15:
                continue
            small = block.astype(kind)
            if np.array_equal(small.astype(np.float64), block):
                return kind, small.tobytes()
    return "<f8", block.astype("<f8").tobytes()


def unpacked(kind: str, data: bytes, dims: int) -> np.ndarray:
    if kind == "O":
        return np.array(pickle.loads(data), dtype=object).reshape(-1, dims)
    return np.frombuffer(data, kind).reshape(-1, dims).astype(np.float64)


def _integers(block: np.ndarray) -> np.ndarray:
    return block if block.dtype == object else np.array([int(x) for x in block.ravel().tolist()], dtype=object).reshape(block.shape)


def _bounded(block: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Which rows the float64 expansion handles exactly."""
    if block.dtype == object:
        return np.zeros(len(block), bool)
    top = max((abs(v) for c in centroids for v in c), default=0)
    if top >= _EXACT:
        return np.zeros(len(block), bool)
    with np.errstate(over="ignore"):
        reach = np.abs(block).max(axis=1, initial=0) + float(top)
        return block.shape[1] * reach * reach < _EXACT


def nearest(block: np.ndarray, centroids: list[list[int]], chunk: int = 256) -> tuple[np.ndarray, list[int]]:
    """Number of the nearest centroid of each row (ties: the smaller) and the squared distances as integers."""
    label, distance = np.zeros(len(block), np.int64), np.zeros(len(block), dtype=object)
    small = _bounded(block, centroids)
    if small.any():
        x, c = block[small], np.array(centroids, np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)
        at = d.argmin(axis=1)
        label[small], distance[small] = at, d[np.arange(len(x)), at].astype(np.int64).tolist()
    rest = np.flatnonzero(~small)
    exact = np.array(centroids, dtype=object)
    for a in range(0, len(rest), chunk):
        rows = rest[a : a + chunk]
        gap = _integers(block[rows])[:, None, :] - exact[None]
        for i, row in zip(rows, (gap * gap).sum(axis=2).tolist()):
            distance[i] = min(row)
            label[i] = row.index(distance[i])
    return label, distance.tolist()


def sums(block: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each centroid and the sums of their components, both as Python integers."""
    count = np.bincount(label, minlength=k).astype(object)
    if block.dtype != object and len(block) * np.abs(block).max(initial=0) < _EXACT:
        member = (label[None, :] == np.arange(k)[:, None]).astype(np.float64)
        return count, (member @ block).astype(np.int64).astype(object)
    total, values = np.zeros((k, block.shape[1]), dtype=object), _integers(block)
    for j in range(k):
        rows = values[label == j]
        if len(rows):
            total[j] = rows.sum(axis=0)
    return count, total


def _blocks(dims: int, scale: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            kind, data = packed(np.concatenate(held))
            return pa.RecordBatch.from_pydict({"kind": [kind], "data": [data]})

        for batch in batches:
            if batch.num_rows:
                held.append(whole(_matrix(batch.column(0), dims), scale))
                n += batch.num_rows
            if n >= rows:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _kept(vectors: DataFrame, vec_id: str, embedding: str, dims: int) -> DataFrame:
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter((F.size("embedding") == dims) & ~bad)


def centroids(kept: DataFrame, blocks: DataFrame, k: int, rounds: int, dims: int, scale: int, seed: int) -> tuple[list[list[int]], list[int]]:
    """The final centroids and, for each, the summed distance of the vectors that it is nearest to."""
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("embedding")]
    first = kept.orderBy(*order).limit(k).collect()
    now = [_integers(whole(np.array(r["embedding"], np.float64), scale)).tolist() for r in first]
    if not now:
        return [], []
    rdd = blocks.rdd

    def assigned(at: list[list[int]], inertia: bool):
        def add(total, row):
            block = unpacked(row["kind"], bytes(row["data"]), dims)
            label, distance = nearest(block, at)
            if inertia:
                part = (np.zeros(len(at), dtype=object),)
                for j, d in zip(label.tolist(), distance):
                    part[0][j] += d
            else:
                part = sums(block, label, len(at))
            return merge(total, part)

        def merge(a, b):
            return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b))

        return rdd.treeAggregate(None, add, merge)

    for _ in range(rounds):
        count, total = assigned(now, False)
        after = [[s // n for s in total[j]] if (n := count[j]) else now[j] for j in range(len(now))]
        if after == now:  # further rounds would change nothing
            break
        now = after
    return now, list(assigned(now, True)[0])


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, block_rows: int = 4096
) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each vector of dims finite components.

    Vectors that are null, of another length, or with a null, NaN or infinite component
    are left out. Repeated rows and repeated ids each stand for themselves; a null id is
    kept, and its vector comes last as a first centroid. Fewer kept vectors than k give
    as many centroids; an empty table gives an empty one. A distance or inertia beyond a
    long is null, while assignments and centroids stay exact. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept = _kept(vectors, vec_id, embedding, dims)
    blocks = stored(spread(kept.select("embedding")).mapInArrow(_blocks(dims, scale, block_rows), "kind string, data binary"), "centroid-blocks")
    final, inertia = centroids(kept, blocks, k, rounds, dims, scale, seed)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]

    def long(v: int) -> int | None:
        return v if v < _LONG else None

    total = long(sum(inertia))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label, distance = nearest(whole(_matrix(batch.column(1), dims), scale), final)
            at = label.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(at, pa.int32()),
                    pa.array([long(d) for d in distance], pa.int64()),
                    pa.array([long(inertia[j]) for j in at], pa.int64()),
                    pa.array([total] * len(at), pa.int64()),
                    pa.array([digest[j] for j in at], pa.string()),
                ],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return kept.mapInArrow(run, SCHEMA)
