"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints: 64-bit majority vote over the XXH64 of word shingles. Candidate
search: the 64 bits are cut into ``radius + 1`` or more bands; two fingerprints
within the radius agree on all but ``radius`` of them, so every choice of
``bands - radius`` bands is a table keyed by those bits, and no link is missed.
The number of bands follows from the number of distinct fingerprints, so that a
bucket has about a thousand entries whatever the corpus size.

Inside a bucket, fingerprints are stored vertically: blocks of 64 fingerprints
become 64 machine words, one per bit plane. A fingerprint is compared with a
whole block at once; the 64 distances run in carry-save counters (three bit
planes and a sticky overflow plane), and a (fingerprint, block) item is abandoned
as soon as all of its lanes exceed the radius.

Buckets above ``tile_rows`` are cut into chunks and compared chunk pair by chunk
pair, so no task gets a whole hot bucket. Each task returns only a spanning forest
of its links. Components are then found by alternating large-star and small-star
steps over the edges, entirely in DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_ASCII, discard, free_name, small_batches, spread, stored

_CHUNK = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit fingerprint; 0 for null, empty or blank text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[:n], (ends[shingle - 1 :] - 1).tolist())
    h = np.fromiter((digest(flat[a:b], 42) for a, b in cuts), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        bits = np.unpackbits(h[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 4) -> DataFrame:
    """docs and the fingerprint of each whole text as a signed long; out gets underscores before it if docs has it."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return spread(docs).withColumn(free_name(docs, out), fp(F.col(f"`{text}`")))


def band_masks(bands: int, radius: int) -> list[int]:
    """The key masks of all tables for that many bands."""
    cuts = [64 * i // bands for i in range(bands + 1)]
    band = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(band, bands - radius)]


def bands_for(n: int, radius: int, bucket_rows: int = 1024) -> int:
    """The fewest bands whose keys spread n random fingerprints to bucket_rows a bucket."""
    bands = radius + 1
    while bands < 2 * radius + 4 and n / 2 ** (64 * (bands - radius) / bands) > bucket_rows:
        bands += 1
    return bands


def _planes(fps: np.ndarray) -> np.ndarray:
    """(blocks * 64) fingerprints to (blocks, 64) words; bit i of word b is bit b of fingerprint i."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def close_lanes(planes: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int, first: int = 0):
    """Items whose block has lanes within radius of the query, and those lanes as a word.

    Returns (indices into query, lanes). Carry-save counters hold 0..7, o is sticky
    for 8 and more; radius must be below 8.
    """
    at = np.arange(len(query))
    zero = np.zeros(len(query), np.uint64)
    c0, c1, c2, o = zero.copy(), zero.copy(), zero.copy(), zero.copy()
    one, full = np.uint64(1), ~np.uint64(0)

    def alive() -> np.ndarray:
        over, equal = o, full & ~o
        for c, bit in ((c2, radius >> 2 & 1), (c1, radius >> 1 & 1), (c0, radius & 1)):
            if bit:
                equal = equal & c
            else:
                over, equal = over | (equal & c), equal & ~c
        return ~over

    for step in range(64):
        b = (first + step) % 64
        x = planes[block, b] ^ (np.uint64(0) - (query >> np.uint64(b) & one))
        x, c0 = x & c0, x ^ c0
        x, c1 = x & c1, x ^ c1
        x, c2 = x & c2, x ^ c2
        o |= x
        if step >= 15 and step % 4 == 3 and len(at):
            keep = np.flatnonzero(alive())
            if len(keep) < 0.8 * len(at):
                at, query, block, c0, c1, c2, o = (v[keep] for v in (at, query, block, c0, c1, c2, o))
    lanes = alive()
    keep = np.flatnonzero(lanes)
    return at[keep], lanes[keep]


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least node of each node's component, by label passing and pointer jumping."""
    root = np.arange(n) if root is None else root
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        new = root.copy()
        np.minimum.at(new, ra, low)
        np.minimum.at(new, rb, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def linked(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int, items: int = 1 << 16):
    """Spanning forest of the links inside each group: two arrays of indices.

    group must be sorted. side 0 and 1 are two chunks of a bucket: only pairs of
    unlike sides are compared; side 2 marks a chunk that is compared with itself.
    """
    n = len(fps)
    if not n:
        return np.zeros(0, int), np.zeros(0, int)
    new = np.r_[True, group[1:] != group[:-1]]
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, n])
    rank = np.arange(n) - np.repeat(begin, size)
    blocks = (size + 63) // 64
    block0 = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    slot = np.repeat(block0, size) * 64 + rank
    padded = np.zeros(total * 64, np.uint64)
    padded[slot] = fps
    back = np.full(total * 64, -1)
    back[slot] = np.arange(n)
    planes = _planes(padded)
    # each fingerprint meets its own block and the later ones of its group
    own = slot // 64
    last = np.repeat(block0 + blocks, size)
    todo = np.where(np.repeat(size, size) > 1, last - own, 0)
    root = np.arange(n)
    upto, at = np.cumsum(todo), 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + items, "right")))
        q = np.repeat(np.arange(at, end), todo[at:end])
        step = np.arange(len(q)) - np.repeat(upto[at:end] - todo[at:end] - (upto[at - 1] if at else 0), todo[at:end])
        hit, lanes = close_lanes(planes, fps[q], own[q] + step, radius)
        if len(hit):
            bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(bits)
            a, b = q[hit[i]], back[(own[q[hit[i]]] + step[hit[i]]) * 64 + lane]
            ok = (b > a) & ((side[a] == 2) | (side[a] != side[b]))
            if ok.any():
                root = _roots(n, a[ok], b[ok], root)
        at = end
    child = np.flatnonzero(root != np.arange(n))
    return root[child], child


def _forest(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        rows = 0

        def flush(df: pd.DataFrame) -> pa.RecordBatch:
            keys = df[["t", "k", "tile"]].to_numpy()
            group = np.r_[0, np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]
            fps = df["fp"].to_numpy().view(np.uint64)
            a, b = linked(fps, group, df["side"].to_numpy(), radius)
            return pa.RecordBatch.from_pydict({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

        for batch in batches:
            held.append(batch.to_pandas())
            rows += len(held[-1])
            if rows >= 1 << 17:  # all but the last, perhaps unfinished, group
                df = pd.concat(held, ignore_index=True)
                end = df.iloc[-1]
                open_ = ((df["t"] == end["t"]) & (df["k"] == end["k"]) & (df["tile"] == end["tile"])).to_numpy()
                if not open_.all():
                    yield flush(df[~open_])
                held, rows = [df[open_].reset_index(drop=True)], int(open_.sum())
        if rows:
            yield flush(pd.concat(held, ignore_index=True))

    return run


def links(fps: DataFrame, fp: str = "fp", radius: int = 4, tile_rows: int = 8192, n: int | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within radius; fps holds distinct fingerprints."""
    if not 0 <= radius < 8:
        raise ValueError("radius must be 0 to 7")
    n = fps.count() if n is None else n
    masks = band_masks(bands_for(n, radius), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col(fp).bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])
    rows = fps.select(F.col(fp).alias("fp"), F.explode(keys).alias("e")).select("fp", "e.t", "e.k")
    large = rows.groupBy("t", "k").agg(F.count("*").alias("c")).filter(F.col("c") > tile_rows)
    large = stored(large.select(F.col("t").alias("lt"), F.col("k").alias("lk"), F.ceil(F.col("c") / tile_rows).cast("int").alias("parts")), "simhash-large")
    if not large.isEmpty():
        chunk = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
        low, high = F.least("chunk", "j"), F.greatest("chunk", "j")
        rows = (
            rows.join(large, (F.col("t") == F.col("lt")) & (F.col("k") == F.col("lk")), "left")
            .withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("chunk", chunk)
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("t", "k", (low * F.lit(1 << 20) + high).alias("tile"), F.when(low == high, 2).when(F.col("chunk") == low, 0).otherwise(1).alias("side"), "fp")
        )
    else:
        rows = rows.select("t", "k", F.lit(0).alias("tile"), F.lit(2).alias("side"), "fp")
    dealt = rows.repartition("t", "k", "tile").sortWithinPartitions("t", "k", "tile")
    return dealt.mapInArrow(_forest(radius), "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches.

    Alternates large-star and small-star, each one aggregation (with map-side
    combine) and one join that AQE can split; every round is written and reread.
    """

    def star(e: DataFrame, least: DataFrame) -> DataFrame:
        return e.join(least, "u")

    cur = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(rounds):
        before = cur
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        cur = star(both, m).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        m = cur.groupBy("u").agg(F.min("v").alias("m"))
        joined = star(cur, m)
        cur = stored(joined.select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "cc")
        discard(before)
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row per document row: doc_id, fp (long), component_id, component_fp.

    component_id is the least doc_id (nulls last) of all documents whose
    fingerprints are connected by steps of at most radius bits, component_fp the
    least fingerprint of that component. Null and blank texts have fingerprint 0.
    Repeated rows stay repeated, an empty table gives an empty one.
    """
    fps = stored(with_fingerprint(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), shingle=shingle).select("doc_id", "fp"), "simhash-fp")
    return grouped(fps, radius)


def grouped(fps: DataFrame, radius: int = 4) -> DataFrame:
    """near_duplicates for rows (doc_id, fp) that are already stored."""
    first = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    comp = stored(components(stored(links(first, radius=radius), "simhash-edges")), "simhash-components")
    labelled = first.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("component_fp"))
    least = labelled.groupBy("component_fp").agg(F.min("first_id").alias("component_id"))
    table = stored(labelled.join(least, "component_fp").select("fp", "component_fp", "component_id"), "simhash-labels")
    return fps.join(table, "fp").select("doc_id", "fp", "component_id", "component_fp")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """docs with one document of each near-duplicate group: the one of least doc_id (nulls last).

    Rows that share that doc_id count as copies; the least row hash stays, and wholly
    equal rows once. Null, empty and blank texts are one group. No text is too long. All
    columns are kept, whatever their names; an empty table gives an empty one. Whole rows
    are shuffled once, by their hash; those that repeat once more, combined beforehand.
    """
    fp, row, n, win_row, win_id = (free_name(docs, x) for x in ("fp", "row", "row_count", "win_row", "win_id"))
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    marked = with_fingerprint(docs, text, fp, shingle).withColumn(row, hashed)
    slim = stored(marked.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row")), "simhash-fp")
    groups = grouped(slim.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), radius)
    rows = slim.groupBy("doc_id", "fp", "row").agg(F.count("*").alias("n")).join(groups.select("fp", "component_fp"), "fp")
    best = rows.groupBy("component_fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row", "n")).alias("best"))
    win = stored(best.select(F.col("best.row").alias(win_row), F.col("best.doc_id").alias(win_id), F.col("best.n").alias(n)), "simhash-kept")
    # the row hash alone is the key of the join: a group of copies is then split like any skewed key
    same = F.coalesce(F.col(f"`{doc_id}`") == F.col(win_id), F.col(f"`{doc_id}`").isNull() & F.col(win_id).isNull())
    kept = docs.withColumn(row, hashed).join(win, (F.col(row) == F.col(win_row)) & same)
    once, more = kept.filter(F.col(n) == 1), kept.filter(F.col(n) > 1).dropDuplicates([row])
    return once.unionByName(more).select(*[F.col(f"`{c}`") for c in docs.columns])
