"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

The windows of the test items (13 words; a shorter item is one window) go into a
hash set that is broadcast in blocks of at most ``block_words`` item words: one
block in the usual case, and as many narrow passes over the texts as there are
blocks for an oversize test set. Documents are never shuffled.

A document's words are mapped to the ids of item words (unknown: -1); only runs of
known words can hold a window. Rolling hashes of the runs are looked up in the
set, and each hit is verified word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, small_batches, spread, stored

#: Bytes that belong to words after lower-casing A-Z; all others become spaces.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class Windows:
    """The windows of a block of items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.ids: dict[bytes, int] = {}
        self.items = [name for name, _ in items]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[int, ...]], list[list[int]]]] = {}
        found: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for i, (_, words) in enumerate(items):
            seq = [self.ids.setdefault(w, len(self.ids)) for w in words]
            n = min(width, len(seq))
            for at in range(len(seq) - n + 1) if n else ():
                owners = found.setdefault(n, {}).setdefault(tuple(seq[at : at + n]), [])
                if not owners or owners[-1] != i:
                    owners.append(i)
        for n, windows in found.items():
            keys = list(windows)
            h = self._hash(np.array(keys, np.int64), n)
            order = np.argsort(h, kind="stable")
            self.by_length[n] = (h[order], order, keys, [windows[k] for k in keys])

    @staticmethod
    def _hash(rows: np.ndarray, n: int) -> np.ndarray:
        """Of each row of n word ids."""
        h = np.zeros(len(rows), np.uint64)
        for j in range(n):
            h = h * np.uint64(_BASE) + (rows[:, j].astype(np.uint64) + np.uint64(1)) * _MIX
        return h

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie inside an occurrence, and the items that occur."""
        hit = np.zeros(len(words) + 1, np.int64)
        items: set[int] = set()
        get = self.ids.get
        seq = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        for n, (hashes, order, keys, owners) in self.by_length.items():
            if len(seq) < n:
                continue
            unknown = np.cumsum(np.r_[0, seq < 0])
            start = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(start):
                continue
            h = self._hash(seq[start[:, None] + np.arange(n)], n)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                at = int(start[k])
                here = tuple(seq[at : at + n].tolist())
                for slot in order[lo[k] : hi[k]].tolist():
                    if keys[slot] == here:
                        hit[at] += 1
                        hit[at + n] -= 1
                        items.update(owners[slot])
        return np.cumsum(hit)[:-1] > 0, items


def _blocks(benchmark: DataFrame, item_id: str, text: str, width: int, block_words: int) -> Iterator[Windows]:
    """The items in blocks of about block_words words; each block is all that the driver holds at a time."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t"))
    total = rows.agg(F.sum(F.coalesce(F.length("t"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-int(total) // (4 * block_words)))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        items = [(r["i"], words_of(r["t"])) for r in part.toLocalIterator()]
        # an item without an id can't be listed; its windows still count as hits
        yield Windows([("" if i is None else i, w) for i, w in items], width)


_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _scanner(shared, first: bool):
    """A pass over the texts with one block of windows; later passes add to what earlier ones found."""

    def find(texts: pa.Array, before: pa.Array | None) -> pa.Array:
        windows, made = shared.value, []
        old = before.to_pylist() if before is not None else None
        for i, t in enumerate(texts.to_pylist()):
            words = words_of(t)
            hit, items = windows.hits(words)
            names = [windows.items[j] for j in items]
            if old is not None:
                for a, b in zip(old[i]["spans"][::2], old[i]["spans"][1::2]):
                    hit[a:b] = True
                names += old[i]["items"]
            edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
            made.append({"n_words": len(words), "spans": edges.tolist(), "items": sorted(set(names))})
        return pa.array(made, _FOUND_ARROW)

    def once(texts: pa.Array) -> pa.Array:
        return find(texts, None)

    def again(texts: pa.Array, before: pa.Array) -> pa.Array:
        return find(texts, before)

    return F.arrow_udf(once if first else again, _FOUND)


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, share: int = 20, block_words: int = 2_000_000
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (word ranges, end exclusive).

    contaminated: n_hit > 0 and share * n_hit >= n_words. Null and empty texts have
    no words and are clean; items without words have no windows; repeated items are
    listed once for each row of the benchmark with another id. Names get
    underscores before them if docs has them. An empty benchmark contaminates nothing,
    repeated rows fare alike, an empty table gives an empty one. Whole texts are read,
    however long, in memory in proportion to a text's words.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    state = free_name(docs, "hit_state")
    out = spread(docs)
    for k, windows in enumerate(_blocks(benchmark, item_id, item_text, width, block_words)):
        if k:  # what the blocks so far found is written, so a worker holds one block at a time
            out = stored(out, "decontaminate-found")
        scan = _scanner(sc.broadcast(windows), k == 0)
        out = out.withColumn(state, scan(F.col(f"`{text}`"), *([F.col(state)] if k else [])))
    s = F.col(state)
    spans = F.when(F.size(s["spans"]) > 0, F.transform(F.sequence(F.lit(0), (F.size(s["spans"]) / 2 - 1).cast("int")), lambda i: F.struct(F.get(s["spans"], i * 2).alias("start"), F.get(s["spans"], i * 2 + 1).alias("end")))).otherwise(F.array().cast("array<struct<start:long,end:long>>"))
    names = {n: free_name(docs, n) for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")}
    out = out.withColumn(names["hit_spans"], spans)
    n_hit = F.aggregate(names["hit_spans"], F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    out = out.withColumn(names["n_hit"], n_hit)
    hit = F.col(names["n_hit"])
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        s["n_words"].alias(names["n_words"]),
        hit,
        F.size(s["items"]).cast("long").alias(names["n_items"]),
        F.sha2(F.array_join(s["items"], ","), 256).alias(names["items_sha256"]),
        ((hit > 0) & (hit * share >= s["n_words"])).alias(names["contaminated"]),
        F.col(names["hit_spans"]),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """docs without the contaminated ones; all columns are kept, whatever their names.

    Null and empty texts stay, repeated rows fare alike, an empty table gives an empty one.
    """
    flag = free_name(docs, "contaminated")
    found = contamination(docs, benchmark, **kw)
    return found.filter(~F.col(flag)).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()
