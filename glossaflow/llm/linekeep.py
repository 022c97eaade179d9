"""Line dedup: keep bitmaps from a range-partitioned stream of line hashes.

A scan turns each text into 128-bit hashes of its distinct line keys and the lines that
have them; texts stay where they are. The rows (hash, document, lines) are partitioned
by ranges of (hash, document, row), each sorted, largest document first, and streamed:
the first row of a hash names the document that keeps its lines, the rest lose theirs
once enough documents have been seen. A stream holds fewer than ``min_docs`` rows.

Ranges take the document in, so a line that a third of all documents hold is spread
over as many partitions as its rows fill. A hash that goes across a partition's edge
can't be decided there: a partition hands on the rows of the hash that it begins with,
and a count and the keeper of the one that it ends with. The decisions on these, at
most two a partition, are a small table that joins the handed-on rows.

The result is a bitmap a document, as run lengths, not texts; ``apply`` cuts the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, free_name, small_batches, spread, stored


def line_keys(text: str | None, min_chars: int = 20) -> tuple[int, dict[bytes, list[int]]]:
    """Number of lines, and the lines of each key hash with min_chars code points or more."""
    lines = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split(b"\n")
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate(lines):
        key = line.strip()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            found.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
    return len(lines), found


def to_bitmap(n_lines: int, dropped) -> bytes:
    """Keep bits of a document's lines as run lengths, kept and dropped by turns, in 7-bit groups; empty if all stay."""
    gone = np.unique(np.asarray(dropped, np.int64))
    if not len(gone):
        return b""
    keep = np.ones(n_lines, bool)
    keep[gone] = False
    edges = np.flatnonzero(keep[1:] != keep[:-1]) + 1
    runs = np.diff(np.r_[0, edges, n_lines]).tolist()
    out = bytearray()
    for run in runs if keep[0] else [0, *runs]:
        while run > 127:
            out.append(run & 127 | 128)
            run >>= 7
        out.append(run)
    return bytes(out)


def from_bitmap(n_lines: int, bits: bytes) -> np.ndarray:
    """The keep bits as an array of booleans."""
    runs, value, shift = [], 0, 0
    for b in bits:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            runs.append(value)
            value, shift = 0, 0
    return np.repeat(np.arange(len(runs)) % 2 == 0, runs) if runs else np.ones(n_lines, bool)


_SCAN = "doc_id long, t1 long, t2 long, n_lines int, h1 array<long>, h2 array<long>, lines array<array<int>>"


def _scan(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, outer, inner, digests, places = [], [0], [0], [], []
            for text in batch.column(3).to_pylist():
                n, found = line_keys(text, min_chars)
                n_lines.append(n)
                digests.extend(found)
                for at in found.values():
                    places.extend(at)
                    inner.append(len(places))
                outer.append(len(digests))
            h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            ends = pa.array(outer, pa.int32())
            lines = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(places, pa.int32()))
            lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(h[:, 0]), pa.array(h[:, 1]), lines)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_lines, pa.int32()), *lists], names=["doc_id", "t1", "t2", "n_lines", "h1", "h2", "lines"])

    return run


_STREAM = "h1 long, h2 long, doc_id long, row long, lines array<int>, docs long"


def _stream(min_docs: int):
    """Rows sorted by (h1, h2, doc_id descending, row) to dropped rows (docs 0), and rows or totals that other partitions may change (docs above 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = keeper = None  # of the unfinished run, keeper as (no id, id)
        docs, head, held = 0, True, None  # rows of it so far, whether it began the partition, rows not decided yet

        def rows(batch: pa.RecordBatch, mask: np.ndarray, count: int) -> pa.RecordBatch:
            some = batch.filter(pa.array(mask))
            return pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(some.num_rows, count), pa.int64())], names=_NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held, docs = None, 0
            h = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
            void = np.asarray(batch.column(2).is_null())
            ids = batch.column(2).fill_null(0).to_numpy()
            start = np.flatnonzero(np.r_[True, (h[:, 1:] != h[:, :-1]).any(axis=0)])
            size = np.diff(np.r_[start, batch.num_rows])
            of = np.repeat(np.arange(len(start)), size)
            total, keep_void, keep_id = size.copy(), void[start], ids[start]
            first = (int(h[0, 0]), int(h[1, 0]))
            if key is None:
                key = first
            open_ = head and first == key
            if first == key:
                total[0] += docs
                if docs:
                    keep_void[0], keep_id[0] = keeper
            other = (void != keep_void[of]) | (ids != keep_id[of])
            gone = other & (total[of] >= min_docs)
            if open_:
                gone &= of > 0
                yield rows(batch, of == 0, 1)
            yield rows(batch, gone, 0)
            key, keeper, docs, head = (int(h[0, -1]), int(h[1, -1])), (bool(keep_void[-1]), int(keep_id[-1])), int(total[-1]), open_ and len(start) == 1
            if not head and docs < min_docs:
                held = batch.slice(int(start[-1]))
        if held is not None:
            yield rows(held, np.ones(held.num_rows, bool), 1)
        elif key is not None and not head:
            yield pa.RecordBatch.from_pydict(dict(zip(_NAMES, ([key[0]], [key[1]], [None if keeper[0] else keeper[1]], [None], [None], [docs]))), schema=_ARROW)

    return run


_NAMES = ["h1", "h2", "doc_id", "row", "lines", "docs"]
_ARROW = pa.schema([*((n, pa.int64()) for n in _NAMES[:4]), ("lines", pa.list_(pa.int32())), ("docs", pa.int64())])


def _text_key(text: str) -> list:
    c = F.col(f"`{text}`")
    return [F.xxhash64(c), F.xxhash64(F.lit(7), c)]


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, t1, t2 (the text's 128-bit hash), n_lines, n_dropped, bitmap.

    A line's key is the line, ASCII white space off both ends, A-Z lower-cased. Keys of
    min_chars code points or more that min_docs rows of docs hold lose all their lines,
    except in rows of the largest doc_id that holds them (null is the least). A null or
    empty text is one empty line, which is never dropped. Repeated rows count as
    documents and share a result; an empty table gives an empty one. Long texts are
    taken whole; no other column is read.
    """
    small_batches(docs.sparkSession)
    c = F.col(f"`{text}`")
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), *[k.alias(n) for k, n in zip(_text_key(text), ("t1", "t2"))], c.alias("text"))
    found = stored(spread(slim).mapInArrow(_scan(min_chars), _SCAN).withColumn("row", F.monotonically_increasing_id()), "linekeep-keys")
    rows = found.select("doc_id", "row", F.explode(F.arrays_zip("h1", "h2", "lines")).alias("k")).select("k.h1", "k.h2", "doc_id", "row", "k.lines")
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last(), "row"]
    told = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), _STREAM), "linekeep-told")
    edge = told.filter("docs > 0").groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs)
    # two keys a partition at most
    late = told.filter("docs > 0 AND row IS NOT NULL").join(F.broadcast(edge), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = told.filter("docs = 0").select("row", "lines").unionByName(late.select("row", "lines"))
    per = gone.groupBy("row").agg(F.flatten(F.collect_list("lines")).alias("dropped"))

    @F.pandas_udf("binary")
    def bitmap(n: pd.Series, dropped: pd.Series) -> pd.Series:
        return pd.Series([to_bitmap(int(a), () if b is None else b) for a, b in zip(n, dropped)], dtype=object)

    done = found.select("row", "doc_id", "t1", "t2", "n_lines").join(per, "row", "left")
    n = F.coalesce(F.size("dropped"), F.lit(0))
    once = done.select("doc_id", "t1", "t2", "n_lines", F.when(n > 0, n).otherwise(0).alias("n_dropped"), bitmap("n_lines", "dropped").alias("bitmap"))
    return once.dropDuplicates(["doc_id", "t1", "t2"])


def apply(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with only the kept lines in their texts, and the columns n_lines and n_dropped.

    Null texts become empty. All columns stay; the new ones get underscores before them
    where docs has such a name. Texts move to the bitmaps of those documents that lose
    lines; if these are few, Spark sends the bitmaps to the texts.
    """
    small_batches(docs.sparkSession)
    t1, t2, bits = (free_name(docs, x) for x in ("t1", "t2", "bitmap"))
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ns: pd.Series, maps: pd.Series) -> pd.Series:
        out = []
        for t, n, m in zip(texts, ns, maps):
            if t is None or m is None:
                out.append(None)
                continue
            keep = from_bitmap(int(n), m)
            out.append("\n".join(line for line, k in zip(t.split("\n"), keep.tolist()) if k))
        return pd.Series(out, dtype=object)

    c = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    some = bitmaps.filter("n_dropped > 0").select(F.col("doc_id").alias("_k0"), F.col("t1").alias("_k1"), F.col("t2").alias("_k2"), F.col("n_dropped").alias(n_dropped), F.col("n_lines").alias("_k3"), F.col("bitmap").alias(bits))
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("_k0")) & (F.col(t1) == F.col("_k1")) & (F.col(t2) == F.col("_k2"))
    keyed = docs.withColumns(dict(zip((t1, t2), _text_key(text)))).join(some.hint("shuffle_hash"), same, "left")
    lost = F.col(bits).isNotNull()
    kept = F.when(lost, cut(F.when(lost, c), F.col("_k3"), F.col(bits))).otherwise(c)
    lines = (F.length(c) - F.length(F.replace(c, F.lit("\n"))) + 1).cast("long")
    columns = [kept.alias(x) if x == text else F.col(f"`{x}`") for x in docs.columns]
    return keyed.select(*columns, lines.alias(n_lines), F.coalesce(F.col(n_dropped), F.lit(0)).cast("long").alias(n_dropped))
