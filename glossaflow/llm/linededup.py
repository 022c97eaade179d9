"""Substring dedup by hashing lines and the passages of the word stream.

Passages: the words of a text are one stream, whatever its lines. A cut comes behind
the word pair of least hash of every ``window`` neighbouring pairs, so cuts depend on
the words around them alone, are in step ``window`` words into a passage at the latest,
and are never more than ``window`` words apart. At each cut, and at the text's end, the
words back to the nearest cut that leaves ``least_unit`` words or more are hashed: a
short piece is never judged by itself and never breaks a run. What is lost of a passage
are the words before its first and behind its last cut. Whole lines are hashed besides,
and each that stands earlier goes, whatever its length; only lines without a letter or
digit stay.

Digests are grouped globally, and the occurrence of the least rank (doc_id, text, place)
stays. A task sends the least occurrence of a digest that it has seen to the digest's
group; the others can't be the one that stays, so they are dealt out by themselves. A
task knows a digest again by a table of the digests that it saw lately, and remembers
those that came twice, the most frequent ones if they are too many. So a line or passage
that stands in a third of all rows, or in one of some thousand, gives its group some rows
a task, and no group meets in one task as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, small_batches, spread

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


#: An odd factor and its inverse modulo 2**64.
_B = 0xC2B2AE3D27D4EB4F
_B_INVERSE = pow(_B, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def spans(text: str, least_unit: int = 6, window: int = 12, codes: dict[str, int] | None = None) -> np.ndarray:
    """Rows (digest, start, end, words, number of the last word) for each cut of the text, and for each line that has a letter or digit, with words below 0.

    A span's digest is a polynomial of its words' hashes, from prefix sums over the text.
    """
    codes = {} if codes is None else codes
    words = _WORD.findall(text.lower())
    n = len(words)
    if not n:
        return np.zeros((0, 5), np.int64)
    for w in {w for w in words if w not in codes}:
        codes[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(codes.__getitem__, words), np.uint64, n)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = (points != 32) & ((points < 9) | (points > 13))
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, stops = edges[::2], edges[1::2]

    cuts = np.zeros(1, np.int64)
    if n > window:
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        pair ^= pair >> np.uint64(29)
        least = np.lib.stride_tricks.sliding_window_view(pair, window).argmin(1)
        cuts = np.r_[cuts, np.unique(least + np.arange(len(least))) + 2]
    if cuts[-1] < n:
        cuts = np.r_[cuts, n]
    ends = cuts[1:][cuts[1:] >= least_unit]
    begins = cuts[np.searchsorted(cuts, ends - least_unit, "right") - 1]
    begins[:1] = 0  # what comes before the first cut is judged with it

    total = np.cumsum(np.r_[np.uint64(0), h * _powers(_B_INVERSE, n - 1)])
    up = _powers(_B, n)
    made = [_rows(_mixed((total[ends] - total[begins]) * up[begins]), starts, stops, begins, ends, ends - begins)]

    # whole lines; their digests differ from those of spans
    line = np.searchsorted(np.flatnonzero(points == 10), starts)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    last = np.r_[first[1:], n]
    keep = np.fromiter((any(map(str.isalnum, text[a:b])) for a, b in zip(starts[first].tolist(), stops[last - 1].tolist())), bool, len(first))
    first, last = first[keep], last[keep]
    digests = np.fromiter((xxhash.xxh3_64_intdigest(("\n" + " ".join(words[a:b])).encode("utf-8", "surrogatepass")) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))
    made.append(_rows(digests, starts, stops, first, last, first - last))
    return np.concatenate(made)


def _rows(digests: np.ndarray, starts: np.ndarray, stops: np.ndarray, begins: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([digests.view(np.int64), starts[begins], stops[ends - 1], words, ends - 1], 1)


#: What a row of a digest is: the least of its task so far; its text's first, but not the task's; a later one of its text; one that overlaps its text's first.
_LEAST, _FIRST, _LATER, _OVERLAPPING = 0, 1, 2, 3


class _Task:
    """Tells the rows of a task's batches apart, and leaves out those of a text that it has seen."""

    def __init__(self, slots: int = 1 << 20, held: int = 1 << 18) -> None:
        self.least: dict[int, list] = {}  # of digests that came twice: the least place so far, and how often they came
        self.lately = np.zeros(slots, np.int64)
        self.held = held

    def _again(self, digest: np.ndarray) -> np.ndarray:
        """Whether distinct digests are among those seen lately, which they are from now on."""
        slot = (digest.view(np.uint64) % np.uint64(len(self.lately))).astype(np.int64)
        known = self.lately[slot] == digest
        self.lately[slot] = digest
        return known

    def _forget(self) -> None:
        """Keeps the more frequent half; their counts halve, so that later ones can rise."""
        by = sorted(self.least.items(), key=lambda x: -x[1][1])[: self.held // 2]
        self.least = {d: [place, n // 2] for d, (place, n) in by}

    def kinds(self, owner: np.ndarray, made: np.ndarray, docs: list[tuple]) -> np.ndarray:
        """The kind of each row (digest, start, end, words, no), -1 for one to leave out; docs: (no id, id, text key) of each text."""
        order = sorted(set(docs))
        number = {d: i for i, d in enumerate(order)}
        rank = np.array([number[d] for d in docs], np.int64)[owner]
        at = np.lexsort((made[:, 4], rank, made[:, 0]))
        digest, doc, no, words = made[at, 0], rank[at], made[at, 4], np.abs(made[at, 3])
        new = np.r_[True, digest[1:] != digest[:-1]]  # a digest's least row in this batch
        in_text = new | np.r_[True, doc[1:] != doc[:-1]]  # and in its text
        kind = np.where(new, _LEAST, np.where(in_text, _FIRST, _LATER))
        first = np.maximum.accumulate(np.where(in_text, np.arange(len(at)), 0))
        kind[~in_text & (no - words < no[first])] = _OVERLAPPING
        kind[~in_text & (no == np.r_[-1, no[:-1]])] = -1  # the same text again
        begin = np.flatnonzero(new)
        size, again = np.diff(np.r_[begin, len(at)]), self._again(digest[begin])
        for i, d, n, known in zip(begin.tolist(), digest[begin].tolist(), size.tolist(), (again | (size > 1)).tolist()):
            was = self.least.get(d)
            if was is None and not known:
                continue
            here = (*order[doc[i]], int(no[i]))
            if was is None:
                self.least[d] = [here, n]
                continue
            was[1] += n
            if here < was[0]:
                was[0] = here
            else:
                kind[i] = _FIRST if here != was[0] else -1
        if len(self.least) > self.held:
            self._forget()
        out = np.empty(len(at), np.int64)
        out[at] = kind
        return out


def _scan(least_unit: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task()
        for batch in batches:
            if not len(batch):
                continue
            codes: dict[str, int] = {}
            rows = [spans(t or "", least_unit, window, codes) for t in batch.column(1).to_pylist()]
            made = np.concatenate(rows)
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            docs = [(i is None, "" if i is None else i, k) for i, k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            kind = task.kinds(owner, made, docs)
            keep = np.flatnonzero(kind >= 0)
            parent, made, kind = pa.array(owner[keep]), made[keep], kind[keep]
            ids, keys = batch.column(0).take(parent), batch.column(2).take(parent)
            for at in range(0, len(made), 1 << 16):
                s = slice(at, at + (1 << 16))
                columns = {name: made[s, i].astype(np.int32) for name, i in (("no", 4), ("start", 1), ("end", 2), ("words", 3))}
                yield pa.RecordBatch.from_pydict({"doc_id": ids[s], "tk": keys[s], "digest": made[s, 0]} | columns | {"kind": kind[s].astype(np.int8)})

    return run


def _place():
    """What occurrences are ranked by."""
    return F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "tk", "no")


def _found(docs: DataFrame, doc_id: str, text: str, least_unit: int, window: int) -> DataFrame:
    """(doc_id, tk, digest, no, start, end, words, kind): the spans and lines of all texts."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("tk", F.xxhash64("text"))
    name = rows.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {name}, tk long, digest long, no int, start int, end int, words int, kind byte"
    return spread(rows).select("doc_id", "text", "tk").mapInArrow(_scan(least_unit, window), columns)


def keepers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_unit: int = 6, window: int = 12) -> DataFrame:
    """(digest, doc_id, tk, start, end, words, n): of each line (words below 0) or span that stands in several places, the place that keeps it, and how many they are (a repeated row counts once a batch).

    An aggregation with map-side combine: no group comes together. A removed part is a
    run of such spans, whose digests spans() gives.
    """
    found = _found(docs, doc_id, text, least_unit, window)
    per = found.groupBy("digest").agg(F.min_by(F.struct("doc_id", "tk", "start", "end", "words"), _place()).alias("kept"), F.count("*").alias("n"))
    return per.filter("n > 1").select("digest", "kept.*", "n")


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_unit: int = 6, least_run: int | None = 20, window: int = 12) -> DataFrame:
    """One row per removed part: doc_id, tk (text key), start, end, words.

    Parts are whole lines that stand earlier, of any length, and runs of least_run
    words or more of spans that overlap or touch, across line ends (None: lines only);
    parts that overlap or touch are one. Ranks go by doc_id, nulls last, then text hash,
    then place; rows of the same doc_id and text are one document. Lines without a
    letter or digit (rules, brackets) stay. Null and empty texts have no parts, an empty
    table gives an empty one, and no text is too long. Offsets are code points.
    """
    found = _found(docs, doc_id, text, least_unit, window)
    if least_run is None:
        found = found.filter("words < 0")
    place = _place()
    # a window over one exchange: a join would run the Python stage, or write its rows, and shuffle them twice
    dealt = F.when(F.col("kind") == _LEAST, F.lit(0)).otherwise(F.xxhash64("tk", "no")).alias("deal")
    found = found.select("*", dealt)
    again = found.withColumn("first", F.min(place).over(Window.partitionBy("digest", "deal"))).filter((F.col("kind") != _LEAST) | (place != F.col("first")))
    again = again.select("doc_id", "tk", "digest", "no", "start", "end", "kind", (F.col("words") < 0).alias("line"), (F.col("no") - F.abs("words")).alias("begin"))  # begin: the number of the word before
    again = again.repartition("doc_id", "tk")
    # one that reaches into its text's first of that digest goes only if that one goes
    goes = (F.col("kind") < _OVERLAPPING) | (F.min("kind").over(Window.partitionBy("doc_id", "tk", "digest")) <= _FIRST)
    again = again.withColumn("goes", goes).filter("goes")
    again = again.groupBy("doc_id", "tk", "no", "line").agg(*[F.first(c).alias(c) for c in ("start", "end", "begin")])
    runs = _joined(again, "line")
    if least_run is not None:
        runs = runs.filter(F.col("line") | (F.col("no") - F.col("begin") >= least_run))
    return _joined(runs).select("doc_id", "tk", "start", "end", (F.col("no") - F.col("begin")).alias("words"))


def _joined(parts: DataFrame, *by: str) -> DataFrame:
    """parts (begin, no], with those of the same text that overlap or touch made one."""
    keys = ["doc_id", "tk", *by]
    order = Window.partitionBy(*keys).orderBy("begin", "no")
    apart = F.coalesce(F.col("begin") > F.max("no").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    runs = parts.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("begin").alias("begin"), F.max("no").alias("no")).drop("run")


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """docs with repeated parts cut out of text, and removed: array of (start, end) in the original text.

    removed gets underscores before it if docs has it, and extra columns stay whatever
    their names. Null texts stay null, empty ones empty; a text that repeats as a whole
    becomes empty, but its row stays. Rows of the same doc_id and text lose the same. An
    empty table gives an empty one.
    """
    out, key, sid, stk, spans = (free_name(docs, n) for n in ("removed", "tk", "span_id", "span_tk", "spans"))
    found = passages(docs, doc_id, text, **kw).groupBy("doc_id", "tk").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans))
    found = found.select(F.col("doc_id").alias(sid), F.col("tk").alias(stk), spans)
    t = F.col(f"`{text}`")
    df = docs.withColumn(key, F.xxhash64(t))
    df = df.join(found, F.col(f"`{doc_id}`").eqNullSafe(F.col(sid)) & (F.col(key) == F.col(stk)), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ends: pd.Series) -> pd.Series:
        made = []
        for t, e in zip(texts, ends):
            if t is None or e is None:
                made.append(t)
                continue
            at = [0, *(int(x) for x in e), len(t)]
            made.append("".join(t[a:b] for a, b in zip(at[::2], at[1::2])))
        return pd.Series(made, dtype=object)

    ends = F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"])))
    others = {c: F.col(f"`{c}`") for c in docs.columns} | {text: cut(t, ends).alias(text)}
    none = F.array().cast("array<struct<start:int,end:int>>")
    return df.select(*[others[c] for c in docs.columns], F.coalesce(spans, none).alias(out))
