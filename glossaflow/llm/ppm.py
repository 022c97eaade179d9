"""Language-model scoring by prediction by partial matching over bytes.

The trie holds all contexts of up to five bytes with the counts of the symbols that
follow (255 possible: the bytes of UTF-8 and an end). Counting is distributed: each
task turns its texts into 6-byte keys (five bytes of context and a symbol), and equal
keys are summed by Spark. Keys of texts outside the training set count 0.

Probabilities: method C escapes with symbol exclusion. A symbol's probability is fixed
by its key once counting is done, and the symbols of a context are among those of
each of its suffixes, so the keys that share the last three bytes of the context are
worked out together, with the counts of all contexts of two bytes (2**24 symbols at
most, in text some hundred thousand) at hand. The (key, log10 probability) table stays distributed;
scoring is a lookup and a sum. The table goes out in blocks of about
``block_cells`` / 10 keys, a pass over the texts each, so no block grows with the corpus.

Beside the trie, the base model: add-half unigram probabilities of words. Words are
counted with map-side combine. Those above ``rate`` of all words, at most 1 / rate of
them, are scored in the scan; only the pairs of a rarer word and a text are shuffled by
word, so no word brings its texts together in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, free_name, small_batches, spread, stored

#: Bytes that UTF-8 never has: what precedes a text, and what ends it.
_PAD, _END = 0xFE, 0xFF
_SYMBOLS = 255  # all bytes but _PAD
#: Bytes of the longest contexts.
ORDER = 5


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """6-byte keys (five bytes of context, symbol) of all symbols, and how many each text has."""
    edge = bytes([_END] + [_PAD] * ORDER)
    flat = np.frombuffer(edge[1:] + edge.join(texts) + edge[:1], np.uint8).astype(np.uint64)
    n = len(flat) - ORDER
    keys = np.zeros(n, np.uint64)
    for j in range(ORDER + 1):
        keys = keys << np.uint64(8) | flat[j : j + n]
    return keys[flat[ORDER:] != _PAD].view(np.int64), np.array([len(t) + 1 for t in texts], np.int64)


def _parts(texts: list[bytes], size: int = 1 << 21) -> Iterator[list[bytes]]:
    part, n = [], 0
    for t in texts:
        if part and n + len(t) > size:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t)
    if part:
        yield part


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        k = np.concatenate([keys, *(w[0] for w in waiting)])
        c = np.concatenate([n, *(w[1] for w in waiting)])
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
        return k[first], np.add.reduceat(c, first) if len(k) else c

    for batch in batches:
        texts, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for flag in (True, False):
            for part in _parts([_bytes(t) for t, f in zip(texts, flags) if bool(f) == flag]):
                k, c = np.unique(_keys(part)[0], return_counts=True)
                waiting.append((k, c * flag))
                if len(waiting) >= 16:
                    keys, n = merged()
                    waiting = []
    keys, n = merged()
    for at in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_pydict({"k": keys[at : at + (1 << 16)], "n": n[at : at + (1 << 16)].astype(np.int64)})


def count_contexts(docs: DataFrame, text: str = "text", train: Column | None = None) -> DataFrame:
    """(k, n): each 6-byte key of docs, and how often the training texts (all, without train) have it."""
    small_batches(docs.sparkSession)
    slim = spread(docs.select(F.col(f"`{text}`").alias("text"), (F.lit(True) if train is None else train).alias("train")))
    return stored(slim.mapInArrow(_count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "ppm-counts")


class Places:
    """Finds keys in a set: tables of slots, each holding the keys that met a taken slot in the one before."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.r_[keys, -1].astype(np.int64)
        self.levels: list[np.ndarray] = []
        left = np.arange(len(keys))
        while len(left):
            bits = max(4, int(8 * len(left)).bit_length())
            slots = np.full(1 << bits, len(keys), np.int32)
            at = self._slot(keys[left], bits)
            slots[at] = left
            self.levels.append(slots)
            left = left[slots[at] != left]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or the number of keys if it is none of them."""
        none = len(self.keys) - 1
        out = np.full(len(keys), none, np.int32)
        rest = np.arange(len(keys))
        for slots in self.levels:
            i = slots[self._slot(keys[rest], len(slots).bit_length() - 1)]
            ok = self.keys[i] == keys[rest]
            out[rest[ok]] = i[ok]
            rest = rest[(i != none) & ~ok]  # a free slot means that later levels have none either
            if not len(rest):
                break
        return out


class Block:
    """Some keys of the table and their log10 probabilities."""

    def __init__(self, keys: np.ndarray, p: np.ndarray):
        self.keys, self.p = keys, np.r_[p, 0].astype(np.float32)
        self._places: Places | None = None

    def __getstate__(self):
        return self.__dict__ | {"_places": None}

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """Of each text, the sum over the symbols whose key is in this block."""
        if self._places is None:
            self._places = Places(self.keys)
        out = []
        for part in _parts(texts, 1 << 19):
            keys, sizes = _keys(part)
            out.append(np.add.reduceat(self.p[self._places.find(keys)].astype(np.float64), np.cumsum(sizes) - sizes))
        return np.concatenate(out) if out else np.zeros(0)


def short_levels(twos: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, counts) of the contexts of no, one and two bytes; twos: sorted keys of two bytes of context and a symbol, n: their counts."""
    out = []
    for k in range(3):
        node, where = np.unique(twos[n > 0] & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        out.append((node, np.bincount(where, n[n > 0], len(node))))
    return out


def probabilities(keys: np.ndarray, n: np.ndarray, short: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 of each key's probability.

    keys: distinct; with a key come all of the corpus that share the last three bytes of
    its context. n: their counts; short: short_levels() of the corpus.
    """
    levels = []  # by length of context: nodes, their counts, contexts, and of each its nodes' range, total and symbols
    for k in range(ORDER + 1):
        if k > 2:
            node, where = np.unique(keys[n > 0] & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(where, n[n > 0], len(node))
        else:
            node, count = short[k]
            if k == 2:
                here = np.isin(node >> 8, np.unique(keys >> 8 & 0xFFFF))
                node, count = node[here], count[here]
        ctx, where, d = np.unique(node >> 8, return_inverse=True, return_counts=True)
        total = np.bincount(where, count, len(ctx))
        # what the symbols of each context make up in the context a byte shorter
        known = np.zeros(len(ctx))
        if k and len(node):
            shorter, its_count = levels[-1][0], levels[-1][1]
            known = np.bincount(where, its_count[np.searchsorted(shorter, node & ((1 << 8 * k) - 1))], len(ctx))
        levels.append((node, count, ctx, total, d, known))

    out = np.zeros(len(keys))
    done = np.zeros(len(keys), bool)
    gone_n, gone_d = np.zeros(len(keys)), np.zeros(len(keys))  # what longer contexts exclude here

    def find(have: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
        return at, have[at] == want if len(have) else np.zeros(len(want), bool)

    for k in range(ORDER, -1, -1):
        node, count, ctx, total, d, known = levels[k]
        if not len(node):
            continue
        key = keys & ((1 << 8 * (k + 1)) - 1)
        at, here = find(ctx, key >> 8)
        where, seen = find(node, key)
        new = np.where(here, d[at] - gone_d, 0)
        whole = np.where(here, total[at] - gone_n, 0) + new
        hit, miss = here & ~done & seen, here & ~done & ~seen & (new > 0)
        out[hit] += np.log10(count[where[hit]] / whole[hit])
        out[miss] += np.log10(new[miss] / whole[miss])
        done |= hit
        gone_n, gone_d = np.where(here, known[at], gone_n), np.where(here, d[at], gone_d)
    out[~done] -= np.log10(np.maximum(_SYMBOLS - len(levels[0][0]), 1))
    return out


def _worked_out(shared, rows: int = 1 << 18):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            p = probabilities(keys, n, shared.value).astype(np.float32)
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_pydict({"k": keys[at : at + (1 << 16)], "p": p[at : at + (1 << 16)]})

        held = np.zeros((0, 2), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(2)], 1)])
            if len(held) >= rows:  # all but the last, perhaps unfinished, group
                last = held[:, 0] >> 8 & 0xFFFFFF
                end = int(np.searchsorted(last, last[-1]))
                if end:
                    yield from work(held[:end, 0].copy(), held[:end, 1])
                    held = held[end:]
        if len(held):
            yield from work(held[:, 0].copy(), held[:, 1])

    return run


def fit(docs: DataFrame, text: str = "text", block_cells: int = 40_000_000, *, train: Column | None = None) -> Iterator[Block]:
    """Blocks of the table of all keys of docs, learned from the rows that train tells (all, without it)."""
    counts = count_contexts(docs, text, train)
    twos = counts.groupBy(F.col("k").bitwiseAND(F.lit(0xFFFFFF)).alias("k")).agg(F.sum("n").alias("n")).sort("k").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(short_levels(twos["k"].to_numpy(), twos["n"].to_numpy()))
    last = F.shiftright("k", 8).bitwiseAND(F.lit(0xFFFFFF))
    dealt = counts.select("k", "n", last.alias("last")).repartition("last").sortWithinPartitions("last")
    table = stored(dealt.mapInArrow(_worked_out(shared), "k long, p float"), "ppm-table")
    blocks = max(1, -(-table.count() // max(1, block_cells // 10)))
    for b in range(blocks):
        found = table.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).toArrow()  # as rows, a block would take the driver a GB
        yield Block(found["k"].to_numpy(), found["p"].to_numpy())


def with_score(docs: DataFrame, tries: Iterator[Block], text: str = "text", out: str = "ppm_log10") -> DataFrame:
    """docs and the log10 probability of each whole text, its end included; null counts as empty.

    out gets underscores before it if docs has it. Equal texts get equal scores, an
    empty table gives an empty one, no text is too long. Each block is a pass over the
    texts, whose sums are stored, so a worker holds one block at a time.
    """
    key, name = free_name(docs, "tk"), free_name(docs, out)
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    sums = text_scores(docs, tries, text).select(F.col("tk").alias(f"{key}_"), F.col("score").alias(name))
    return marked.join(sums, F.col(key) == F.col(f"{key}_")).select(*[F.col(f"`{c}`") for c in docs.columns], name)


def text_scores(docs: DataFrame, tries: Iterator[Block], text: str = "text") -> DataFrame:
    """(tk, score) for each distinct text; tk is its 64-bit key."""
    spark = docs.sparkSession
    small_batches(spark)
    t = F.col(f"`{text}`")
    slim = spread(docs.select(t.alias("text"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("tk")))
    parts: DataFrame | None = None
    for trie in tries:
        shared = spark.sparkContext.broadcast(trie)
        part = stored(slim.select("tk", _scorer(shared)(F.col("text")).alias("score")), "ppm-scores")
        shared.destroy()
        part = part.groupBy("tk").agg(F.max("score").alias("score"))  # copies score alike
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("tk").agg(F.sum("score").alias("score"))


def _scorer(shared):
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.log10([_bytes(t) for t in texts]))

    score.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, "double")


_digest = xxhash.xxh3_64_intdigest


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, c, n): how often a task's training texts, and all its texts, have a word, by the word's hash."""
    for batch in _whole(batches):
        found = [Counter(), Counter()]
        for t, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found[bool(train)].update(_bytes(t).translate(LOWER_ASCII).split())
        rest, learned = found
        words = list(rest.keys() | learned.keys())
        c = np.fromiter((learned[w] for w in words), np.int64, len(words))
        n = c + np.fromiter((rest[w] for w in words), np.int64, len(words))
        w = np.fromiter(map(_digest, words), np.uint64, len(words)).view(np.int64)
        for at in range(0, len(w), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_pydict({"w": w[cut], "c": c[cut], "n": n[cut]})


def _whole(batches: Iterator[pa.RecordBatch], size: int = 32 << 20) -> Iterator[pa.Table]:
    """Batches put together to tables of about size bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _pairs(shared):
    """Rows (tk, w, tf, s, known, words) of a stage over (text, tk).

    One row a text has the frequent words' part of the sum, with tf 0, and a w that
    brings nothing together; one for each of its other words has the rest to be found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, value, seen = shared.value
        row = 0
        codes: dict[bytes, int] = {}
        for batch in batches:
            words: list[bytes] = []
            times: list[int] = []
            sizes: list[int] = []
            for t in batch.column(0).to_pylist():
                found = Counter(_bytes(t).translate(LOWER_ASCII).split())
                words += found
                times += found.values()
                sizes.append(len(found))
            if len(codes) > 1 << 19:
                codes.clear()
            for x in {x for x in words if x not in codes}:
                codes[x] = _digest(x)
            w, n = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)), np.array(times, np.int64)
            owner, texts = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
            at = np.minimum(np.searchsorted(frequent, w), len(frequent) - 1)
            hit = frequent[at] == w
            tk = batch.column(1).to_numpy()
            lone = (tk.view(np.uint64) + (np.arange(row, row + texts, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            row += texts
            yield pa.RecordBatch.from_pydict(
                {
                    "tk": tk,
                    "w": lone,
                    "tf": np.zeros(texts, np.int64),
                    "s": np.bincount(owner[hit], n[hit] * value[at[hit]], texts).astype(float),  # of nothing, it would count in integers
                    "known": np.bincount(owner[hit], n[hit] * seen[at[hit]], texts).astype(np.int64),
                    "words": np.bincount(owner, n, texts).astype(np.int64),
                }
            )
            rare = np.flatnonzero(~hit)
            for first in range(0, len(rare), 1 << 16):
                r = rare[first : first + (1 << 16)]
                none = np.zeros(len(r), np.int64)
                yield pa.RecordBatch.from_pydict({"tk": tk[owner[r]], "w": w[r].view(np.int64), "tf": n[r], "s": np.zeros(len(r)), "known": none, "words": none})

    return run


def word_scores(docs: DataFrame, train: Column, text: str = "text", rate: float = 1e-6) -> tuple[DataFrame, dict]:
    """(tk, s, known, n_words) for each distinct text, and the corpus's figures.

    tk is the text's 64-bit key, s the sum of log10(c + 0.5) over its words, known
    how many of them have c > 0. Sums over a text's copies are divided by their number.
    Figures: n_train (texts), tokens (with one end each) and distinct (with the end).
    """
    spark = docs.sparkSession
    small_batches(spark)
    t = F.col(f"`{text}`")
    slim = spread(docs.select(t.alias("text"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("tk"), F.coalesce(train, F.lit(False)).alias("train")))
    counts = stored(slim.select("text", "train").mapInArrow(_tally, "w long, c long, n long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "ppm-words")
    figures = counts.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_train = slim.filter("train").count()
    least = F.lit(rate * (figures["n"] or 0))
    found = counts.filter(F.col("n") >= least).select("w", "c").toArrow()  # at most 1 / rate rows
    w, c = found["w"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.argsort(w)
    w, c = (w[order], c[order]) if len(w) else (np.zeros(1, np.uint64), np.zeros(1, np.int64))
    shared = spark.sparkContext.broadcast((w, np.log10(c + 0.5), (c > 0).astype(np.int64)))
    pairs = slim.select("text", "tk").mapInArrow(_pairs(shared), "tk long, w long, tf long, s double, known long, words long")
    rare = counts.filter(F.col("n") < least).select("w", "c")
    c = F.coalesce("c", F.lit(0))
    copies = F.count_if(F.col("tf") == 0)
    per = (
        pairs.join(rare, "w", "left")
        .groupBy("tk")
        .agg(
            (F.sum(F.col("s") + F.col("tf") * F.log10(c + 0.5)) / copies).alias("s"),
            (F.sum(F.col("known") + F.when(c > 0, F.col("tf")).otherwise(0)) / copies).cast("long").alias("known"),
            (F.sum("words") / copies).cast("long").alias("n_words"),
        )
    )
    return stored(per, "ppm-bases"), {"n_train": n_train, "tokens": int(figures["c"] or 0) + n_train, "distinct": int(figures["v"] or 0) + (n_train > 0)}


def score_corpus(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    train tells the rows to learn from. Null and empty texts consist of the end
    alone. Texts are told apart by a 64-bit hash and words too (two among ten
    thousand million differ with near certainty). An empty table gives an empty one;
    without training rows all words are unknown and all bytes equally likely.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    base, figures = word_scores(rows, F.col("train"))
    per = base.join(text_scores(rows, fit(rows, train=F.col("train"))), "tk")
    scored = rows.select("doc_id", "train", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"))
    n = figures["n_train"]
    total = F.lit(figures["tokens"] + 0.5 * (figures["distinct"] + 1))
    size = F.col("n_words") + 1
    return scored.join(stored(per, "ppm-texts"), "tk").select(
        "doc_id",
        "train",
        size.alias("n_tokens"),
        (F.col("known") + F.lit(int(n > 0))).alias("n_known"),
        F.lit(figures["tokens"]).cast("long").alias("train_tokens"),
        (F.col("s") + F.log10(F.lit(n + 0.5)) - size * F.log10(total)).alias("base_score"),
        "score",
    )
