"""Cross-tokenizer alignment by a dangling-suffix transducer.

The tokens of two tokenizers A and B cover the same bytes. The transducer reads them in
step: its state is the side that leads and the bytes by which it leads (the dangling
suffix). The next token is always one of the side behind, or of A if none leads; it
shortens the suffix, ends it, or takes the lead itself. Transitions are memoised by
(state, token). A group of tokens closes when the suffix is empty; every token read while
one dangles is a link, with the token that the other side read last.

A text is cut where a blank follows a character that is not white space. No token of
either side goes across such a place (this is checked against both vocabularies), so both
end there, groups close there, and an aligned piece can be kept for its next occurrence.

Id pairs are counted over the corpus by rows with map-side combine. Pairs that make up
more than a millionth of all (document, pair) rows, at most a million, go to every worker
as sorted arrays; the rest, none of them frequent, is joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread, stored

#: Folder with the public vocabulary files; a parameter of all functions here.
TOKENIZERS = "/opt/tokenizers"
_SHIFT = 15  # a pair of ids is a << 15 | b
_MEMO = 1 << 21  # transitions kept at once; beyond it they are worked out anew
_PIECES = 1 << 19  # pieces of text kept at once
_CUT = re.compile(r"\S(?= )")  # a blank behind it begins a piece
_GAP = re.compile(r"\s ")
_WIDE = re.compile(r"\s{10000}")
#: Fixed value: how byte-level tokenizers of this kind cut a text into words.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class SideA:
    """A byte-level BPE tokenizer from its JSON, without special tokens.

    Where its merges stand in the order of their ids, as in byte-level vocabularies, the
    ids are ranks, and tiktoken gives the same ids several times faster; but it can't take
    long runs of white space.
    """

    def __init__(self, data: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode("utf-8"))
        self.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if i in special else bytes(letters[c] for c in token)
        kind = json.loads(data)
        merges = [m if isinstance(m, str) else " ".join(m) for m in kind["model"]["merges"]]
        ids = [vocabulary[m.replace(" ", "", 1)] for m in merges]
        plain = kind.get("normalizer") is None and kind["pre_tokenizer"].get("type") == "ByteLevel" and kind["pre_tokenizer"].get("use_regex") and not kind["pre_tokenizer"].get("add_prefix_space")
        self.fast = None
        if plain and all(x < y for x, y in zip(ids, ids[1:])) and len(ids) + 256 == len(vocabulary) - len(special):
            ranks = {self.bytes[i]: i for i in vocabulary.values() if i not in special}
            self.fast = tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and not _WIDE.search(text):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class SideB:
    """A sentence-piece BPE tokenizer, which puts a blank before a text itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = self.model.get_piece_size()
        if n > 1 << _SHIFT:
            raise ValueError(f"{n} pieces; ids must be below {1 << _SHIFT}")
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.blank = self.model.piece_to_id("▁")

    def encode(self, text: str) -> list[int]:
        """text begins with the blank that the model adds."""
        return self.model.encode(text[1:], num_threads=1) if len(text) > 1 else [self.blank]


class Transducer:
    """Steps of two token sequences over the same bytes.

    State 0 is the empty suffix, odd states are suffixes of A, even ones of B. A state's
    number is given out as its suffix first occurs.
    """

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.bytes = (a, b)
        self.clear()

    def clear(self) -> None:
        self.steps: dict[int, int] = {}
        self.suffix: list[bytes] = [b"", b""]
        self.numbers: dict[tuple[int, bytes], int] = {}

    def _state(self, side: int, suffix: bytes) -> int:
        """side 0: A leads. The lists of suffixes of both sides share numbers: A odd, B even from 2."""
        if not suffix:
            return 0
        found = self.numbers.get((side, suffix))
        if found is None:
            found = 2 * len(self.suffix) + (1 - side)
            self.suffix.append(suffix)
            self.numbers[side, suffix] = found
        return found

    def _step(self, state: int, token: int) -> int:
        """The state after the next token of the side behind; -1 where the bytes differ."""
        suffix = self.suffix[state >> 1] if state else b""
        leader = 0 if state & 1 else 1
        new = self.bytes[1 - leader if state else 0][token]
        if not state:
            return self._state(0, new)
        if suffix.startswith(new):
            return self._state(leader, suffix[len(new) :])
        return self._state(1 - leader, new[len(suffix) :]) if new.startswith(suffix) else -1

    def run(self, a: list[int], b: list[int]) -> list[int] | None:
        """The state after each token, in the order of reading; None where the two sides' bytes differ."""
        if len(self.steps) > _MEMO:
            self.clear()
        steps, out, state = self.steps, [], 0
        next_a, next_b, put = iter(a).__next__, iter(b).__next__, out.append
        try:
            for _ in range(len(a) + len(b)):
                key = state << 17 | (next_b() if state & 1 else next_a())
                try:
                    state = steps[key]
                except KeyError:
                    state = steps[key] = self._step(state, key & (1 << 17) - 1)
                if state < 0:
                    return None
                put(state)
        except StopIteration:
            return None
        return None if state else out


class Aligner:
    """Pieces of text to ids, groups and links, with the pieces seen lately kept."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = SideA(a), SideB(b)
        for t in (*self.a.bytes, *self.b.bytes):
            # a blank behind another byte: only if all before it is white space may a token hold it
            if b" " in t.lstrip(b" ") and t.decode("utf-8", "replace").strip():
                raise ValueError(f"token {t!r} goes across a place where texts are cut")
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        self.length = [np.array([len(t) for t in side.bytes], np.int64) for side in (self.a, self.b)]
        # ids as written with the sign behind them, a row after another: A inside a group, at the end of A's part, B inside, at the end of B's part
        n_a, n_b = len(self.a.bytes), len(self.b.bytes)
        self.names = [f"{i}{sign}" for n, sign in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for i in range(n)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = defaultdict(count().__next__)  # pieces without their first blank, numbered as they come
        self.kept_chars = 0
        self.shape = np.zeros((0, 3), np.int64)  # n_a, n_b, n_groups; n_a is -1 where the bytes differ
        self.written: list[str] = []  # groups, each with a semicolon behind it
        self.span = np.zeros((0, 2), np.int64)  # where each piece's id pairs begin in links, and how many they are
        self.links = np.zeros(0, np.int64)

    def _whole(self, side: SideA | SideB, which: int, text: str, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all pieces at once and the number of tokens of each piece; None if the bytes don't come back."""
        ids = side.encode(text)
        if b"".join(map(side.bytes.__getitem__, ids)) != text.encode("utf-8", "surrogatepass"):
            return None
        ids = np.asarray(ids, np.int64)
        ends = np.searchsorted(np.cumsum(self.length[which][ids]), np.cumsum(size)) + 1
        return ids, np.diff(np.r_[0, ends])

    def _learn(self, texts: list[str], first: np.ndarray) -> None:
        """Aligns new pieces, which have the numbers first. Those of which a side's bytes differ are found by halves."""
        text = " " + " ".join(texts)
        size = np.array([len(t) for t in texts] if text.isascii() else [len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64) + 1
        a = self._whole(self.a, 0, text, size)
        b = self._whole(self.b, 1, text, size) if a else None
        states = self.transducer.run(a[0].tolist(), b[0].tolist()) if b else None
        if states is None:
            half = len(texts) // 2
            if half:
                self._learn(texts[:half], first[:half])
                self._learn(texts[half:], first[half:])
            else:
                self._keep(first, np.array([[-1, 0, 0]]), [""], np.zeros(0, np.int64), np.zeros(1, np.int64))
            return
        (ids_a, count_a), (ids_b, count_b) = a, b
        states = np.asarray(states, np.int64)
        before = np.r_[0, states[:-1]]
        of_a, linked = (before & 1) == 0, before != 0
        i, j = np.cumsum(of_a), np.cumsum(~of_a)  # tokens read so far
        pairs = ids_a[i[linked] - 1] << _SHIFT | ids_b[j[linked] - 1]
        closed = np.flatnonzero(states == 0)
        end_a, end_b = i[closed], j[closed]
        first_a, first_b = np.r_[0, end_a[:-1]], np.r_[0, end_b[:-1]]
        group_a, group_b = np.repeat(np.arange(len(closed)), end_a - first_a), np.repeat(np.arange(len(closed)), end_b - first_b)
        place_a, place_b = np.arange(len(ids_a)) + first_b[group_a], np.arange(len(ids_b)) + end_a[group_b]
        last_a, last_b = np.arange(len(ids_a)) + 1 == end_a[group_a], np.arange(len(ids_b)) + 1 == end_b[group_b]
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[place_a] = ids_a + last_a * len(self.a.bytes)
        code[place_b] = ids_b + last_b * len(self.b.bytes) + 2 * len(self.a.bytes)
        names = list(map(self.names.__getitem__, code.tolist()))
        ends = np.cumsum(count_a + count_b)  # steps and names up to each piece's end
        cut = [0, *ends.tolist()]
        written = ["".join(names[x:y]) for x, y in zip(cut, cut[1:])]
        groups = np.diff(np.r_[0, np.searchsorted(closed, ends)])
        n_links = np.diff(np.r_[0, np.cumsum(linked)[ends - 1]])
        self._keep(first, np.stack([count_a, count_b, groups], axis=1), written, pairs, n_links)

    def _keep(self, numbers: np.ndarray, shape: np.ndarray, written: list[str], pairs: np.ndarray, n_links: np.ndarray) -> None:
        self.shape[numbers] = shape
        self.span[numbers] = np.stack([len(self.links) + np.cumsum(n_links) - n_links, n_links], axis=1)
        for k, w in zip(numbers.tolist(), written):
            self.written[k] = w
        self.links = np.concatenate([self.links, pairs])

    def align(self, texts: list[str]):
        """For texts that begin with a blank: shapes (n_a of -1: bytes differ), written groups, and pairs with their text's number."""
        if len(self.known) > _PIECES or self.kept_chars > 16 * _PIECES:
            self.clear()
        old, number = len(self.known), self.known.__getitem__
        where = [list(map(number, pieces(t))) for t in texts]
        if new := len(self.known) - old:
            fresh = list(islice(reversed(self.known), new))[::-1]
            self.kept_chars += sum(map(len, fresh))
            self.shape = np.concatenate([self.shape, np.zeros((new, 3), np.int64)])
            self.span = np.concatenate([self.span, np.zeros((new, 2), np.int64)])
            self.written += [""] * new
            last = [k for k, t in enumerate(fresh) if not t or t[-1].isspace()]  # at a text's end; nothing can be put behind them
            for k in last:
                self._learn([fresh[k]], np.array([old + k]))
            inner = np.setdiff1d(np.arange(new), last)
            if len(inner):
                self._learn([fresh[k] for k in inner.tolist()] if last else fresh, old + inner)
        written = ["".join(map(self.written.__getitem__, w)) for w in where]
        n = np.array([len(w) for w in where], np.int64)
        flat = np.fromiter(chain.from_iterable(where), np.int64, int(n.sum()))
        begin = np.r_[0, np.cumsum(n)[:-1]]
        shape = np.add.reduceat(self.shape[flat], begin, axis=0)
        shape[np.minimum.reduceat(self.shape[flat, 0], begin) < 0] = (-1, 0, 0)
        begins, many = self.span[flat].T
        skip = np.repeat(begins - np.r_[0, np.cumsum(many)[:-1]], many)
        pairs = self.links[np.arange(len(skip)) + skip]
        return shape, written, np.repeat(np.repeat(np.arange(len(texts)), n), many), pairs


def slices(text: str, size: int = 1 << 18) -> Iterator[str]:
    """text, which begins with a blank, cut at a few of the places where pieces begin, about size characters apart."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:]


def pieces(text: str) -> list[str]:
    """text, which begins with a blank, cut at each blank that follows a character other than white space; without those blanks."""
    parts = text.split(" ")[1:]
    if not _GAP.search(text):
        return parts
    out: list[list[str]] = []
    joins = False  # whether the last part ends in white space, or is empty
    for p in parts:
        if joins:
            out[-1].append(p)
        else:
            out.append([p])
        joins = not p or p[-1].isspace()
    return [" ".join(x) for x in out]


@lru_cache(maxsize=2)
def _aligner(a: bytes, b: bytes) -> Aligner:
    return Aligner(a, b)


def aligned(worker: Aligner, texts: list[str | None], chars: int = 1 << 20):
    """For each text: (n_a, n_b, n_groups, n_links), digest, and its distinct pairs with their numbers."""
    shape = np.zeros((len(texts), 3), np.int64)
    differs = np.zeros(len(texts), bool)
    digests = [hashlib.sha256() for _ in texts]
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    tail = [""] * len(texts)
    held: list[tuple[int, str]] = []

    def flush() -> None:
        rows = np.array([r for r, _ in held], np.int64)
        shapes, written, of, pairs = worker.align([t for _, t in held])
        differs[rows[shapes[:, 0] < 0]] = True
        np.add.at(shape, rows, shapes)
        for r, w in zip(rows.tolist(), written):
            if w:
                digests[r].update((tail[r] + w[:-1]).encode())
                tail[r] = ";"
        key, times = np.unique(rows[of] << 40 | pairs, return_counts=True)
        row = key >> 40
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
        for x, y in zip(at, [*at[1:], len(row)]):
            found[row[x]].append((key[x:y] & (1 << 40) - 1, times[x:y]))
        held.clear()

    size = 0
    for r, text in enumerate(texts):
        for part in slices(" " + text) if text else ():
            held.append((r, part))
            size += len(part)
            if size >= chars:
                flush()
                size = 0
    if held:
        flush()
    for r, text in enumerate(texts):
        if not text or differs[r]:
            yield (0, 0, 0, 0), "", _NONE, _NONE
            continue
        ids, times = (np.concatenate(x) for x in zip(*found[r])) if found[r] else (_NONE, _NONE)
        if len(found[r]) > 1:
            ids, back = np.unique(ids, return_inverse=True)
            times = np.bincount(back, times, len(ids)).astype(np.int64)
        yield (*shape[r].tolist(), int(times.sum())), digests[r].hexdigest(), ids, times


_NONE = np.zeros(0, np.int64)
_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def _align(files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _aligner(*files.value)
        for batch in batches:
            done = list(aligned(worker, batch.column(1).to_pylist()))
            shapes, digests, pairs, times = zip(*done) if done else ((), (), (), ())
            ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            flat = [pa.array(np.concatenate([_NONE, *x]).astype(np.int32)) for x in (pairs, times)]
            n = np.array(shapes, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n[:, k]) for k in range(4)), pa.array(digests, pa.string()), *(pa.ListArray.from_arrays(ends, x) for x in flat)],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    return run


def _score(common):
    """Adds up what the frequent pairs give and passes on the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, best = common.value
        for batch in batches:
            pairs, times = batch.column(1), batch.column(2)
            ends = pairs.offsets.to_numpy().astype(np.int64)
            lo = int(ends[0]) if len(ends) else 0
            ends = ends - lo
            p, t = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(key, p), max(len(key) - 1, 0))
            known = key[at] == p if len(key) else np.zeros(len(p), bool)
            where = at[known]

            def per_row(values: np.ndarray) -> np.ndarray:
                full = np.zeros(len(p), np.int64)
                full[known] = values
                run_ = np.r_[0, np.cumsum(full)]
                return run_[ends[1:]] - run_[ends[:-1]]

            hits, total = per_row(t[known] * best[where]), per_row(t[known] * docs[where])
            left = np.r_[0, np.cumsum(~known)][ends]
            lists = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~known].astype(np.int32))) for x in (p, t)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits), pa.array(total), *lists], names=["row", "hits", "total", "pairs", "times"])

    return run


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", share: int = 1_000_000) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The files are read on the driver from folder and sent to the workers. Null and empty
    texts, and texts whose tokens don't give back their bytes on one side, have zeros and
    an empty digest. A pair's count is the number of rows of docs that hold it; repeated
    rows count each. Long texts are taken whole; an empty table gives an empty one;
    other columns are not read. Above 1 / share of all (row, pair) rows a pair counts as
    frequent, which changes no result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    files = spark.sparkContext.broadcast(tuple((Path(folder) / f).read_bytes() for f in (a, b)))
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = stored(spread(slim).mapInArrow(_align(files), _ROWS).withColumn("row", F.monotonically_increasing_id()), "align-rows")
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "align-counts")
    first = F.shiftright("pair", _SHIFT)
    top = counts.groupBy(first.alias("a")).agg(F.max("docs").alias("top"))  # a row for each id of A at most
    ranked = counts.join(F.broadcast(top), first == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("top")).cast("long").alias("best"))
    n = counts.agg(F.sum("docs")).first()[0] or 0
    frequent = ranked.filter(F.col("docs") > n / share).orderBy("pair").toArrow()
    common = spark.sparkContext.broadcast(tuple(frequent.column(i).to_numpy() for i in range(3)))
    told = stored(rows.select("row", "pairs", "times").mapInArrow(_score(common), "row long, hits long, total long, pairs array<int>, times array<int>"), "align-told")
    rest = told.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("k")).select("row", "k.pairs", "k.times")
    rare = ranked.filter(F.col("docs") <= n / share).withColumnRenamed("pair", "pairs")
    more = rest.join(rare, "pairs").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_hits"), F.sum(F.col("times") * F.col("docs")).alias("more_total"))
    zero = F.lit(0).cast("long")
    joined = rows.drop("pairs", "times").join(told.select("row", "hits", "total"), "row").join(more, "row", "left")
    return joined.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("hits") + F.coalesce("more_hits", zero)).alias("n_best"),
        (F.col("total") + F.coalesce("more_total", zero)).alias("count_sum"),
        "groups_sha256",
    )
