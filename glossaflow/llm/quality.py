"""Quality and toxicity by weak labels.

Overlapping heuristic labellers vote 0, 1 or not at all on each text. The counts of all
vote patterns in the corpus (a few thousand at most, whatever its size) go to an
expectation-maximisation that estimates every labeller's votes in either class; its
posteriors label a bounded sample of texts, on which a linear scorer over hashed
words and votes is trained, from the votes' log odds on. The scorer alone then judges
every whole text.

Words of abuse differ by language and corpus. Beside a short fixed list, labellers
use lexicons that are learned from a bounded sample of labelled rows: words (two
overlapping two-thirds of the rows) and beginnings of words that occur in toxic texts far
more often than chance allows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches, spread

_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPER, _ALPHA = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
#: Words of abuse.
ABUSE = frozenset(b"idiot moron scum loser clown bastard vermin imbecile stupid pathetic worthless disgusting trash scumbag asshole dumbass".split())
QUALITY_VOTES, TOXIC_VOTES = 8, 4
#: Bytes of a word's beginning.
STEM = 6
HASHED = 1 << 16


@dataclass
class Lexicons:
    first: frozenset = frozenset()
    second: frozenset = frozenset()
    stems: frozenset = frozenset()


def bag(text: str | None) -> tuple[list[bytes], Counter, Counter]:
    """(tokens, their counts, counts of lower-cased words stripped of marks)."""
    tokens = (text or "").encode("utf-8", "surrogatepass").split()
    counts = Counter(tokens)
    words: Counter = Counter()
    for t, c in counts.items():
        if w := t.strip(_SYMBOLS).lower():
            words[w] += c
    return tokens, counts, words


def judge(text: str | None, lexicons: Lexicons) -> tuple[list[int], list[int], Counter]:
    """(votes for good quality, votes for toxicity, words); 1 yes, 0 no, -1 no vote.

    Each of the first seven quality labellers knows one kind of bad text and abstains
    otherwise; the last one votes for texts that look like prose in all respects.
    """
    tokens, counts, words = bag(text)
    n = len(tokens)
    if not n:
        return [0] + [-1] * (QUALITY_VOTES - 1), [0] * TOXIC_VOTES, words
    raw = (text or "").encode("utf-8", "surrogatepass")
    wordless = ended = noisy = 0
    for t, c in counts.items():
        tail = len(t) - len(t.rstrip(_SYMBOLS))
        if tail == len(t):
            wordless += c
        elif tail > 1:
            noisy += c
        elif t[-1:] in b".!?":
            ended += c
    size = len(raw)
    symbols = size - len(raw.translate(None, _SYMBOLS))
    upper, alpha = size - len(raw.translate(None, _UPPER)), size - len(raw.translate(None, _ALPHA))
    triples = len(set(zip(tokens, tokens[1:], tokens[2:]))) / (n - 2) if n > 30 else 1.0
    bad = [
        symbols > 0.09 * size,
        alpha > 20 and upper > 0.3 * alpha,
        wordless > 0.08 * n,
        noisy > 0.08 * n,
        triples < 0.5,
        n > 30 and len(counts) < 0.12 * n,
        n > 60 and not ended or size > 14 * n,
    ]
    prose = symbols < 0.06 * size and upper < 0.12 * max(alpha, 1) and wordless < 0.03 * n and noisy < 0.03 * n and triples > 0.7
    hits = [not ABUSE.isdisjoint(words), not lexicons.first.isdisjoint(words), not lexicons.second.isdisjoint(words), not lexicons.stems.isdisjoint(w[:STEM] for w in words if len(w) > STEM)]
    return [0 if x else -1 for x in bad] + [1 if prose else -1], [int(x) for x in hits], words


def code(votes: list[int]) -> int:
    out = 0
    for v in votes:
        out = out * 3 + v + 1
    return out


def votes_of(codes: np.ndarray, n: int) -> np.ndarray:
    return np.stack([codes // 3 ** (n - 1 - j) % 3 for j in range(n)], 1)


@dataclass
class Votes:
    """What each labeller says in each class: table[labeller, class, vote]."""

    prior: float
    table: np.ndarray

    @classmethod
    def fit(cls, codes: np.ndarray, counts: np.ndarray, n: int, any_positive: bool = False, rounds: int = 60) -> Votes:
        v = votes_of(codes, n)
        cast = v > 0
        if any_positive:
            p = np.where((v == 2).any(1), 0.95, 0.02)
        else:
            p = np.where(cast.any(1), ((v == 2).sum(1) + 0.5) / (cast.sum(1) + 1), 0.5)
        model = cls(0.5, np.zeros((n, 2, 3)))
        for _ in range(rounds):
            for c, share in ((0, 1 - p), (1, p)):
                w = counts * share
                for j in range(n):
                    t = np.bincount(v[:, j], w, 3) + 1.0
                    model.table[j, c] = t / t.sum()
            model.prior = float(np.clip((counts * p).sum() / max(counts.sum(), 1), 1e-4, 1 - 1e-4))
            p = model.posterior(codes)
        return model

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        n = len(self.table)
        v = votes_of(codes, n)
        at = np.arange(n)
        odds = np.log(self.prior / (1 - self.prior)) + (np.log(self.table[at, 1, v]) - np.log(self.table[at, 0, v])).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def odds(self) -> tuple[np.ndarray, float]:
        """Log odds of each labeller's votes (labeller by labeller, no vote first), and of the prior: the votes' part of a linear scorer."""
        return (np.log(self.table[:, 1]) - np.log(self.table[:, 0])).ravel(), float(np.log(self.prior / (1 - self.prior)))

    def accuracies(self) -> np.ndarray:
        """Of each labeller, the probability that a vote it casts is right."""
        right = self.prior * self.table[:, 1, 2] + (1 - self.prior) * self.table[:, 0, 1]
        return right / (right + self.prior * self.table[:, 1, 1] + (1 - self.prior) * self.table[:, 0, 2])


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", rows: int = 20_000) -> DataFrame:
    """docs with their labels, for about rows of the labelled ids, chosen by id hash: the bound on the sample.

    Of an id that is labelled more than once the largest labels count, so a repeated id
    stands once. The labels are broadcast only while they keep to twice the bound.
    """
    others = [c for c in labels.columns if c != doc_id]
    one = labels.groupBy(doc_id).agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in others])
    some = one.filter(F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < min(1.0, rows / max(one.count(), 1)) * (1 << 20))
    return docs.join(F.broadcast(some) if some.count() <= 2 * rows else some, doc_id)


def features(good: list[int], toxic: list[int], words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: a place for each vote, hashed ones for the distinct words."""
    votes = [j * 3 + v + 1 for j, v in enumerate([*good, *toxic])]
    first = 3 * (QUALITY_VOTES + TOXIC_VOTES)
    hashed = [first + zlib.crc32(w) % (HASHED - first) for w in words]
    places = np.array(votes + hashed, np.int32)
    values = np.ones(len(places), np.float32)
    values[len(votes) :] = 1.0 / max(1.0, len(hashed)) ** 0.5
    return places, values


class Linear:
    """Logistic regression on hashed features, for several targets at once."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, places: list[np.ndarray], values: list[np.ndarray], targets: np.ndarray, start: tuple[np.ndarray, np.ndarray], rounds: int = 80, rate: float = 0.1, decay: float = 1e-4) -> Linear:
        """start: weights of the first places, and bias, of each target to begin from."""
        n, k = targets.shape
        sizes = np.array([len(p) for p in places])
        flat, val = np.concatenate(places), np.concatenate(values).astype(float)
        begin, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(n), sizes)
        w, b = np.zeros((k, HASHED)), start[1].astype(float)
        w[:, : start[0].shape[1]] = start[0]
        for j in range(k):
            m, s = np.zeros(HASHED), np.zeros(HASHED)
            for i in range(1, rounds + 1):
                p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[j][flat] * val, begin) + b[j], -30, 30)))
                err = (p - targets[:, j]) / n
                g = np.bincount(flat, val * err[owner], HASHED) + decay * w[j] / n
                m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
                w[j] -= rate * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-5)
                b[j] -= rate * 10 * err.sum()
        return cls(w.astype(np.float32), b)

    def score(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[:, places] @ values + self.bias, -30, 30)))


def learn_lexicons(labelled: DataFrame, text: str = "text", toxic: str = "toxic", chance: float = 1e-3, purity: float = 0.9) -> Lexicons:
    """Words, and beginnings of words, of toxic texts. labelled is a bounded sample; equal texts count once.

    An entry's share of toxic texts is purity or more, and as many toxic texts among
    its texts would come by chance less often than chance.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{toxic}`").cast("int").alias("toxic")).filter("text is not null and toxic is not null").dropDuplicates(["text"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, kinds, marks = [], [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = bag(t)[2]
                third = zlib.crc32(t.encode("utf-8", "surrogatepass")) % 3
                stems = {w[:STEM] for w in found if len(w) > STEM}
                for kind, entries in ((0, found if third < 2 else None), (1, found if third > 0 else None), (2, stems)):
                    if entries is not None:  # the empty word counts the texts
                        words += [b"", *entries]
                        kinds += [kind] * (1 + len(entries))
                        marks += [y] * (1 + len(entries))
            yield pa.RecordBatch.from_pydict({"w": pa.array(words, pa.binary()), "kind": pa.array(kinds, pa.int32()), "toxic": pa.array(marks, pa.int32())})

    counts = rows.mapInArrow(listed, "w binary, kind int, toxic int").groupBy("w", "kind").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    found = counts.filter((F.length("w") == 0) | ((F.col("k") > 2) & (F.col("k") >= purity * F.col("n")))).toPandas()
    total = {int(r.kind): (r.n, r.k) for r in found.itertuples() if not r.w}
    sets: list[set] = [set(), set(), set()]
    for r in found.itertuples():
        if not r.w:
            continue
        n, k = total[r.kind]
        rate = (k + 1) / (n + 2)
        # bound on a binomial tail by relative entropy
        x = r.k / r.n
        spread_ = x * np.log(x / rate) + ((1 - x) * np.log((1 - x) / (1 - rate)) if x < 1 else 0)
        if x > rate and np.exp(-r.n * spread_) < chance:
            sets[r.kind].add(bytes(r.w))
    return Lexicons(*map(frozenset, sets))


def vote_codes(docs: DataFrame, text: str, out: str, lexicons: Lexicons) -> DataFrame:
    """docs with out: both vote patterns in one number."""

    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    @F.pandas_udf("long")
    def votes(texts: pd.Series) -> pd.Series:
        made = []
        for t in texts:
            good, toxic, _ = judge(t, shared.value)
            made.append(code(good) * 3**TOXIC_VOTES + code(toxic))
        return pd.Series(made, dtype="int64")

    return docs.withColumn(out, votes(F.col(f"`{text}`")))


@dataclass
class Model:
    lexicons: Lexicons
    quality: Votes
    toxic: Votes
    linear: Linear


def fit(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text", fit_docs: int = 8000) -> Model:
    """The labellers' tables from the votes on all docs, and the scorer from about fit_docs of them, chosen by text hash (the bound on the sample).

    labelled (text, toxic) is a bounded sample for the lexicons; without it they are empty.
    """
    small_batches(docs.sparkSession)
    lexicons = Lexicons() if labelled is None else learn_lexicons(labelled, text)
    rows = spread(docs.select(F.col(f"`{text}`").alias("text")))
    seen = vote_codes(rows, "text", "v", lexicons).groupBy("v").agg(F.count("*").alias("n")).toPandas()
    both, n = seen["v"].to_numpy(np.int64), seen["n"].to_numpy(float)
    split = 3**TOXIC_VOTES
    quality, toxic = Votes.fit(both // split, n, QUALITY_VOTES), Votes.fit(both % split, n, TOXIC_VOTES, any_positive=True)
    share = min(1.0, fit_docs / max(n.sum(), 1))
    # copies of a text count once, however many there are
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text")).select("text")

    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, places, values = [], [], []
            for t in batch.column(0).to_pylist():
                good, bad, words = judge(t, shared.value)
                p, v = features(good, bad, words)
                codes.append(code(good) * split + code(bad))
                places.append(p)
                values.append(v)
            yield pa.RecordBatch.from_pydict({"v": pa.array(codes, pa.int64()), "p": pa.array(places, pa.list_(pa.int32())), "x": pa.array(values, pa.list_(pa.float32()))})

    found = sample.mapInArrow(listed, "v long, p array<int>, x array<float>").toArrow()
    v = found.column("v").to_numpy()
    # the same rows in the same order, whatever the partitioning
    first = [p.values.to_numpy() for p in found.column("p")], [x.values.to_numpy() for x in found.column("x")]
    order = sorted(range(len(v)), key=lambda i: (int(v[i]), len(first[0][i]), zlib.crc32(first[0][i].tobytes())))
    if not order:
        return Model(lexicons, quality, toxic, Linear(np.zeros((2, HASHED), np.float32), np.zeros(2)))
    v = v[order]
    targets = np.stack([quality.posterior(v // split), toxic.posterior(v % split)], 1)
    (good, good_bias), (bad, bad_bias) = quality.odds(), toxic.odds()
    start = np.stack([np.r_[good, np.zeros(len(bad))], np.r_[np.zeros(len(good)), bad]]), np.array([good_bias, bad_bias])
    return Model(lexicons, quality, toxic, Linear.fit([first[0][i] for i in order], [first[1][i] for i in order], targets, start))


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with quality, toxic (scores 0 to 1) and keep (quality of a half or more, toxic below).

    Both scores come from the linear scorer. Null and blank texts have quality 0 and
    toxic 0; no text is too long. Names get underscores before them
    if docs has them. Repeated rows get equal scores, an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = {n: free_name(docs, n) for n in ("quality", "toxic", "keep")}
    state = free_name(docs, "quality_state")

    @F.pandas_udf("quality double, toxic double")
    def score(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        made = []
        for t in texts:
            good, bad, words = judge(t, model.lexicons)
            if not (t or "").strip():
                made.append((0.0, 0.0))
            else:
                q, x = model.linear.score(*features(good, bad, words))
                made.append((float(q), float(x)))
        return pd.DataFrame(made, columns=["quality", "toxic"])

    df = spread(docs).withColumn(state, score(F.col(f"`{text}`")))
    s = F.col(state)
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], s["quality"].alias(names["quality"]), s["toxic"].alias(names["toxic"]), ((s["quality"] >= 0.5) & (s["toxic"] < 0.5)).alias(names["keep"]))
