"""Language identification with language-bitmask n-gram filters.

Training: the character 3- and 4-grams of a bounded sample of labelled texts make up a
set for each language. The sets go into Bloom filters that are stored bit-sliced: one
table of slots, whose words have a bit for each language, so a lookup gives all
languages that (seem to) contain a gram as the AND of a few words. The table's size
follows from the largest set.

Prediction: the masks of a text's grams are summed per language, each sum is
corrected for that language's false-positive rate, and the language with the
largest corrected share of the text's grams is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, small_batches, spread

ORDERS = (3, 4)
UNKNOWN = "und"
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point to whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all grams, the text of each, which texts have a letter).

    A gram has letters inside; its first or last place may be a word's edge, which
    is the same for white space, digits, marks and the ends of the text.
    """
    parts = [_codes(t) for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    total = int(sizes.sum()) + 1
    codes = np.zeros(total, np.uint32)
    at = 1
    for p in parts:
        codes[at : at + len(p)] = p
        at += len(p) + 1
    owner = np.repeat(np.arange(len(texts)), sizes)
    owner = np.r_[0, owner][:total] if len(texts) else np.zeros(total, np.int64)
    letter = _letters()[codes]
    c = np.where(letter, codes, 0).astype(np.uint64)
    lettered = np.bincount(owner, weights=letter, minlength=len(texts)) > 0
    hashes, owners = [], []
    for n in ORDERS:
        m = total - n + 1
        if m <= 0:
            continue
        inside = letter[1 : 1 + m].copy()
        for j in range(2, n - 1):
            inside &= letter[j : j + m]
        # a gram of one letter and two edges says little and is shared by all
        inside &= letter[:m] | letter[n - 1 : n - 1 + m]
        keep = np.flatnonzero(inside)
        h = np.full(len(keep), n, np.uint64)
        for j in range(n):
            h = (h << np.uint64(15)) + (h * np.uint64(0x9E3779B1)) + c[keep + j]
        hashes.append(_mixed(h))
        owners.append(owner[keep + 1])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), lettered
    return np.concatenate(hashes), np.concatenate(owners), lettered


@dataclass
class Filters:
    """Bit-sliced Bloom filters: slots has a word for each 64 languages and slot."""

    langs: list[str]
    slots: np.ndarray  # (slots, words)
    wrong: np.ndarray  # false-positive rate of each language
    hashes: int = 3
    usual: str = UNKNOWN  # the most frequent language of the training texts

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], bits: int | None = None, hashes: int = 3) -> Filters:
        """Filters of 2**bits slots, or of at least 8 for each gram of the largest language: a wrong hit in 30 at most."""
        langs = sorted(grams)
        bits = bits or max(10, int(8 * max(map(len, grams.values()), default=0)).bit_length())
        words = max(1, -(-len(langs) // 64))
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        slots = np.zeros((1 << bits, words), kind)
        for i, lang in enumerate(langs):
            for at in cls._places(grams[lang], bits, hashes):
                slots[at, i // 64] |= kind(1 << i % 64)
        fill = [(slots[:, i // 64] >> kind(i % 64) & kind(1)).mean() for i in range(len(langs))]
        return cls(langs, slots, np.array(fill) ** hashes, hashes)

    @staticmethod
    def _places(h: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(hashes):
            yield ((h + np.uint64(k) * step) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The languages of each gram."""
        bits = len(self.slots).bit_length() - 1
        out = None
        for at in self._places(h, bits, self.hashes):
            out = self.slots[at] if out is None else out & self.slots[at]
        return out

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) corrected share of grams; which texts have a letter; number of grams."""
        h, owner, lettered = gram_hashes(texts)
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        masks = self.masks(h)
        out = np.zeros((len(texts), len(self.langs)))
        for i, wrong in enumerate(self.wrong):
            has = masks[:, i // 64] >> masks.dtype.type(i % 64) & masks.dtype.type(1)
            count = np.bincount(owner[has.astype(bool)], minlength=len(texts))
            out[:, i] = np.clip((count - n * wrong) / (np.maximum(n, 1) * (1 - wrong)), 0, 1)
        return out, lettered, n


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = 4000) -> Filters:
    """Filters from labelled docs (rows with null text or lang are left out).

    About docs_per_lang whole texts of each language at most are used, chosen by text
    hash, copies once: the bound on the labelled sample, and so on what reaches the
    driver, which is each language's set of grams. Texts and grams are never cut.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filters.build({})
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, docs_per_lang / n))])
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.filter(unit < share[F.col("lang")]).groupBy("lang", F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df = batch.to_pandas()
            for name, part in df.groupby("lang"):
                grams = np.unique(gram_hashes(part["text"].tolist())[0])
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(grams), pa.string()), "gram": grams.view(np.int64)})

    found = sample.select("lang", "text").mapInArrow(listed, "lang string, gram long").distinct().toArrow()
    hashes = found["gram"].to_numpy().view(np.uint64)
    filters = Filters.build({k: hashes[pc.equal(found["lang"], k).to_numpy()] for k in sizes})
    filters.usual = max(sorted(sizes), key=sizes.get)
    return filters


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score, lang_share and lang_grams (names get underscores before them if docs has them).

    lang_pred is ``und`` with score 0 for null texts and texts without a letter (and
    when no language is known). lang_score is the winner's part of the two largest
    shares, lang_share the share of the text's lang_grams grams that its language
    contains. Texts without a known gram are given the most frequent language; other
    ties go to the first by code point. Empty tables give empty ones.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    names = {n: free_name(docs, n) for n in ("lang_pred", "lang_score", "lang_share", "lang_grams")}
    state = free_name(docs, "lang_state")

    @F.pandas_udf("lang string, score double, share double, grams long")
    def predict(texts: pd.Series) -> pd.DataFrame:
        f = shared.value
        made = []
        rows = [t or "" for t in texts]
        at = 0
        while at < len(rows):  # about a million characters at a time
            end, size = at, 0
            while end < len(rows) and (end == at or size + len(rows[end]) <= 1 << 20):
                size += len(rows[end])
                end += 1
            part = rows[at:end]
            shares, lettered, grams = f.shares(part)
            for i in range(len(part)):
                if not lettered[i] or not f.langs:
                    made.append((UNKNOWN, 0.0, 0.0, int(grams[i])))
                    continue
                best = int(np.argmax(shares[i]))
                top = float(shares[i][best])
                second = float(np.partition(shares[i], -2)[-2]) if len(f.langs) > 1 else 0.0
                made.append((f.langs[best] if top > 0 else f.usual, top / (top + second) if top > 0 else 1.0 / len(f.langs), top, int(grams[i])))
            at = end
        return pd.DataFrame(made, columns=["lang", "score", "share", "grams"])

    out = spread(docs).withColumn(state, predict(F.col(f"`{text}`")))
    s = F.col(state)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], s["lang"].alias(names["lang_pred"]), s["score"].alias(names["lang_score"]), s["share"].alias(names["lang_share"]), s["grams"].alias(names["lang_grams"]))


def keep_known(docs: DataFrame, filters: Filters, least_share: float = 0.2, z: float = 2.0, **kw) -> DataFrame:
    """docs in a language of the filters; all columns are kept, whatever their names.

    Rejected: und (null, empty and letterless texts), and texts whose predicted language
    seems to contain less than least_share of their grams: the upper end of the share's
    confidence interval (Wilson's, z deviations) lies below it. The fewer the grams, the
    wider the interval. Repeated rows fare alike, an empty table gives an empty one.
    """
    pred, share, grams = (free_name(docs, n) for n in ("lang_pred", "lang_share", "lang_grams"))
    found = identify(docs, filters, **kw)
    p, n, zz = F.col(share), F.col(grams), z * z
    upper = F.when(n == 0, 1.0).otherwise((p + zz / (2 * n) + z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n))
    return found.filter((F.col(pred) != UNKNOWN) & (upper >= least_share)).select(*[F.col(f"`{c}`") for c in docs.columns])
