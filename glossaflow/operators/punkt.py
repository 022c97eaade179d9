"""Sentence boundaries without labelled data: abbreviations, collocations and sentence starters from a corpus's own counts.

After Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006). A
text's words are its pieces between blanks. Every count comes from one table of
neighbouring words (:func:`neighbours`), made by an aggregation with map-side combine, so
what the corpus's size costs is one scan. Whether a stop ends a sentence depends only on
the two words around it and the second one's case: :func:`joined_stops` decides each such
pair once, as rows, and :func:`split` looks the pairs up from inside a text's row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import arrow
from ..functions.arrays import let
from ..session import dealt, ship, stored

#: Fixed values of the method: least scores of an abbreviation, a collocation and a sentence starter; the share of stops that an abbreviation is taken to have.
ABBREVIATION, COLLOCATION, STARTER, STOPPED = 0.3, 7.88, 30.0, 0.99
NUMBER = "##number##"
#: Pairs that a worker may hold as hashes; beyond it they are joined.
MAX_PAIRS = 4_000_000

#: Small letters that lower-casing leaves alone, without quotes, brackets, numbers and stops.
_PLAIN = r"^[a-zß-öø-ÿ]++$"
_OPENING, _CLOSING = r"^[(\[\"'«“„]+", r"[)\]\"'»”,;:]+$"


def word(piece: Column) -> Column:
    """(type, ending, case) of a piece between blanks: quotes and brackets off, lower-cased; numbers share a type.

    ending: 'hard' (! or ?), 'ellipsis', 'stop' or 'none'; case: that of the first character, 'upper', 'lower' or 'none'.
    """

    def parts(core: Column) -> Column:
        stem = F.lower(F.regexp_replace(core, r"[.!?…]+$", ""))
        kind = F.when(stem.rlike(r"^[-+]?[0-9][0-9.,:/-]*$"), NUMBER).otherwise(stem)
        ending = F.when(core.rlike(r"[!?]$"), "hard").when(core.rlike(r"(\.\.|…)$"), "ellipsis").when(core.endswith("."), "stop").otherwise("none")
        case = F.when(core.rlike(r"^\p{Lu}"), "upper").when(core.rlike(r"^\p{Ll}"), "lower").otherwise("none")
        return F.struct(kind.alias("type"), ending.alias("ending"), case.alias("case"))

    whole = let(F.regexp_replace(F.regexp_replace(piece, _OPENING, ""), _CLOSING, ""), parts)
    # most pieces are lower-case letters alone, of which one pattern tells all
    plain = F.struct(piece.alias("type"), F.lit("none").alias("ending"), F.lit("lower").alias("case"))
    return F.when(piece.rlike(_PLAIN), plain).otherwise(whole)


class Words(dict):
    """The numbers of pieces' words, as word() has them; each piece is looked at once.

    types, endings, cases: of each number. Lower-casing and cases are Python's, which
    differ from the Column's for a few characters newer than Spark's or Java's tables.
    """

    def __init__(self) -> None:
        self.known: dict[tuple[str, int, str], int] = {}
        self._endings = np.zeros(0, np.int8)

    def __missing__(self, piece: str) -> int:
        core = piece.lstrip("([\"'«“„").rstrip(")]\"'»”,;:")
        stem = core.rstrip(".!?…").lower()
        ending = HARD if core.endswith(("!", "?")) else ELLIPSIS if core.endswith(("..", "…")) else STOP if core.endswith(".") else NONE
        case = {"Lu": "upper", "Ll": "lower"}.get(unicodedata.category(core[0]), "none") if core else "none"
        found = self.known.setdefault((NUMBER if _DIGITS.match(stem) else stem, ending, case), len(self.known))
        self[piece] = found
        return found

    def forget(self) -> None:
        """Empties it where it stands, for all that hold it."""
        self.clear()
        self.__init__()

    def since(self, n: int) -> list[tuple[str, int, str]]:
        """The words from number n on."""
        return list(islice(reversed(self.known), len(self.known) - n))[::-1]

    def endings(self) -> np.ndarray:
        self._endings = np.r_[self._endings, np.array([e for _, e, _ in self.since(len(self._endings))], np.int8)]
        return self._endings


NONE, STOP, ELLIPSIS, HARD = range(4)
_ENDINGS = np.array(["none", "stop", "ellipsis", "hard"])
_DIGITS = re.compile(r"[-+]?[0-9][0-9.,:/-]*\Z")
_BEFORE_MARK = re.compile(r" ([.,!?;:])")
#: Words that a task knows, and pairs of them that it holds, before it hands on what it has counted.
HELD = 1 << 19


def pieces(text: str) -> list[str]:
    """The pieces of a text between blanks, after preprocess(), whose white space is Python's; none of a blank text."""
    return _BEFORE_MARK.sub(r"\1", " ".join(text.split())).split(" ") if text and not text.isspace() else []


def _slices(column: pa.Array, known: Words) -> Iterator[tuple[int, list[list[str]], np.ndarray, np.ndarray]]:
    """Of each slice of texts: where it begins, its pieces by text, the numbers of their words, and at which of these the texts end."""
    at = 0
    for part in arrow.slices(column):
        found = [pieces(s) for s in arrow.strings(part)]
        ends = np.cumsum([len(f) for f in found], dtype=np.int64)
        yield at, found, np.fromiter((known[p] for f in found for p in f), np.int64, int(ends[-1]) if len(ends) else 0), ends
        at += len(part)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the batch's texts count for neighbours(), handed on whenever HELD words or pairs are known."""
    known, keys, counts = Words(), [], []

    def made() -> pa.RecordBatch:
        key, n = _summed(keys, counts)
        words, (word, before) = list(known.known), np.divmod(key, 1 << 32)
        # 0: no word, 1: one without an ending
        kinds = [*((None, NONE), ("", NONE)), *((t, e) for t, e, _ in words)]
        types, cases = pa.array([w[0] for w in words], pa.string()), pa.array([w[2] for w in words], pa.string())
        endings = pa.array(_ENDINGS)
        was = pa.array([None, *(k[1] for k in kinds[1:])], pa.int8())
        word, before = pa.array(word), pa.array(before)
        columns = [types.take(word), endings.take(pa.array(known.endings()).take(word)), cases.take(word), pa.array([k[0] for k in kinds], pa.string()).take(before), endings.take(was.take(before)), pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, ["type", "ending", "case", "before", "before_ending", "n"])

    for batch in batches:
        for _, _, ids, ends in _slices(batch.column(0), known):
            if not len(ids):
                continue
            before = np.r_[0, ids[:-1]]
            before = np.where(known.endings()[before] == NONE, 1, before + 2)
            before[np.r_[0, ends[ends < len(ids)]]] = 0
            key, n = np.unique((ids << 32) | before, return_counts=True)
            keys.append(key)
            counts.append(n)
            if sum(map(len, keys)) > 2 * HELD:
                key, n = _summed(keys, counts)
                keys, counts = [key], [n]
                if len(key) > HELD or len(known) > HELD:
                    yield from _parts(made())
                    keys, counts = [], []
                    known.forget()
    if keys:
        yield from _parts(made())


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), 1 << 15):
        yield batch.slice(at, 1 << 15)


def neighbours(docs: DataFrame, text: str = "text") -> DataFrame:
    """(type, ending, case, before, before_ending, n): how often a word stands behind another one; written once.

    before is null for a text's first word, and empty behind a word without an ending:
    which one that is counts nowhere, and most pairs are such.
    """
    ship(docs.sparkSession)
    counted = dealt(docs.select(text)).mapInArrow(_count, "type string, ending string, case string, before string, before_ending string, n long")
    return stored(counted.groupBy(*counted.columns[:-1]).agg(F.sum("n").alias("n")), "punkt-neighbours")


def _total(n: str, condition: str) -> Column:
    return F.sum(F.when(F.expr(condition), F.col(n)).otherwise(0))


def types(pairs: DataFrame) -> DataFrame:
    """(type, stops, plain, score, abbreviation): counts of each word with and without a stop, and whether it is an abbreviation."""
    n = pairs.groupBy("type").agg(_total("n", "ending = 'stop'").alias("stops"), _total("n", "ending <> 'stop'").alias("plain"))
    whole = n.agg(F.sum("stops").alias("all_stops"), F.sum(F.col("stops") + F.col("plain")).alias("all"))
    n = n.join(F.broadcast(whole))  # one row
    p = F.least(F.greatest(F.col("all_stops") / F.col("all"), F.lit(1e-9)), F.lit(1 - 1e-9))
    likely = -2 * (F.col("stops") * (F.log(p) - F.log(F.lit(STOPPED))) + F.col("plain") * (F.log(1 - p) - F.log(F.lit(1 - STOPPED))))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.length("type") - inner).cast("double")
    score = likely * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("plain"))
    counts = (F.col("stops") > 0) & F.col("type").rlike(r"\p{L}") & (F.col("type") != NUMBER)
    return n.select("type", "stops", "plain", F.when(counts, score).otherwise(0.0).alias("score")).withColumn("abbreviation", F.col("score") >= ABBREVIATION)


def dependence(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Log likelihood ratio that of n places the a and the b ones fall together ab times for a reason."""

    def term(hits: Column, misses: Column, p: Column) -> Column:
        return F.when((p > 0) & (p < 1), hits * F.log(p) + misses * F.log(1 - p)).otherwise(0.0)

    p, p1, p2 = b / n, ab / a, F.when(n > a, (b - ab) / (n - a)).otherwise(0.0)
    rest = n - a - b + ab
    apart = term(ab, a - ab, p) + term(b - ab, rest, p)
    together = F.when(a == ab, 0.0).otherwise(term(ab, a - ab, p1)) + F.when(b == ab, 0.0).otherwise(term(b - ab, rest, p2))
    return -2 * (apart - together)


def in_context(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """pairs with place: what a first guess makes of a word's place, 'first', 'inner' or 'unknown' (behind an ellipsis or an abbreviation)."""
    short = kinds.filter("abbreviation").select(F.col("type").alias("before"), F.lit(True).alias("short"))
    stopped = pairs.filter("before_ending = 'stop'").join(short, "before", "left")
    others = pairs.filter("before_ending IS NULL OR before_ending <> 'stop'").withColumn("short", F.lit(None).cast("boolean"))
    both = stopped.select(*pairs.columns, "short").unionByName(others.select(*pairs.columns, "short"))
    place = F.when(F.col("before").isNull() | (F.col("before_ending") == "hard"), "first").when(F.col("before_ending") == "ellipsis", "unknown")
    place = place.when(F.col("before_ending") == "none", "inner").when(F.coalesce("short", F.lit(False)), "unknown").otherwise("first")
    return both.withColumn("place", place)


def places(placed: DataFrame) -> DataFrame:
    """(type, upper_inner, lower_first, upper, lower, at_first, total): in which cases a word stands where, how often behind a sentence's end, and how often at all."""

    def seen(condition: str) -> Column:
        return F.bool_or(F.expr(condition))

    return placed.groupBy("type").agg(
        seen("case = 'upper' AND place = 'inner'").alias("upper_inner"),
        seen("case = 'lower' AND place = 'first'").alias("lower_first"),
        seen("case = 'upper'").alias("upper"),
        seen("case = 'lower'").alias("lower"),
        _total("n", "place = 'first' AND before IS NOT NULL").alias("at_first"),
        F.sum("n").alias("total"),
    )


def starters(placed: DataFrame) -> DataFrame:
    """(type, at_first, total, score, starter): words that stand behind a sentence's end more often than by chance."""
    return _starters(places(placed).select("type", "at_first", "total"))


def _starters(per: DataFrame) -> DataFrame:
    whole = per.agg(F.sum("at_first").alias("ends"), F.sum("total").alias("all"))
    per = per.filter("at_first > 0").join(F.broadcast(whole))  # one row
    score = dependence(F.col("ends").cast("double"), F.col("total").cast("double"), F.col("at_first").cast("double"), F.col("all").cast("double"))
    found = per.filter(F.col("type").rlike(r"^\p{L}")).select("type", "at_first", "total", score.alias("score"), (F.col("all") / F.col("ends") > F.col("total") / F.col("at_first")).alias("drawn"))
    return found.select("type", "at_first", "total", "score", (F.col("drawn") & (F.col("score") >= STARTER)).alias("starter"))


def _special(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """pairs behind a stop that need not end a sentence, that of an abbreviation (short), an initial or a number, or behind an ellipsis; most stops are none of these."""
    short = kinds.filter("abbreviation").select(F.col("type").alias("before"), F.lit(True).alias("short"))
    held = pairs.filter("before_ending IN ('stop', 'ellipsis')").join(short, "before", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    return held.filter(F.col("short") | (F.col("before_ending") == "ellipsis") | (F.col("before") == NUMBER) | F.col("before").rlike(r"^\p{L}$"))


def collocations(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(before, type, together, score, collocation): pairs that keep together over a stop, of an abbreviation, an initial or a number with a word."""
    worded = F.col("type").rlike(r"[\p{L}#]") & F.col("before").rlike(r"[\p{L}#]")
    count = F.col("stops") + F.col("plain")
    left = kinds.select(F.col("type").alias("before"), count.alias("a"))
    right = kinds.select("type", count.alias("b"))
    whole = kinds.agg(F.sum(count).alias("all"))
    per = _special(pairs.filter("before_ending = 'stop'").filter(worded), kinds).groupBy("before", "type").agg(F.sum("n").alias("together")).filter("together > 1")
    per = per.join(left, "before").join(right, "type").join(F.broadcast(whole))  # one row
    score = dependence(F.col("a").cast("double"), F.col("b").cast("double"), F.col("together").cast("double"), F.col("all").cast("double"))
    drawn = F.col("all") / F.col("a") > F.col("b") / F.col("together")
    return per.select("before", "type", "together", score.alias("score"), (drawn & (score >= COLLOCATION)).alias("collocation"))


def joined_stops(pairs: DataFrame) -> DataFrame:
    """(before, type, case): words around a stop or an ellipsis that doesn't end a sentence. All others end one; so does ! or ?."""
    kinds = stored(types(pairs), "punkt-types")
    per = stored(places(in_context(pairs, kinds)), "punkt-places")
    found = _special(pairs, kinds).select("before", "before_ending", "type", "case", "short").distinct()
    found = found.join(collocations(pairs, kinds).filter("collocation").select("before", "type", F.lit(True).alias("drawn")), ["before", "type"], "left")
    found = found.join(per.drop("at_first", "total"), "type")  # each type has its places
    found = found.join(_starters(per).filter("starter").select("type", F.lit(True).alias("opens")), "type", "left")
    ellipsis = F.col("before_ending") == "ellipsis"
    upper, lower = F.col("case") == "upper", F.col("case") == "lower"
    begins = F.when(upper & F.col("lower") & ~F.col("upper_inner"), True).when(lower & (F.col("upper") | ~F.col("lower_first")), False)
    initial, number = F.col("before").rlike(r"^\p{L}$") & ~ellipsis, (F.col("before") == NUMBER) & ~ellipsis
    short = F.col("short") | ellipsis
    ends = F.when(F.coalesce("drawn", F.lit(False)) & ~ellipsis, False)
    ends = ends.when(short & ~initial & F.coalesce(begins, F.lit(False)), True)
    ends = ends.when(short & ~initial & upper & F.coalesce("opens", F.lit(False)), True)
    ends = ends.when((initial | number) & (begins == F.lit(False)), False)
    ends = ends.when(initial & begins.isNull() & upper & ~F.col("lower"), False)
    return found.filter(~ends.otherwise(~short)).select("before", "before_ending", "type", "case")


def _hash(parts: Iterable[tuple[str, str]]) -> np.ndarray:
    """A hash of 64 bits for each pair of strings."""
    return np.frombuffer(b"".join(blake2b(f"{a}\0{b}".encode("utf-8", "replace"), digest_size=8).digest() for a, b in parts), np.uint64)


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * np.uint64(0x9E3779B97F4A7C15) + second).view(np.int64)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, ending, kind, case = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(_mixed(_hash(zip(before, ending)), _hash(zip(kind, case))))], ["h"])


class _Hashes(Words):
    """Words with the hashes that they have before and behind a stop, made once each."""

    def __init__(self) -> None:
        super().__init__()
        self.first = self.second = np.zeros(0, np.uint64)

    def stops(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a word ends a sentence for sure, and where a stop or an ellipsis is followed by a word, with the hashes of these pairs."""
        new = self.since(len(self.first))
        self.first = np.r_[self.first, _hash((t, str(_ENDINGS[e])) for t, e, _ in new)]
        self.second = np.r_[self.second, _hash((t, c) for t, _, c in new)]
        kind = self.endings()[ids]
        last = np.zeros(len(ids), bool)
        last[ends[ends > 0] - 1] = True
        at = np.flatnonzero(~last & ((kind == STOP) | (kind == ELLIPSIS)))
        return last | (kind == HARD), at, _mixed(self.first[ids[at]], self.second[ids[at + 1]])


def split(docs: DataFrame, joined: DataFrame, keys: Sequence[str], text: str = "text", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(keys, sent_no from 1, sentence) of texts, by the pairs of joined_stops().

    Up to max_pairs pairs go to the workers as hashes; more are joined with the stops of
    the texts, whose rows are then named by keys, which must be unique. Null and blank
    texts have no sentence.
    """
    ship(docs.sparkSession)
    joined = stored(joined.select("before", "before_ending", "type", "case").mapInArrow(_joined, "h long").distinct(), "punkt-joined")
    rows = dealt(docs.select(*keys, text))
    named = T_.StructType([docs.schema[k] for k in keys])
    few = joined.count() <= max_pairs
    if few:
        held = docs.sparkSession.sparkContext.broadcast(np.sort(joined.toArrow().column(0).to_numpy()))
    else:

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Hashes()
            for batch in batches:
                for begin, _, ids, ends in _slices(batch.column(len(keys)), known):
                    _, at, pair = known.stops(ids, ends)
                    row = np.searchsorted(ends, at, "right")
                    inside = at - np.r_[0, ends][row]
                    named = [batch.column(k).take(pa.array(row + begin)) for k in range(len(keys))]
                    yield from _parts(pa.RecordBatch.from_arrays([*named, pa.array(inside), pa.array(pair)], [*keys, "_place", "_h"]))
                    if len(known) > HELD:
                        known.forget()

        stops = rows.mapInArrow(asked, T_.StructType([*named, T_.StructField("_place", T_.LongType()), T_.StructField("_h", T_.LongType())]))
        stops = stops.join(joined.withColumnRenamed("h", "_h"), "_h", "left_semi")
        other = [F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)]
        on = stops.groupBy(*keys).agg(F.collect_list("_place").alias("_on")).select(*other, "_on")
        same = [F.col(k).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)]
        rows = rows.join(on, same, "left").select(*keys, text, "_on")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for begin, found, ids, ends in _slices(batch.column(len(keys)), known):
                over, at, pair = known.stops(ids, ends)
                over[at] = True
                if few:
                    if len(held.value):
                        near = np.minimum(np.searchsorted(held.value, pair), len(held.value) - 1)
                        over[at[held.value[near] == pair]] = False
                else:
                    on = batch.column(len(keys) + 1).slice(begin, len(found))
                    many = pc.fill_null(pc.list_value_length(on), 0).to_numpy(zero_copy_only=False)
                    over[np.repeat(np.r_[0, ends[:-1]], many) + on.flatten().to_numpy(zero_copy_only=False)] = False
                lasts = np.flatnonzero(over)
                row = np.searchsorted(ends, lasts, "right")
                number = np.arange(len(lasts)) - np.searchsorted(row, row, "left") + 1
                flat = [p for f in found for p in f]
                begins = np.r_[0, lasts[:-1] + 1][: len(lasts)]
                sentence = [" ".join(flat[a:b]) for a, b in zip(begins.tolist(), (lasts + 1).tolist())]
                named = [batch.column(k).take(pa.array(row + begin)) for k in range(len(keys))]
                yield from _parts(pa.RecordBatch.from_arrays([*named, pa.array(number.astype(np.int32)), pa.array(sentence, pa.string())], [*keys, "sent_no", "sentence"]))
                if len(known) > HELD:
                    known.forget()

    return rows.mapInArrow(cut, T_.StructType([*named, T_.StructField("sent_no", T_.IntegerType()), T_.StructField("sentence", T_.StringType())]))
