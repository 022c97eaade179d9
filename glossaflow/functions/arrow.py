"""Arrow functions for what is costly as nested expressions: units of texts with their places, phrases of labelled words.

Spark deals out the rows; each function sees a batch of one column, takes it in slices of
about SLICE bytes, and its arrays are made at once for a slice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..session import ship
from . import text as T

#: Bytes of text whose Python strings are held at once.
SLICE = 1 << 21
_UNIT = re.compile(rf"{T.LETTER}+(?:[\-–—]{T.LETTER}+)*|\.\.\.|{T.MARK}")
_PLACED = "array<struct<unit:string,start_c:bigint,end_c:bigint,start_b:bigint,end_b:bigint>>"
_PHRASES = "array<struct<text:string,type:string,base:string,start_b:bigint,end_b:bigint,start_c:bigint,end_c:bigint>>"


def function(run, kind: str, column: Column) -> Column:
    """run, Arrow array to Arrow array, over a column; the package is on the workers."""
    ship(SparkSession.active())
    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(column)


def slices(x: pa.Array) -> Iterator[pa.Array]:
    """x in parts of about SLICE bytes, at least one."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(x) or at == 0:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")))
        yield x.slice(at, end - at)
        at = end


def strings(x: pa.Array) -> list[str]:
    """The texts; null is empty, and bytes that aren't UTF-8 are replaced."""
    try:
        return [s or "" for s in x.to_pylist()]
    except UnicodeDecodeError:
        return [(s or b"").decode("utf-8", "replace") for s in x.cast(pa.binary()).to_pylist()]


def offsets(counts) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(np.asarray(counts, np.int64))], pa.int32())


def lists(x: pa.Array, counts, values: pa.Array) -> pa.Array:
    """A list for each row of x, null where x is."""
    return pa.ListArray.from_arrays(offsets(counts), values, mask=pc.is_null(x)) if x.null_count else pa.ListArray.from_arrays(offsets(counts), values)


def units(c: Column) -> Column:
    """The words and marks of a text, in order: text.units()."""

    def run(x):
        done = []
        for part in slices(x):
            found = [_UNIT.findall(s) for s in strings(part)]
            done.append(lists(part, [len(f) for f in found], pa.array([u for f in found for u in f], pa.string())))
        return pa.concat_arrays(done)

    return function(run, "array<string>", c)


def unit_counts(c: Column) -> Column:
    """The distinct units of a text, each with how often it occurs."""

    def run(x):
        done = []
        for part in slices(x):
            found = [Counter(_UNIT.findall(s)) for s in strings(part)]
            fields = [pa.array([u for f in found for u in f], pa.string()), pa.array([n for f in found for n in f.values()], pa.int64())]
            done.append(lists(part, [len(f) for f in found], pa.StructArray.from_arrays(fields, ["unit", "n"])))
        return pa.concat_arrays(done)

    return function(run, "array<struct<unit:string,n:bigint>>", c)


def placed_units(c: Column, most: int | None = None) -> Column:
    """The units of a text in order (the first most, if that is given), with their places in code points and bytes."""

    def run(x):
        return pa.concat_arrays([placed(part, most) for part in slices(x)])

    return function(run, _PLACED, c)


def placed(part: pa.Array, most: int | None) -> pa.Array:
    texts = strings(part)
    found = [list(_UNIT.finditer(s)) for s in texts] if most is None else [[m for m, _ in zip(_UNIT.finditer(s), range(most))] for s in texts]
    counts = np.array([len(f) for f in found], np.int64)
    unit = pa.array([m.group() for f in found for m in f], pa.string())
    start = np.array([m.start() for f in found for m in f], np.int64)
    # the byte at which each code point of all the texts begins
    first = np.frombuffer("".join(texts).encode(), np.uint8)
    at_byte = np.r_[np.flatnonzero((first & 0xC0) != 0x80), len(first)]
    before = np.cumsum([0, *(len(s) for s in texts)])[:-1]
    text_at = np.repeat(before, counts)
    start_b = at_byte[text_at + start] - at_byte[text_at]
    end = start + pc.utf8_length(unit).to_numpy(zero_copy_only=False)
    end_b = start_b + pc.binary_length(unit).to_numpy(zero_copy_only=False)
    fields = [unit, *(pa.array(v.astype(np.int64)) for v in (start, end, start_b, end_b))]
    return lists(part, counts, pa.StructArray.from_arrays(fields, ["unit", "start_c", "end_c", "start_b", "end_b"]))


def phrases(words: Column, by: str) -> Column:
    """Labelled words (unit, label, base and places) of each row to phrases; by, 'b' or 'c', tells in what the gaps are measured."""

    def run(x):
        w = x.flatten()
        if not len(w):
            return lists(x, np.zeros(len(x), np.int64), joined(w, np.zeros(0, np.int64), np.zeros(0, bool)))
        counts = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(x)), counts)
        label, base = w.field("label"), w.field("base")
        gap = w.field(f"start_{by}").to_numpy(zero_copy_only=False)[1:] - w.field(f"end_{by}").to_numpy(zero_copy_only=False)[:-1]
        same = pc.fill_null(pc.equal(base.slice(1), base.slice(0, len(w) - 1)), False).to_numpy(zero_copy_only=False)
        inner = pc.fill_null(pc.starts_with(label, "I-"), False).to_numpy(zero_copy_only=False)[1:]
        new = np.r_[True, ~(inner & same & (gap >= 0) & (gap <= 2) & (row[1:] == row[:-1]))]
        at = np.flatnonzero(new)
        return lists(x, np.bincount(row[at], minlength=len(x)), joined(w, at, new))

    return function(run, _PHRASES, words)


def joined(w: pa.Array, at: np.ndarray, new: np.ndarray) -> pa.Array:
    """The phrases that begin at the words at."""
    last = np.r_[at[1:], len(w)] - 1 if len(at) else at
    text = glued(w.field("unit"), at, " ")
    ends = [w.field(name).take(pa.array(where)) for name, where in (("label", at), ("base", at), ("start_b", at), ("end_b", last), ("start_c", at), ("end_c", last))]
    return pa.StructArray.from_arrays([text, *ends], ["text", "type", "base", "start_b", "end_b", "start_c", "end_c"])


def token_phrases(pieces: Column, text: Column, unknown: str | None = None) -> Column:
    """The phrases of each sentence's labelled tokens, arrays of (token, label_id, start_b, end_b).

    Special tokens go, ids without a label go or get the label unknown, ends before starts
    are swapped, a token at (0, 0) goes if one before it ends elsewhere, ## pieces go on
    with the word before them, marks go, and words are joined as in phrases() by bytes.
    """
    labels = [x[1] for x in schema.LABELS]
    ship(SparkSession.active())

    def run(x: pa.Array, text: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        w, row = x.flatten(), np.repeat(np.arange(len(x)), counts)
        ids = pc.fill_null(w.field("label_id"), -1).to_numpy(zero_copy_only=False)
        fit = (ids >= 0) & (ids < len(labels))
        keep = ~flags(pc.is_in(w.field("token"), pa.array(["[CLS]", "[SEP]", "[PAD]"])))
        keep = keep if unknown else keep & fit
        token, row = w.field("token").filter(pa.array(keep)), row[keep]
        label = pa.array([*labels, unknown], pa.string()).take(pa.array(np.where(fit, ids, len(labels))[keep]))
        a, b = (w.field(c).to_numpy(zero_copy_only=False)[keep] for c in ("start_b", "end_b"))
        low, high = np.minimum(a, b), np.maximum(a, b)
        before = np.where(np.r_[False, row[1:] == row[:-1]][: len(row)], np.r_[0, high[:-1]][: len(row)], 0)
        keep = ~((low == 0) & (high == 0) & (before != 0))
        token, label, row, low, high = token.filter(pa.array(keep)), label.filter(pa.array(keep)), row[keep], low[keep], high[keep]
        if not len(row):
            return lists(x, np.zeros(len(x), np.int64), pa.array([], _FOUND))
        # words
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]] | ~flags(pc.starts_with(token, "##")))
        word = glued(pc.replace_substring_regex(token, "^##", ""), at, "")
        rank = np.where(flags(pc.starts_with(label, "B-")), 0, np.where(flags(pc.starts_with(label, "I-")), 1, 2))
        main = label.take(pa.array(np.minimum.reduceat(rank * len(row) + np.arange(len(row)), at) % len(row)))
        low, high, row = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), row[at]
        keep = ~flags(pc.is_in(word, pa.array(T.PUNCTUATION)))
        word, main, low, high, row = word.filter(pa.array(keep)), main.filter(pa.array(keep)), low[keep], high[keep], row[keep]
        if not len(row):
            return lists(x, np.zeros(len(x), np.int64), pa.array([], _FOUND))
        whole = [s.encode() for s in strings(text)]
        unit = [whole[r][i:j].decode("utf-8", "replace") if i < j <= len(whole[r]) else v for r, i, j, v in zip(row.tolist(), low.tolist(), high.tolist(), word.to_pylist())]
        # phrases
        base = pc.replace_substring_regex(main, "^[BI]-", "")
        gap = low[1:] - high[:-1]
        on = flags(pc.starts_with(main, "I-"))[1:] & flags(pc.equal(base.slice(1), base.slice(0, len(base) - 1))) & (gap >= 0) & (gap <= 2) & (row[1:] == row[:-1])
        at = np.flatnonzero(np.r_[True, ~on])
        fields = [glued(pa.array(unit, pa.string()), at, " "), main.take(pa.array(at)), pa.array(np.minimum.reduceat(low, at).astype(np.int64)), pa.array(np.maximum.reduceat(high, at).astype(np.int64))]
        return lists(x, np.bincount(row[at], minlength=len(x)), pa.StructArray.from_arrays(fields, ["text", "type", "start_b", "end_b"]))

    run.__annotations__ = {"x": pa.Array, "text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<text:string,type:string,start_b:bigint,end_b:bigint>>")(pieces, text)


_FOUND = pa.struct([("text", pa.string()), ("type", pa.string()), ("start_b", pa.int64()), ("end_b", pa.int64())])


def flags(x) -> np.ndarray:
    """A boolean array, false where it is null."""
    return pc.fill_null(x, False).to_numpy(zero_copy_only=False)


def glued(parts: pa.Array, at: np.ndarray, between: str) -> pa.Array:
    """parts joined from each place in at to the next."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[at, len(parts)], pa.int32()), parts), between)
