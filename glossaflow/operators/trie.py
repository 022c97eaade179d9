"""Greedy longest-match splitting in one pass over a word, by a double-array trie with failure links.

After Song et al., "Fast WordPiece Tokenization" (2021). Two tries share the arrays: one
of whole tokens, for a word's beginning, and one of the ## tokens without their ##, for
what follows. A node's failure link says where matching goes on when no child fits, and
its pops which tokens are thereby settled, so no character is read twice.

The arrays are one file that each executor gets once (SparkFiles) and its workers map
into memory, so they share its pages.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from ..session import fresh_path, put_bytes

FIRST, REST = 1, 2  # the two roots; cell 0 stays empty
_NONE = -1
_PARTS = ("letters", "base", "check", "fail", "pop_at", "pops", "length", "ids")


def _layout(tokens: list[tuple[str, int]]) -> dict[str, np.ndarray]:
    """The arrays of a vocabulary (token, id)."""
    words = [(FIRST, t, i) for t, i in tokens if t] + [(REST, t[2:], i) for t, i in tokens if t.startswith("##") and len(t) > 2]
    letters = sorted({c for _, t, _ in words for c in t})
    code = {c: k + 1 for k, c in enumerate(letters)}
    # nested children first: each node is a dict of code to node, and may end a word
    roots: dict[int, dict] = {FIRST: {}, REST: {}}
    for k, (root, t, _) in enumerate(words):
        node = roots[root]
        for c in t:
            node = node.setdefault(code[c], {})
        node[0] = k  # of equal tokens the last counts
    used = bytearray(b"\1\1\1" + bytes(1021))  # of each cell
    base, check = array("q", bytes(8 * len(used))), array("q", [0, 0, 0, *[_NONE] * 1021])
    top = REST  # the last cell in use
    end = {}  # cell to word
    order = []  # (cell, parent's cell, code), parents first
    free = 3  # no cell below is free

    def place(codes: list[int]) -> int:
        """A base at which all cells of the codes are free: of the first few that might do, else behind all others."""
        nonlocal free
        at = used.find(0, free)
        free = at if at >= 0 else len(used)
        for _ in range(32):
            begin = at - codes[0]
            if at < 0 or begin + codes[-1] >= len(used):
                break
            if begin > 0 and not any(used[begin + c] for c in codes):
                return begin
            at = used.find(0, at + 1)
        begin = max(1, top + 1 - codes[0])
        more = begin + codes[-1] + 1 - len(used)
        if more > 0:
            more = max(more, len(used))
            used.extend(bytes(more))
            base.extend([0] * more)
            check.extend([_NONE] * more)
        return begin

    queue = [(FIRST, roots[FIRST]), (REST, roots[REST])]
    for cell, node in queue:
        if 0 in node:
            end[cell] = node[0]
        codes = sorted(k for k in node if k)
        if not codes:
            continue
        base[cell] = at = place(codes)
        top = max(top, at + codes[-1])
        for c in codes:
            check[at + c] = cell
            used[at + c] = 1
            order.append((at + c, cell, c))
            queue.append((at + c, node[c]))
    size = len(used)
    fail, pops = {FIRST: 0, REST: 0}, {FIRST: [], REST: []}

    def child(cell: int, c: int) -> int:
        to = base[cell] + c
        return to if base[cell] and to < size and check[to] == cell else 0

    for cell, parent, c in order:
        if cell in end:
            fail[cell], pops[cell] = REST, [end[cell]]
            continue
        z, settled = fail[parent], list(pops[parent])
        while z and not child(z, c):
            settled += pops[z]
            z = fail[z]
        fail[cell], pops[cell] = (child(z, c), settled) if z else (0, [])
    links, at = np.zeros(size, np.int64), np.zeros(size + 1, np.int64)
    for cell, z in fail.items():
        links[cell] = z
        at[cell + 1] = len(pops[cell])
    at = np.cumsum(at)
    flat = np.zeros(int(at[-1]), np.int64)
    for cell, found in pops.items():
        flat[at[cell] : at[cell] + len(found)] = found
    lengths, ids = [len(t) for _, t, _ in words], [i for _, _, i in words]
    found = dict(zip(_PARTS, ([ord(c) for c in letters], base, check, links, at, flat, lengths, ids)))
    return {k: np.asarray(v, np.int64 if k == "ids" else np.int32) for k, v in found.items()}


def packed(tokens: Iterable[tuple[str, int]]) -> bytes:
    """A vocabulary's arrays in one file: eight lengths, then the arrays, each at a multiple of eight bytes."""
    parts = _layout(list(tokens))
    out = [np.array([len(parts[k]) for k in _PARTS], np.int64).tobytes()]
    for k in _PARTS:
        data = parts[k].tobytes()
        out.append(data + bytes(-len(data) % 8))
    return b"".join(out)


class Trie:
    """A packed vocabulary, from a file's memory map or any other buffer."""

    def __init__(self, data):
        view, at = memoryview(data).cast("B"), 8 * len(_PARTS)
        for k, n in zip(_PARTS, view[:at].cast("q")):
            width, kind = (8, "q") if k == "ids" else (4, "i")
            setattr(self, k, view[at : at + width * n].cast(kind))
            at += width * n + -width * n % 8
        self.code = {chr(c): k + 1 for k, c in enumerate(self.letters)}

    def split(self, word: str) -> tuple[list[str], list[int]] | None:
        """Pieces and ids, or None where the greedy match doesn't come out."""
        base, check, fail, at, pops, code = self.base, self.check, self.fail, self.pop_at, self.pops, self.code
        node, found, size = FIRST, [], len(check)
        for c in word:
            k = code.get(c, 0)
            if not k:
                return None
            while True:
                to = base[node] + k
                if base[node] and to < size and check[to] == node:
                    node = to
                    break
                if not fail[node]:
                    return None
                found.extend(pops[at[node] : at[node + 1]])
                node = fail[node]
        while node != REST:
            if not fail[node]:
                return None
            found.extend(pops[at[node] : at[node + 1]])
            node = fail[node]
        pieces, done = [], 0
        for k in found:
            n = self.length[k]
            pieces.append(("##" if done else "") + word[done : done + n])
            done += n
        return pieces, [self.ids[k] for k in found]


def publish(spark: SparkSession, tokens: Iterable[tuple[str, int]]) -> str:
    """Packs a vocabulary and has every executor fetch the file; its name is what workers open() it by."""
    path = f"{fresh_path(spark, 'trie')}-{uuid.uuid4().hex}.bin"
    put_bytes(spark, path, packed(tokens))
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


@lru_cache(maxsize=2)
def opened(name: str) -> Trie:
    """The trie of publish() in a worker."""
    return Trie(np.memmap(SparkFiles.get(name), dtype=np.uint8, mode="r"))
