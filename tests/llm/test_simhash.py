import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from glossaflow.llm import simhash

SCHEMA = "doc_id long, text string, fp string, row string"


def brute_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = min((x for x in (d, least.get(r)) if x is not None), default=None)
    return sorted(((d, f, least[r]) for (d, _), f, r in zip(rows, fps, root)), key=str)


@given(st.text(alphabet="aAb é\n\t ", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fp(text)


def test_close_lanes():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.array([int(base[i % 5]) ^ sum(1 << int(b) for b in rng.choice(64, i % 9, False)) for i in range(192)], np.uint64)
    planes = simhash._planes(fps)
    for radius in range(8):
        q, b = np.repeat(fps, 3), np.tile(np.arange(3), 192)
        hit, lanes = simhash.close_lanes(planes, q, b, radius, first=11)
        got = {(int(i) // 3, int(b[i]) * 64 + j) for i, w in zip(hit, lanes) for j in range(64) if int(w) >> j & 1}
        assert got == {(i, j) for i in range(192) for j in range(192) if int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_bands_miss_nothing():
    rng = random.Random(3)
    for bands in (5, 6, 7):
        masks = simhash.band_masks(bands, 4)
        for _ in range(300):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not d & m for m in masks)


def test_links_in_tiles(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = list({base[i % 6] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for i in range(400)} | {rng.getrandbits(64) for _ in range(100)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {}
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    for s, r in zip(signed, root):
        want.setdefault(r, set()).add(s)
    for tile in (7, 10_000):
        got = {}
        for r in simhash.components(simhash.links(df, tile_rows=tile)).collect():
            got.setdefault(r["root"], set()).add(r["node"])
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
        assert all(min(v) == k for k, v in got.items())


def rows_with_copies():
    rng = random.Random(7)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randrange(40, 120))]
        rows.append((i * 3, " ".join(w)))
        for k in range(i % 4):
            v = list(w)
            v[rng.randrange(len(v))] = "X%d" % k
            rows.append((i * 3 + 200 + k, " ".join(v)))
    rows += [(7, None), (8, ""), (9, "  \n"), (None, rows[0][1]), (3, rows[1][1]), (3, rows[1][1]), (901, "a " * 40_000)]
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = rows_with_copies()
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = simhash.near_duplicates(df).collect()
    assert sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got), key=str) == brute_components(rows)


def test_keep_one(spark):
    rows = rows_with_copies()
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    want = {c for _, _, c in brute_components(rows)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0
