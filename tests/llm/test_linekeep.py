import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from glossaflow.llm import linekeep

SCHEMA = "doc_id long, text string, n_lines string, t1 string"
WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plain(rows, min_chars=20, min_docs=3):
    """rows (doc_id, text) to (doc_id, n_lines, n_dropped, kept text)."""
    holders = {}
    for at, (i, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(at)
    order = lambda i: (i is not None, i or 0)
    keeper = {k: max((rows[at][0] for at in found), key=order) for k, found in holders.items() if len(found) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA).repartition(parts)
    done = linekeep.apply(df, linekeep.keep_bitmaps(df))
    assert done.columns == ["doc_id", "text", "n_lines", "t1", "_n_lines", "n_dropped"]
    return sorted(((r["doc_id"], r["_n_lines"], r["n_dropped"], r["text"]) for r in done.collect()), key=repr)


def corpus(rng, n):
    common = [f"this line number {i} is shared by many" for i in range(12)] + ["Une Ligne Éclatante Déjà", "ééééééééééééééééééé", "éééééééééééééééééééé", "日本" * 12, "short", "", "  ", "x" * 20, "x" * 19]
    rows = []
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < 0.7 else f"own {rng.random()}" for _ in range(rng.randrange(0, 9))]
        lines = [rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\x0b ", "\r"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("n", [2, 40, 700])
def test_against_plain(spark, n):
    rows = corpus(random.Random(n), n)
    rows += [(None, "x" * 20), (None, None), (9001, None), (9002, ""), (9003, "\n\n"), (9004, " " + "y" * 20), (9005, " " + "x" * 20)]
    rows += [rows[0]] * 3 + [(5, "another text under an id that is there\n" + "x" * 25)] * 2
    assert run(spark, rows) == plain(rows)


def test_all_without_id(spark):
    rows = [(None, "a line of twenty or more\nb")] * 4
    assert run(spark, rows) == plain(rows)


def test_hot_line_over_many_partitions(spark):
    """One line in every document, and in one document thousands of times: it goes across partition edges."""
    rows = [(i, f"a line that stands in every document\nown line of document number {i}\nanother of {i % 40} groups of documents") for i in range(900)]
    rows.append((1000, "\n".join(["a line that stands in every document", "z"] * 5000)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows, 7) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_stream_at_any_cut():
    """Sorted rows cut into any partitions and batches give the same decisions."""
    rng = random.Random(7)
    for _ in range(300):
        rows = sorted(
            {(rng.randrange(4), 0, rng.choice([None, *range(6)]), r) for r in range(rng.randrange(1, 25))},
            key=lambda r: (r[0], r[2] is None, -(r[2] or 0), r[3]),
        )
        min_docs = rng.choice([1, 2, 3, 4])
        size, told = len(rows), []
        cuts = sorted(rng.sample(range(size + 1), min(size, 3)))
        for a, b in zip([0, *cuts], [*cuts, size]):
            batches = []
            while a < b:
                e = min(b, a + rng.randrange(1, 5))
                cols = list(zip(*rows[a:e]))
                batches.append(pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([[r] for r in cols[3]], pa.list_(pa.int32()))], names=["h1", "h2", "doc_id", "row", "lines"]))
                a = e
            for x in linekeep._stream(min_docs)(iter(batches)):
                told += x.to_pylist()
        gone = {t["row"] for t in told if t["docs"] == 0}
        late = [t for t in told if t["docs"]]
        for h in {t["h1"] for t in late}:
            mine = [t for t in late if t["h1"] == h]
            keeper = max((t["doc_id"] for t in mine if t["doc_id"] is not None), default=None)
            if sum(t["docs"] for t in mine) >= min_docs:
                gone |= {t["row"] for t in mine if t["row"] is not None and t["doc_id"] != keeper}
        want = set()
        for h in range(4):
            mine = [r for r in rows if r[0] == h]
            if mine and len(mine) >= min_docs:
                want |= {r[3] for r in mine if r[2] != mine[0][2]}
        assert gone == want


def test_bitmaps():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 300, 5000):
        for share in (0, 0.05, 0.5, 1):
            keep = rng.random(n) >= share
            bits = linekeep.to_bitmap(n, np.flatnonzero(~keep))
            assert np.array_equal(linekeep.from_bitmap(n, bits), keep)
    assert len(linekeep.to_bitmap(100_000, range(500, 99_000))) <= 9


def test_empty_and_long(spark):
    assert run(spark, []) == []
    rows = [(i, "w" * 300_000 + "\n" + "\n".join(f"line {k} of a very long document" for k in range(20_000))) for i in range(3)]
    got = run(spark, rows)
    assert [(r[0], r[1], r[2]) for r in got] == [(0, 20_001, 20_001), (1, 20_001, 20_001), (2, 20_001, 0)]
    assert hashlib.sha256(got[2][3].encode()).digest() == hashlib.sha256(rows[2][1].encode()).digest()
