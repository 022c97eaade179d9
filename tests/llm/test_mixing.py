import math
import random
from fractions import Fraction

from glossaflow.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = Fraction(3 * sum(sizes.values()), 2), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= 2 * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = Fraction(2 * sizes[s])
        open_ -= over
        left -= sum(target[s] for s in over)
    return target


def test_targets_and_cuts(spark):
    rng = random.Random(4)
    docs = []
    for i in range(900):
        s = rng.choice(["a", "a", "a", "b", "é", "Z", None, "c", "d", ""])
        docs.append((i if i % 50 else None, " ".join(["w"] * rng.randrange(0, 30 if s != "d" else 3)) or None, s, "x", "y"))
    docs += [(5, "one two three", "rep", "x", "y")] * 40 + [(6, "w\n" * 50_000, "long", "x", "y"), (7, " ", "blank", "x", "y"), (8, "", "void", "x", "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size string, key string")
    sizes = {}
    for _, t, s, *_ in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = brute_targets(sizes)
    for rows in (50_000, 4):
        out = mixing.mix(df, range_rows=rows)
        assert out.columns == [*df.columns, "_size", "source_size", "target", "taken"]
        got = out.collect()
        assert len(got) == len(docs)
        taken = {}
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["_size"]
            assert r["source_size"] == sizes[r["source"]]
            assert math.isclose(r["target"], float(want[r["source"]]), rel_tol=1e-12)
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        for s, t in want.items():
            assert abs(taken[s] - t) <= (40 if s in ("rep", None) else 1), s
        rerun = mixing.mix(df.repartition(3), range_rows=rows)
        key = lambda rows: sorted((str(r["doc_id"]), r["text"] or "", str(r["source"]), r["taken"]) for r in rows)
        assert key(rerun.collect()) == key(got)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()] == [0]


def test_apply_drops_and_repeats(spark):
    rows = [(i, "w " * (i % 7), "abc"[i % 3] if i % 5 else None, 1, 2, 3) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch int, mix_sk int, mix_plan int")
    want = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert all((r["mix_sk"], r["mix_plan"]) == (2, 3) for r in want.values())
    out = mixing.apply(df)
    assert out.columns == [*df.columns, "size", "source_size", "target", "taken", "_epoch"]
    copies = {}
    for r in out.collect():
        copies.setdefault(r["doc_id"], []).append(r)
    assert set(copies) == {d for d, r in want.items() if r["taken"]}
    for d, rs in copies.items():
        rs.sort(key=lambda r: r["_epoch"])
        assert [r["_epoch"] for r in rs] == list(range(len(rs))) and sum(r["taken"] for r in rs) == want[d]["taken"]
        assert all(r["taken"] == r["size"] for r in rs[:-1]) and 0 < rs[-1]["taken"] <= rs[-1]["size"] and rs[0]["epoch"] == 1
    assert mixing.apply(df.limit(0)).count() == 0


def test_clashing_names(spark):
    """Columns named like any helper stay as they are."""
    names = ["sk", "key", "_sk", "_p", "mix_sk", "mix_plan", "prefix", "rest", "epochs", "cut_key", "s", "size", "source_size", "target", "taken"]
    df = spark.createDataFrame([(1, "a b", "x", *names), (2, "c", None, *names)], ["doc_id", "text", "source", *names])
    for r in mixing.mix(df, range_rows=1).collect():
        assert [r[n] for n in names] == names and 0 <= r["_taken"] <= 2 * r["_size"]
