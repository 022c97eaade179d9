import random
import re

from glossaflow.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w = words(text)
    hit, names = set(), set()
    for name, t in items:
        b = words(t)
        n = min(13, len(b))
        for i in range(len(b) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit |= set(range(j, j + n))
                    names.add(str(name))
    return len(w), len(hit), len(names), decontaminate.digest(sorted(names)), bool(hit) and 20 * len(hit) >= len(w)


def fixture():
    rng = random.Random(2)
    v = ["w%d" % i for i in range(12)] + ["é", "Über"]
    items = [(i, " ".join(rng.choice(v) for _ in range(n))) for i, n in enumerate((20, 13, 30, 3, 1, 12, 2))] + [(50, ""), (51, None), (52, "!!"), (53, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w0 w1 w2")]
    docs = [(None, None, "a"), (1, "", "a"), (2, "é", "b"), (2, "é", "b")]
    for i in range(60):
        t = [rng.choice(v) for _ in range(rng.randrange(200))]
        if i % 3 == 0:
            at = rng.randrange(len(t) + 1)
            t[at:at] = items[i % 3][1].upper().split()
        docs.append((10 + i, ", ".join(t), "s"))
    docs.append((99, "zz " * 60_000 + items[0][1], "s"))
    return docs, items


def test_matches_brute_force_in_any_blocks(spark):
    docs, items = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(d), *brute(t, items)) for d, t, _ in docs)
    for block in (2_000_000, 30):
        got = decontaminate.contamination(df, bench, block_words=block)
        assert got.columns[:3] == df.columns
        rows = sorted((str(r["doc_id"]), *list(r)[3:8]) for r in got.collect())
        assert rows == want
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert kept.count() == sum(not w[-1] for w in want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    one = decontaminate.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench).first()
    assert (one["n_words"], one["n_hit"], one["contaminated"]) == (2, 0, False)
