import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossaflow.llm import ppm


def contexts(train):
    counts = {}
    for t in train:
        s = [-1] * 5 + [*(t or "").encode(), 256]
        for i in range(5, len(s)):
            for k in range(6):
                counts.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    return counts


def brute_ppm(counts, text):
    """Method C with exclusion, context by context."""
    total = 0.0
    s = [-1] * 5 + [*(text or "").encode(), 256]
    for i in range(5, len(s)):
        out = set()
        for k in range(5, -1, -1):
            c = {a: n for a, n in counts.get(tuple(s[i - k : i]), {}).items() if a not in out}
            if not c:
                continue
            if s[i] in c:
                total += math.log10(c[s[i]] / (sum(c.values()) + len(c)))
                break
            total += math.log10(len(c) / (sum(c.values()) + len(c)))
            out |= set(c)
        else:
            total -= math.log10(255 - len(out))
    return total


def brute_base(train, text):
    lower = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for t in train for w in lower(t))
    n, v = sum(c.values()), len(c)
    words = lower(text)
    return len(words), sum(c[w] > 0 for w in words), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)


def rows():
    rng = random.Random(2)
    words = ["the", "The", "cat", "sät", "on", "mat", "zebra", "xylo", "猫"]
    docs = [(i, " ".join(rng.choice(words[: 4 + i % 6]) for _ in range(rng.randrange(30))), i % 3 != 0) for i in range(60)]
    docs += [(70, None, True), (71, "", True), (72, " \n", False), (73, docs[1][1], True), (1, docs[1][1], True), (None, "never qqq seen", False), (75, "the\n" * 30_000, True)]
    return docs


@pytest.mark.parametrize("cells", [40_000_000, 60_000])
def test_matches_brute_force(spark, cells, monkeypatch):
    docs = rows()
    monkeypatch.setattr(ppm.fit, "__defaults__", ("text", cells))
    df = spark.createDataFrame(docs, "doc_id long, text string, score boolean")
    got = ppm.score_corpus(df, F.col("score")).collect()
    train = [t for _, t, y in docs if y]
    want, counts = {}, contexts(train)
    for d, t, y in docs:
        n, known, total, base = brute_base(train, t)
        want.setdefault((d, y), []).append((n, known, total, base, brute_ppm(counts, t)))
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base, score = want[r["doc_id"], r["train"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r["score"], score, rel_tol=1e-5, abs_tol=1e-4)


@pytest.mark.parametrize("rate", [1e-6, 0.05, 2.0])
def test_rare_and_frequent_words_score_alike(spark, rate):
    """Whichever words the scan scores and whichever the shuffle, the sums are those of the brute force."""
    docs = rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, train boolean").repartition(3).withColumn("tk", F.xxhash64(F.coalesce("text", F.lit(""))))
    per, figures = ppm.word_scores(df, F.col("train"), rate=rate)
    got = {r["tk"]: r for r in per.collect()}
    train = [t for _, t, y in docs if y]
    assert figures["n_train"] == len(train)
    for r in df.collect():
        n, known, total, base = brute_base(train, r["text"])
        one = got[r["tk"]]
        assert (one["n_words"] + 1, one["known"] + 1, figures["tokens"]) == (n, known, total)
        mine = one["s"] + math.log10(len(train) + 0.5) - n * math.log10(total + 0.5 * (figures["distinct"] + 1))
        assert math.isclose(mine, base, rel_tol=1e-9, abs_tol=1e-9)


def test_score_column_beside_others(spark):
    df = spark.createDataFrame([(1, "ab", 5.0, 7), (2, None, 6.0, 7), (1, "ab", 5.0, 7)], "doc_id long, text string, ppm_log10 double, tk int")
    out = ppm.with_score(df, ppm.fit(df))
    assert out.columns == [*df.columns, "_ppm_log10"] and out.count() == 3
    assert {r["ppm_log10"] for r in out.collect()} == {5.0, 6.0} and {r["tk"] for r in out.collect()} == {7}


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.score_corpus(none, F.lit(True)).count() == 0
    one = ppm.score_corpus(spark.createDataFrame([(1, "ab c")], "doc_id long, text string"), F.lit(False)).first()
    assert (one["n_tokens"], one["n_known"], one["train_tokens"]) == (3, 0, 0)
    assert math.isclose(one["score"], -5 * math.log10(255), rel_tol=1e-5)


def test_keeps_all_contexts(spark):
    """No context is left out, however rare: one that occurs once among many symbols predicts as well."""
    rng = random.Random(4)
    filler = ["".join(rng.choice("abcd ") for _ in range(6000)) for _ in range(20)]
    docs = [(i, t, True) for i, t in enumerate(filler)] + [(90, "xyzzyx quux", True), (91, "xyzzyx quux", False), (92, "abc dcba xyzzy", False)]
    train, counts = [t for _, t, y in docs if y], {}
    for t in train:
        s = [-1] * 5 + [*t.encode(), 256]
        for i in range(5, len(s)):
            for k in range(6):
                counts.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    assert sum(len(t) + 1 for t in train) > 1e5  # a rate of 1e-5 would drop what occurs once
    got = {r["doc_id"]: r["score"] for r in ppm.score_corpus(spark.createDataFrame(docs, "doc_id long, text string, y boolean"), F.col("y")).collect()}
    for d in (90, 91, 92):
        assert math.isclose(got[d], brute_ppm(counts, docs[[x[0] for x in docs].index(d)][1]), rel_tol=1e-5, abs_tol=1e-4)
