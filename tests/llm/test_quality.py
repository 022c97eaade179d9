import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from glossaflow.llm import quality


def corpus():
    rng = random.Random(4)
    ws = ["river", "stone", "garden", "window", "letter", "morning", "quiet", "paper", "road", "winter"]
    say = lambda n: " ".join(rng.choice(ws) + rng.choice(["s", "", "er", "ing"]) + str(rng.randrange(9)) + ("." if i % 9 == 8 else "") for i in range(n)).capitalize()
    rows = []
    for i in range(400):
        t, kind = say(rng.randrange(40, 150)), "good"
        if i % 8 == 0:
            t, kind = " | ".join(t.split()), "bad"
        elif i % 8 == 1:
            t, kind = " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in t.split()), "bad"
        elif i % 8 == 2:
            t, kind = (" ".join(t.upper().split()[:6]) + "!! ") * 20, "bad"
        elif i % 8 == 3:
            w = t.split()
            for x in rng.sample(["idiot", "Moron,", "pathetic", "TRASH!", "loser"], rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), x)
            t, kind = " ".join(w), "toxic"
        rows.append((i, t, kind))
    return rows


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.9, 0.8, 0.7, 0.95])
    v = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]) + 1
    v[rng.random(v.shape) < 0.2] = 0
    codes, n = np.unique([quality.code([x - 1 for x in row]) for row in v.tolist()], return_counts=True)
    m = quality.Votes.fit(codes, n.astype(float), 4)
    assert abs(m.prior - 0.3) < 0.03 and np.abs(m.accuracies() - right).max() < 0.03


def test_scores(spark):
    rows = corpus() + [(900, None, "bad"), (901, "", "bad"), (902, " \n", "bad"), (5, "x", "any"), (5, "x", "any"), (903, corpus()[4][1] * 400, "any")]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic string").repartition(3)
    labelled = spark.createDataFrame([(t, int(k == "toxic")) for _, t, k in rows], "text string, toxic int")
    model = quality.fit(df, labelled)
    assert b"pathetic" in model.lexicons.first | model.lexicons.second
    out = quality.classify(df, model)
    assert out.columns == [*df.columns, "quality", "_toxic", "keep"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["quality"] <= 1 and 0 <= r["_toxic"] <= 1 for r in got)
    share = lambda kind, ok: sum(map(ok, (x := [r for r in got if r["toxic"] == kind]))) / len(x)
    assert share("good", lambda r: r["keep"]) >= 0.98
    assert share("bad", lambda r: r["quality"] < 0.5) >= 0.98
    assert share("toxic", lambda r: r["_toxic"] >= 0.5) >= 0.98
    again = quality.classify(df.repartition(2), quality.fit(df.repartition(2), labelled)).collect()
    key = lambda rows: sorted((str(r["doc_id"]), str(r["text"]), round(r["quality"], 6), round(r["_toxic"], 6)) for r in rows)
    assert key(again) == key(got)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.classify(none, quality.fit(none)).count() == 0


def plain_em(rows, n, any_positive, rounds=60):
    """Expectation-maximisation over single rows of votes (0 none, 1 no, 2 yes), without patterns or arrays."""
    def begin(v):
        if any_positive:
            return 0.95 if 2 in v else 0.02
        cast = [x for x in v if x]
        return (cast.count(2) + 0.5) / (len(cast) + 1) if cast else 0.5

    p = [begin(v) for v in rows]
    for _ in range(rounds):
        table = [[[1.0] * 3 for _ in range(2)] for _ in range(n)]
        for v, x in zip(rows, p):
            for j in range(n):
                table[j][0][v[j]] += 1 - x
                table[j][1][v[j]] += x
        table = [[[t / sum(c) for t in c] for c in lab] for lab in table]
        prior = min(max(sum(p) / len(p), 1e-4), 1 - 1e-4)
        p = []
        for v in rows:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[j][1][v[j]] / table[j][0][v[j]]) for j in range(n))
            p.append(1 / (1 + math.exp(-max(-40, min(40, odds)))))
    return p


def test_votes_match_a_plain_em():
    rng = random.Random(5)
    for any_positive in (False, True):
        rows = [[rng.choice([0, 1, 2, 2 if i % 3 else 1]) for _ in range(4)] for i in range(150)]
        codes, n = np.unique([quality.code([x - 1 for x in v]) for v in rows], return_counts=True)
        m = quality.Votes.fit(codes, n.astype(float), 4, any_positive=any_positive)
        got = dict(zip(codes.tolist(), m.posterior(codes)))
        want = plain_em(rows, 4, any_positive)
        assert all(abs(got[quality.code([x - 1 for x in v])] - w) < 1e-6 for v, w in zip(rows, want))


def test_scores_match_a_plain_scorer(spark):
    """Each text's scores are the logistic of the weights of its votes and words, added up one by one."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(3)
    labelled = spark.createDataFrame([(t, int(k == "toxic")) for _, t, k in rows], "text string, toxic int")
    m = quality.fit(df, labelled)
    texts = {d: t for d, t, _ in rows}
    for r in quality.classify(df, m).collect()[::7]:
        good, bad, words = quality.judge(texts[r["doc_id"]], m.lexicons)
        for k, name in ((0, "quality"), (1, "toxic")):
            total = float(m.linear.bias[k]) + sum(float(m.linear.weights[k][3 * j + v + 1]) for j, v in enumerate([*good, *bad]))
            first = 3 * (len(good) + len(bad))
            total += sum(float(m.linear.weights[k][first + zlib.crc32(w) % (quality.HASHED - first)]) for w in words) / max(1, len(words)) ** 0.5
            assert abs(r[name] - 1 / (1 + math.exp(-max(-30, min(30, total))))) < 1e-4
        assert r["keep"] == (r["quality"] >= 0.5 and r["toxic"] < 0.5)


def test_copies_and_repeated_labels(spark):
    """A text with very many copies reaches the driver once, an id labelled twice is drawn once, and names of helpers may clash."""
    rows = corpus()[:80]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("quality_state", F.lit(1))
    copies = docs.filter("doc_id = 4").crossJoin(spark.range(20_000)).select("doc_id", "text", "key", "quality_state")
    many = docs.unionByName(copies)
    assert many.count() == 20_080
    labels = spark.createDataFrame([(i % 80, int(rows[i % 80][2] == "toxic"), 1) for i in range(400)], "doc_id long, toxic int, v int")
    some = quality.labelled_sample(docs, labels)
    assert some.count() == 80
    out = quality.classify(docs, quality.fit(many, some))
    assert out.columns == [*docs.columns, "quality", "toxic", "keep"] and {r["quality_state"] for r in out.collect()} == {1}
