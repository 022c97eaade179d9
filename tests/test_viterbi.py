import itertools
import random

from pyspark.sql import functions as F

from glossaflow import schema
from glossaflow.operators import progress, viterbi

NAMES = [x[1] for x in schema.LABELS]


def plain(scores, steps, first, last):
    best = None
    for path in itertools.product(range(len(steps)), repeat=len(scores)):
        total = sum(s[j] for s, j in zip(scores, path)) + sum(steps[a][b] for a, b in zip(path, path[1:])) + first[path[0]] + last[path[-1]]
        if best is None or total > best[0] or (total == best[0] and path[::-1] < best[1][::-1]):
            best = total, path
    return list(best[1])


def test_best_path_against_all_paths(spark):
    rng = random.Random(8)
    steps = [[rng.randrange(-3, 3) / 2 for _ in range(3)] for _ in range(3)]
    first, last = [0.5, 0.0, -1.0], [0.0, 1.0, 0.5]
    rows = [(i, [[float(rng.randrange(-2, 3)) for _ in range(3)] for _ in range(rng.randrange(1, 6))]) for i in range(200)]
    df = spark.createDataFrame([*rows, (1000, []), (1001, None)], "i int, s array<array<double>>")
    got = {r["i"]: r["p"] for r in df.select("i", viterbi.best_path(F.col("s"), steps, first, last).alias("p")).collect()}
    assert got.pop(1000) == [] and got.pop(1001) is None
    for i, s in rows:
        assert got[i] == plain(s, steps, first, last), s


def test_no_violation_under_the_scheme(spark):
    rng = random.Random(9)
    rows = [(i, [[rng.random() for _ in NAMES] for _ in range(20)], [1] * n + [0] * (20 - n)) for i, n in enumerate([0, 1, 7, 20] * 20)]
    df = spark.createDataFrame(rows, "i int, logits array<array<float>>, attention_mask array<int>")
    for r in viterbi.PathTagger()(df).collect():
        n = sum(r["attention_mask"])
        names = [NAMES[k] for k in r["label_ids"][:n]]
        assert len(r["label_ids"]) == 20 and not any(r["label_ids"][n:])
        for before, label in zip(["O", *names], names):
            assert not label.startswith("I-") or before[2:] == label[2:]


def test_progress(spark):
    df = spark.range(1000, numPartitions=5)
    follow = progress.Progress(df, 1000)
    follow.rows.filter("id % 2 = 0").write.format("noop").mode("overwrite").save()
    told = follow.report()
    assert (told.processed, told.total, told.percent) == (1000, 1000, 100.0)
    ran = follow.running()
    assert ran.processed == ran.total >= 5
    assert progress.Report(0, 0).percent == 100.0 and progress.Report(1, 4).percent == 25.0
