import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaflow.llm import linededup


def brute(docs, keys, least_run=20):
    """docs: (doc_id, text); keys: text to hash. Removed parts of all digests at once, without tasks or batches."""
    texts = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, keys[d[1]]))
    first, rows = {}, []
    for rank, (d, t) in enumerate(texts):
        for h, start, end, words, no in sorted(linededup.spans(t or ""), key=lambda x: x[4]):
            first.setdefault(h, (rank, no))
            rows.append((h, rank, no, start, end, words))
    own = {}
    for h, rank, no, *_ in rows:
        own.setdefault((h, rank), no)
    out = set()
    for rank, (d, t) in enumerate(texts):
        gone = {True: [], False: []}
        for h, r, no, start, end, words in rows:
            # one that reaches into its text's first of that digest goes only if that one goes
            if r == rank and first[h] != (r, no) and not (first[h][0] == r and no - abs(words) < first[h][1]):
                gone[words < 0].append((no - abs(words), no, start, end))
        for x in joined(joined(gone[True]) + [x for x in joined(gone[False]) if x[1] - x[0] >= least_run]):
            out.add((d, t, x[2], x[3], x[1] - x[0]))
    return out


def joined(parts):
    out = []
    for begin, no, start, end in sorted(parts):
        if out and begin <= out[-1][1]:
            b, n, s, e = out[-1]
            out[-1] = (b, max(n, no), min(s, start), max(e, end))
        else:
            out.append((begin, no, start, end))
    return out


def test_spans():
    text = "a b c d e f. g h\n\n" + "x " * 30 + "end"
    found = list(linededup.spans(text))
    assert all(len(text[a:b].split()) == abs(n) for _, a, b, n, _ in found)
    lines = [x for x in found if x[3] < 0]
    assert [(a, b, n) for _, a, b, n, _ in lines] == [(0, 16, -8), (18, 81, -31)]
    assert list(linededup.spans("")) == [] == list(linededup.spans(" \n\t"))
    assert lines[0][0] == next(x[0] for x in linededup.spans("A  B c D e\tf. G H") if x[3] < 0)


def corpus():
    rng = random.Random(6)
    say = lambda n: " ".join("w%d" % rng.randrange(5000) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    shared = [say(55) for _ in range(4)]
    docs = []
    for i in range(60):
        lines = [say(rng.randrange(1, 60)) for _ in range(rng.randrange(1, 5))]
        if i % 4 == 0:
            w = lines[0].split()
            at = rng.randrange(len(w) + 1)
            lines[0] = " ".join([*w[:at], shared[i // 4 % 4], *w[at:]])
        if i % 3 == 0:
            lines.append("All rights reserved by the authors of it.")
        if i in (5, 7, 9):
            lines.append(say(50))
        docs.append((i, "\n".join(lines)))
    docs += [(70, docs[5][1]), (5, docs[5][1]), (None, docs[7][1]), (71, None), (72, ""), (73, docs[9][1].upper()), (74, "é " * 5_000), (75, "é " * 700), (76, "é è ê " * 50), (77, "é è ê " * 50)]
    return docs, [i for i in range(16, 60) if i % 4 == 0]


@pytest.mark.parametrize("parts, batch", [(1, 512), (5, 512), (3, 2)])
def test_against_brute_force(spark, parts, batch):
    """Whatever the tasks and batches: periodic texts, repeated rows, a line in every text, copies in one task and in several."""
    docs, planted = corpus()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    df = spark.createDataFrame([(d, t, "r", 1, 2, 3, 4, 5) for d, t in docs], "doc_id long, text string, removed string, tk int, spans int, span_id int, span_tk int, kind int").repartition(parts)
    keys = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    by = {h: t for t, h in keys.items()}
    rows = [(r["doc_id"], by[r["tk"]], r["start"], r["end"], r["words"]) for r in linededup.passages(df).collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, keys)
    hit = {d for d, *_ in rows}
    assert set(planted) <= hit and {70, 73, None} <= hit and not hit & {71, 72}
    if parts == 5:
        out = linededup.remove(df)
        assert out.columns == [*df.columns, "_removed"]
        cut = {}
        for d, t, a, b, _ in rows:
            cut.setdefault((d, t), []).append((a, b))
        left = []
        for d, t in docs:
            at, want = 0, ""
            for a, b in sorted(cut.get((d, t), [])):
                want, at = want + t[at:a], b
            left.append((d, want + t[at:] if t is not None else None))
        assert sorted(left, key=repr) == sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.passages(none).count() == 0 and linededup.remove(none).count() == 0


def test_a_common_line_gives_few_rows_a_task():
    """Of what stands in every text, a task sends few rows to the digest's group."""
    docs = [(False, i, i * 7) for i in range(100)]
    row = [5, 0, 9, -2, 1]
    made = np.array([row] * 100, np.int64)
    task = linededup._Task()
    kinds = task.kinds(np.arange(100), made, docs)
    assert (kinds == linededup._LEAST).sum() == 1 and kinds[0] == linededup._LEAST
    assert (task.kinds(np.arange(100), made, [(False, i + 100, 1) for i in range(100)]) == linededup._FIRST).all()
    assert (task.kinds(np.arange(100), made, [(False, i - 100, 1) for i in range(100)]) == linededup._LEAST).sum() == 1
    assert (task.kinds(np.arange(100), made, [(False, -100, 1)] * 100) == -1).all()


@pytest.mark.parametrize("every", [2, 50, 200, 400, 5000])
def test_rows_of_a_digest_that_its_group_gets(every):
    """A line in every so many rows, among lines of each row's own: a task sends it a few times, not once a batch."""
    rng = np.random.default_rng(every)
    task, sent, rows, batches = linededup._Task(), 0, 512, 60
    for b in range(batches):
        at = np.arange(rows) + b * rows
        own = rng.integers(1, 1 << 62, (rows, 20))
        own[at % every == 0, 0] = 5
        made = np.zeros((rows * 20, 5), np.int64)
        made[:, 0], made[:, 2], made[:, 3], made[:, 4] = own.ravel(), 9, -1, np.tile(np.arange(20), rows)
        kinds = task.kinds(np.repeat(np.arange(rows), 20), made, [(False, int(i), int(i)) for i in at])
        sent += int(((made[:, 0] == 5) & (kinds == linededup._LEAST)).sum())
    assert 1 <= sent <= 5


def test_a_task_remembers_a_bounded_number():
    task = linededup._Task(slots=1 << 10, held=64)
    for b in range(50):
        digests = np.concatenate([np.full(30, 7), np.repeat(np.arange(1000 + 100 * b, 1100 + 100 * b), 2)])
        made = np.zeros((len(digests), 5), np.int64)
        made[:, 0], made[:, 4] = digests, np.arange(len(digests))
        kinds = task.kinds(np.arange(len(digests)), made, [(False, b * 1000 + i, 1) for i in range(len(digests))])
        assert len(task.least) <= 64 and 7 in task.least
        assert b == 0 or not (kinds[:30] == linededup._LEAST).any()


def test_keepers(spark):
    line = "a line that stands in all of them"
    df = spark.createDataFrame([(i, f"{line}\nown {i}", "x") for i in (3, 1, 2)] + [(None, line, "x"), (4, None, "x")], "doc_id long, text string, digest string").repartition(2)
    rows = [(r["doc_id"], r["words"], r["n"]) for r in linededup.keepers(df).collect()]
    assert rows == [(1, -8, 4)]
    assert linededup.keepers(df.limit(0)).count() == 0


def windows_seen_before(docs, size=6):
    """Of each document, by doc_id, the words that stand in a window of size words which an earlier document or place has."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        words = t.lower().split()
        out[d] = set()
        for i in range(len(words) - size + 1):
            w = tuple(words[i : i + size])
            if w in seen:
                out[d] |= set(range(i, i + size))
            seen.add(w)
    return out


def test_passages_whatever_the_lines(spark):
    """Copies of passages of over 50 words, set in lines of other lengths: all but few words at the ends go, and nothing else."""
    rng = random.Random(3)
    say = lambda n: ["w%d" % rng.randrange(50_000) for _ in range(n)]

    def lines(words, least, most):
        out = []
        while words:
            n = rng.randrange(least, most + 1)
            out.append(" ".join(words[:n]))
            words = words[n:]
        return "\n".join(out)

    docs, planted = [], {}
    for i in range(40):
        passage = say(rng.randrange(51, 120))
        a, b = say(rng.randrange(5, 90)), say(rng.randrange(5, 90))
        docs.append((2 * i, lines([*a, *passage, *b], 8, 12)))
        a = say(rng.randrange(5, 90))
        docs.append((2 * i + 1, lines([*a, *passage, *say(30)], *[(1, 5), (8, 12), (200, 300)][i % 3])))
        planted[2 * i + 1] = range(len(a), len(a) + len(passage))
    docs += [(100, docs[0][1]), (101, lines(docs[2][1].split(), 2, 4)), (102, "é " * 3000), (103, "a\nb\nc")]
    brute = windows_seen_before(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    gone = {d: set() for d, _ in docs}
    texts = dict(docs)
    for r in linededup.passages(df).collect():
        before = len(texts[r["doc_id"]][: r["start"]].split())
        assert len(texts[r["doc_id"]][r["start"] : r["end"]].split()) == r["words"] >= 20
        gone[r["doc_id"]] |= set(range(before, before + r["words"]))
    lost = []
    for d, want in planted.items():
        assert gone[d] <= set(want) and gone[d] <= brute[d], d
        assert gone[d] == set(range(min(gone[d]), max(gone[d]) + 1))
        lost += [min(gone[d]) - want[0], want[-1] - max(gone[d])]
    assert max(lost) <= 24 and sum(lost) / len(lost) < 8, lost
    assert not any(gone[2 * i] for i in range(40)) and not gone[103]
    for d in (100, 101):  # whole copies go whole, however they are set
        assert gone[d] == brute[d] == set(range(len(texts[d].split())))
    assert set(range(6, 2980)) <= gone[102] <= set(range(6, 3000))
    kept = {r["doc_id"]: r["text"] for r in linededup.remove(df).collect()}
    assert kept[101] == "" and 6 <= len(kept[102].split()) <= 26


def test_whole_lines_of_any_length(spark):
    docs = [
        (1, "a line of its own here\nAll rights reserved by the authors of it.\n---\nShort one\nonly once"),
        (2, "Another text\n  all rights  reserved by the authors of it.\n---\nmore, and Short one\nshort one"),
        (3, "x\nShort one\nAll rights reserved by the authors of it.\nx\nShort one more"),
        (None, "x"),
        (4, None),
        (5, ""),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    left = {r["doc_id"]: r["text"].split("\n") if r["text"] else r["text"] for r in linededup.remove(df).collect()}
    assert left[1] == docs[0][1].split("\n")
    assert [x.strip() for x in left[2]] == ["Another text", "", "---", "more, and Short one", ""]
    # lines 2 and 3 of doc 3 touch: they go as one part, with the line end between them
    assert [x for x in left[3] if x] == ["x", "Short one more"]
    assert left[None] == "" and left[4] is None and left[5] == ""
    rows = {(r["doc_id"], r["words"]) for r in linededup.passages(df, least_run=None).collect()}
    assert rows == {(2, 8), (2, 2), (3, 11), (None, 1)}
