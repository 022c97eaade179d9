import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from glossaflow.llm import queries, tokenalign

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def worker():
    return tokenalign.Aligner(*((Path(tokenalign.TOKENIZERS) / f).read_bytes() for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")))


def plain(worker, text):
    """(n_a, n_b, n_groups, n_links), digest and links by the byte offsets of whole texts."""
    none = (0, 0, 0, 0), "", []
    if not text:
        return none
    raw = (" " + text).encode()
    a = worker.a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = worker.b.model.encode(text)
    if b"".join(worker.a.bytes[i] for i in a) != raw or b"".join(worker.b.bytes[i] for i in b) != raw:
        return none
    ends = [np.cumsum([len(side.bytes[i]) for i in ids]).tolist() for side, ids in ((worker.a, a), (worker.b, b))]
    groups, links, at = [], [], [0, 0]
    for e in sorted(set(ends[0]) & set(ends[1])):
        to = [x.index(e, k) + 1 for x, k in zip(ends, at)]
        groups.append("|".join(",".join(map(str, ids[k:t])) for ids, k, t in zip((a, b), at, to)))
        for x in range(at[0], to[0]):
            for y in range(at[1], to[1]):
                if max(ends[0][x - 1] if x else 0, ends[1][y - 1] if y else 0) < min(ends[0][x], ends[1][y]):
                    links.append((a[x], b[y]))
        at = to
    return (len(a), len(b), len(groups), len(links)), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def one(worker, text, chars=50):
    ((shape, digest, ids, times),) = tokenalign.aligned(worker, [text], chars)
    return shape, digest, sorted((int(p) >> 15, int(p) & (1 << 15) - 1) for p in np.repeat(ids, times))


ODD = ["a", "b", " ", "  ", "\n", "\t", "é", "日本", "▁", "\x00", " ", "　", "😀", "́", "Don't", "'s", "12", ".", "</s>", "<|endoftext|>", "​", "the", "ing", "\x1c", "\x85", "﻿", "<0x41>", "ﬁ"]


def test_odd_texts(worker):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(0, 14)))
        shape, digest, links = plain(worker, text)
        assert one(worker, text) == (shape, digest, sorted(links)), text


def test_fast_and_plain_encoders_agree(worker):
    assert worker.a.fast is not None
    rng = random.Random(2)
    for _ in range(2000):
        text = " " + "".join(rng.choice(ODD) for _ in range(rng.randrange(0, 20)))
        assert worker.a.fast.encode_ordinary(text) == worker.a.tokenizer.encode(text, add_special_tokens=False).ids


def test_long_texts(worker):
    for text in (" " * 300_000, "a" * 100_000, "日本" * 50_000, "a b " * 100_000, "word\n" * 60_000, "x" + "\n" * 40_000 + " y"):
        assert one(worker, text, 1 << 20)[:2] == plain_fast(worker, text)


def plain_fast(worker, text):
    a, b = worker.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, worker.b.model.encode(text)
    ends = [np.cumsum([len(side.bytes[i]) for i in ids]) for side, ids in ((worker.a, a), (worker.b, b))]
    both = np.intersect1d(*ends)
    cut = [np.searchsorted(e, both) + 1 for e in ends]
    names = [list(map(str, ids)) for ids in (a, b)]
    groups, at = [], (0, 0)
    for x, y in zip(cut[0].tolist(), cut[1].tolist()):
        groups.append(",".join(names[0][at[0] : x]) + "|" + ",".join(names[1][at[1] : y]))
        at = x, y
    return (len(a), len(b), len(both), len(a) + len(b) - len(both)), hashlib.sha256(";".join(groups).encode()).hexdigest()


def test_transducer_finds_differences():
    t = tokenalign.Transducer([b"ab", b"c", b"a"], [b"a", b"bc", b"x"])
    assert t.run([0, 1], [0, 1]) is not None and t.run([0, 1], [0, 1])[-1] == 0
    assert t.run([0], [2]) is None and t.run([0], [0]) is None and t.run([2], [0, 0]) is None
    assert t.run([], []) == []


def want(worker, rows):
    done = [(i, *plain(worker, t)) for i, t in rows]
    count = Counter(p for _, _, _, links in done for p in set(links))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    return sorted(((i, *shape, sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest) for i, shape, digest, links in done), key=repr)


@pytest.mark.parametrize("share", [1_000_000, 50, 1])
def test_query_against_plain(spark, worker, share):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()][:80]
    rows += [(None, None), (1, None), (2, ""), (3, " "), (4, "x▁y"), (5, "the end\n"), (5, "the end\n"), (6, "\n\n the  end ")] + [(7, "the same words")] * 30
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_a long, pairs long").repartition(3)
    got = tokenalign.align(df, share=share)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want(worker, rows)


def test_whole_query(spark, worker):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert sorted((tuple(r) for r in queries.op13_tokenalign(spark, SF).collect()), key=repr) == want(worker, rows)


def test_empty(spark):
    assert tokenalign.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
