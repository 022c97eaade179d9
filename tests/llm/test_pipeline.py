"""The pipeline over a small corpus against a plain version of each stage."""

import random
import re

import pytest

import corpus_pipeline as cp
from glossaflow.llm import simhash


def corpus():
    rng = random.Random(8)
    en, de = ["the", "river", "stone", "garden", "window", "letter", "morning", "and", "with"], ["der", "fluss", "stein", "garten", "fenster", "brief", "morgen", "und", "mit"]
    say = lambda ws, n: " ".join(rng.choice(ws) + str(rng.randrange(3) or "") for _ in range(n))
    rows = [(i, say(en if i % 3 else de, rng.randrange(60, 200)), "en" if i % 3 else "de", f"s{i % 4}") for i in range(120)]
    item = " ".join(f"bench{i}" for i in range(20))
    rows += [(200 + i, rows[i * 5][1] + (" tail" if i % 2 else ""), rows[i * 5][2], "copies") for i in range(12)]
    rows += [(300, say(en, 60) + " " + item, "en", "s1"), (301, say(en, 900) + " " + item, "en", "s1")]
    rows += [(400, "mail a.b@c.org or 1.2.3.4, " + say(en, 80), "en", "s2"), (401, "123 456", "en", "s2"), (402, None, "en", "s2"), (403, "", None, None), (404, "q" * 40, None, None)]
    rows += [(5, rows[5][1], rows[5][2], "copies"), (None, say(de, 90), "de", None), (None, say(de, 90), None, None), (7, say(en, 30_000), "en", "s3")]
    return [(d, t, lang, s, len(t) if t is not None else None, "extra", "x") for d, t, lang, s in rows], [(1, item), (2, "absent words here"), (3, None)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rows, bench = corpus()
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, taken string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, bench


def brute(rows, bench):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and r[0] != 404]
    fps = [simhash.fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for r, g in zip(rows, group):
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    kept = []
    for r in best.values():
        words, hit = re.findall(r"[0-9a-z]+", r[1].lower()), set()
        for _, t in bench:
            b = (t or "").split()
            n = min(13, len(b))
            for i in range(len(b) - n + 1) if n else ():
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == b[i : i + n]:
                        hit |= set(range(j, j + n))
        if not (hit and 20 * len(hit) >= len(words)):
            kept.append((r[0], r[1].replace("a.b@c.org", "[EMAIL]").replace("1.2.3.4", "[IP]"), r[3]))
    return sorted(kept, key=str)


def test_run(spark, data):
    folder, rows, bench = data
    out = cp.run(spark, folder)
    got = out.collect()
    kept = brute(rows, bench)
    assert {(r["doc_id"], r["text"], r["source"]) for r in got} <= set(kept)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "taken", "size", "source_size", "target", "_taken", "epoch"]
    assert all(r["n_chars"] == len(r["text"]) and 0 < r["_taken"] <= r["size"] == len(r["text"].split()) for r in got)
    # the mix: each source's words come to its target, from documents of which each stands once an epoch
    copies = {}
    for r in got:
        copies.setdefault((r["doc_id"], r["text"], r["source"]), []).append(r)
    for name in {k[2] for k in kept}:
        mine = [r for r in got if r["source"] == name]
        assert abs(sum(r["_taken"] for r in mine) - mine[0]["target"]) <= 2
        whole = mine[0]["target"] // mine[0]["source_size"]
        assert all(len(copies.get(k, [])) in (whole, whole + 1) for k in kept if k[2] == name)
    assert all(sorted(r["epoch"] for r in rs) == list(range(len(rs))) for rs in copies.values())


def test_stages_keep_columns_and_take_empty_tables(spark, data):
    folder, rows, _ = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
