import random
import zlib

from pyspark.sql import functions as F

from glossaflow.llm import langid

SETS = {"xx": ["bla", "tor", "ing", "wer"], "yy": ["ção", "nho", "lha", "uma"], "zz": ["дом", "кот", "мир", "лес"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SETS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    rows = [(i, text(rng, lang, rng.randrange(4, 60)), lang, "s") for i, lang in enumerate(rng.choice(list(SETS)) for _ in range(400))]
    return rows + [(900, None, "xx", "s"), (901, "", "yy", None), (902, "123 !?", "xx", "s"), (None, "bla", None, "s"), (3, rows[3][1], rows[3][2], "s"), (904, text(rng, "yy", 40_000), "yy", "s"), (905, "q", None, "s"), (907, "qwxkz jvbqx " * 30, None, "s")]


def test_held_out(spark):
    got = spark.range(200).select("id", langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_accuracy_and_cases(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    filters = langid.fit(df.filter(~langid.held_out(F.col("doc_id"))))
    assert filters.langs == ["xx", "yy", "zz"]
    out = langid.identify(df, filters)
    assert out.columns == [*df.columns, "_lang_pred", "lang_score", "lang_share", "lang_grams"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["lang_score"] <= 1
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["_lang_pred"], r["lang_score"]) == ("und", 0.0)
        elif r["lang"]:
            assert r["_lang_pred"] == r["lang"]
        else:
            assert r["_lang_pred"] in filters.langs
    kept = {r["doc_id"] for r in langid.keep_known(df, filters).collect()}
    assert not kept & {900, 901, 902, 907} and {0, 1, 2, 904, 905} <= kept


def grams(text):
    """3- and 4-grams with letters inside and a letter at one end at least; what is no letter is an edge."""
    c = ["" if not x.isalpha() else x for x in f" {text.lower()} "]
    out = []
    for n in (3, 4):
        for i in range(len(c) - n + 1):
            g = c[i : i + n]
            if all(g[1:-1]) and (g[0] or g[-1]):
                out.append(tuple(g))
    return out


def test_against_plain_sets(spark):
    """Exact sets in place of filters give the same languages, and nearly the same shares; equal shares go to the first language."""
    rng = random.Random(8)
    rows = corpus() + [(1000 + i, text(rng, "xx", k) + " " + text(rng, "yy", 9 - k) + rng.choice(["", "5a", "Ünïq"]), None, "s") for i, k in enumerate([*range(1, 9)] * 3)]
    rows += [(2000, "ii", None, "s"), (2001, "ab ab", None, "s"), (2002, "\n", None, "s")]
    train = [r for r in rows if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 5 and r[1] is not None and r[2] is not None]
    sets = {}
    for _, t, lang, _ in train:
        sets.setdefault(lang, set()).update(grams(t))
    langs, sizes = sorted(sets), {}
    for r in train:
        sizes[r[2]] = sizes.get(r[2], 0) + 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    filters = langid.fit(df.filter(~langid.held_out(F.col("doc_id"))))
    assert filters.usual == max(langs, key=sizes.get)
    for r in langid.identify(df, filters).collect():
        t = r["text"] or ""
        if not any(map(str.isalpha, t)):
            assert r["lang_pred"] == "und"
            continue
        g = grams(t)
        share = {k: sum(x in sets[k] for x in g) / max(len(g), 1) for k in langs}
        best = max(langs, key=share.get)
        assert r["lang_grams"] == len(g)
        if sorted(share.values())[-1] - sorted(share.values())[-2] > 0.08:
            assert r["lang_pred"] == best, t[:80]
        assert abs(r["lang_share"] - max(share.values())) < 0.08
        if not max(share.values()) and r["lang_share"] == 0:
            assert r["lang_pred"] == filters.usual


def test_ties_and_names(spark):
    df = spark.createDataFrame([(1, "abab", "q"), (1, "abab", "p"), (2, "abab", "q"), (3, "abab", "p")], "doc_id long, text string, lang string")
    filters = langid.fit(df)
    out = langid.identify(df.withColumns({"lang_state": F.lit(1), "lang_score": F.lit(2)}), filters)
    assert {(r["lang_pred"], r["_lang_score"], r["lang_state"], r["lang_score"]) for r in out.collect()} == {("p", 0.5, 1, 2)}


def test_few_grams_widen_the_interval(spark):
    df = spark.createDataFrame([(i, "zzq" * i) for i in range(1, 30)], "doc_id long, text string")
    filters = langid.fit(spark.createDataFrame([("bla bla", "xx"), ("other words", "yy")], "text string, lang string"))
    kept = [r["doc_id"] for r in langid.keep_known(df, filters).collect()]
    assert sorted(kept) == list(range(1, max(kept) + 1)) and 1 <= max(kept) < 15


def test_false_positives_are_corrected():
    import numpy as np

    rng = np.random.default_rng(1)
    grams = {k: rng.integers(0, 2**63, 3000).astype(np.uint64) for k in ("a", "b")}
    f = langid.Filters.build(grams, 12)
    other = f.masks(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    for i, wrong in enumerate(f.wrong):
        assert wrong > 0.2  # so full a filter says yes often
        assert abs((other[:, 0] >> i & 1).mean() - wrong) < 0.03
        assert (f.masks(grams["ab"[i]])[:, 0] >> i & 1).all()


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    filters = langid.fit(none)
    assert langid.identify(none, filters).count() == 0
    one = langid.identify(spark.createDataFrame([("abc",)], "text string"), filters).first()
    assert (one["lang_pred"], one["lang_score"]) == ("und", 0.0)
