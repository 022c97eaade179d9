import random
import time

import pytest
from pyspark.sql import functions as F

from glossaflow import schema
from glossaflow.functions import text as T
from glossaflow.operators import analysis, annotate, labels, metrics, search, stats, taggers, tokens
from glossaflow.plans import queries

ENT = "doc int, sent_no int, ent_no int, text string, type_ru string, base string, sentence string"
S, P, A = "подлежащее", "сказуемое", "дополнение"


def ents(spark, rows):
    return spark.createDataFrame([(1, n, i, t, k, "X", s) for i, (n, t, k, s) in enumerate(rows)], ENT)


def brute_phrases(words, chars):
    """words: (text, label, start, end); phrase by phrase."""
    out = []
    for text, label, a, b in words:
        base = label.split("-", 1)[-1] if label[:2] in ("B-", "I-") else label
        last = out[-1] if out else None
        if last and label.startswith("I-") and base == last["base"] and 0 <= a - last["end"] <= 2:
            last["text"] += " " + text
            last["end"] = b
        else:
            out.append({"text": text, "type": label, "base": base, "end": b})
    return [(x["text"], x["type"]) for x in out if not chars or x["base"] != "O"]


@pytest.mark.parametrize("chars", [False, True])
def test_phrases_against_a_loop(spark, chars):
    rng = random.Random(3)
    names = [x[1] for x in schema.LABELS[:5]]
    rows, want = [], {}
    for s in range(300):
        at, words = 0, []
        for i in range(rng.randrange(9)):
            at += rng.randrange(5)
            n = rng.randrange(1, 4)
            words.append(("w" * n, rng.choice(names), at, at + n))
            at += n
        want[s] = brute_phrases(words, chars)
        rows += [(1, s, i, w, l, l.split("-")[-1], a, b, a, b, "t") for i, (w, l, a, b) in enumerate(words)]
    df = spark.createDataFrame(rows, "doc int, sent_no int, unit_no int, unit string, label string, base string, start_b long, end_b long, start_c long, end_c long, sentence string")
    got = {}
    for r in annotate.entities(df, ["doc"], chars).orderBy("sent_no", "ent_no").collect():
        got.setdefault(r["sent_no"], []).append((r["text"], r["type"]))
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("chars", [False, True])
def test_phrases_in_the_row(spark, chars):
    """The same phrases as by rows, without an exchange by key."""
    rng = random.Random(9)
    texts = ["".join(rng.choice(["аб", "word", "x", " ", " ", ",", "—", " - ", "é"]) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", ", ."]
    sents = annotate.sentences(spark.createDataFrame(list(enumerate(texts)), "doc int, text string"), ["doc"])
    drop = T.PHRASE_PUNCTUATION if chars else T.PUNCTUATION
    names = ["doc", "sent_no", "ent_no", "text", "type", "base", "type_ru", "start_b", "end_b", "start_c", "end_c"]
    by_rows = annotate.entities(taggers.RuleTagger(3)(annotate.units(sents)).filter(~F.col("unit").isin(*drop)), ["doc"], chars)
    in_row = annotate.phrases(sents, taggers.RuleTagger(3).in_row, lambda u: ~u.isin(*drop), chars)
    assert set(in_row.columns) == set(names)
    rows = [sorted(tuple(r) for r in df.select(*names).collect()) for df in (by_rows, in_row)]
    assert rows[0] == rows[1] and len(rows[0]) > 300
    plan = in_row._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_gap_unit_differs(spark):
    # a gap of 4 bytes and 2 characters: only the count of characters lets the phrase go on
    rows = [(1, 1, 0, "а", "B-SUBJECT", "SUBJECT", 0, 2, 0, 1, "а —б"), (1, 1, 2, "б", "I-SUBJECT", "SUBJECT", 6, 8, 3, 4, "а —б")]
    df = spark.createDataFrame(rows, "doc int, sent_no int, unit_no int, unit string, label string, base string, start_b long, end_b long, start_c long, end_c long, sentence string")
    assert annotate.entities(df, ["doc"]).count() == 2
    assert annotate.entities(df, ["doc"], chars=True).count() == 1


def test_stats(spark):
    none = ents(spark, [])
    sents = spark.createDataFrame([(1, 1, "Мама мыла раму"), (1, 2, "Кот спит")], "doc int, sent_no int, sentence string")
    row = stats.global_stats(sents, none).first()
    assert (row["sentences_total"], row["words_total"], row["members_total"]) == (2, 5, 0)
    assert all((r["top_word"], r["top_count"]) == ("-", 0) for r in stats.top_member(none).collect())
    assert all(r["share"] == 0 for r in stats.shares(stats.category_totals(none)).collect())
    many = ents(spark, [(i, "Кот" if i < 3 else "Собака", S, "s") for i in range(4)] + [(1, "спит", P, "s"), (2, "", P, "s"), (3, "что", "?", "s")])
    tops = {r["type_ru"]: (r["top_word"], r["top_count"]) for r in stats.top_member(many).collect()}
    assert tops[S] == ("кот", 3) and tops[P] == ("-", 0)
    assert {r["type_ru"]: r["n"] for r in stats.sentence_parts(many).collect()}["другое"] == 1
    assert stats.global_stats(sents, many).first()["members_total"] == 6
    tie = ents(spark, [(1, w, S, "s") for w in ("б", "б", "А", "а")])
    assert {r["type_ru"]: r["top_word"] for r in stats.top_member(tie).collect()}[S] == "а"


def test_search_items(spark):
    df = ents(spark, [(1, "КОТ", S, "a"), (1, "Кот", S, "a"), (2, "кот", S, "b"), (2, "кот", A, "b")])
    got = {(r["type_ru"], r["text"]): (r["amount"], [s["sent_no"] for s in r["sentences"]]) for r in stats.search_items(df, ["doc"]).collect()}
    assert got == {(S, "кот"): (3, [1, 2]), (A, "кот"): (1, [2])}
    assert {(r["type_ru"], r["amount"], r["n_sentences"]) for r in stats.item_counts(df, ["doc"]).collect()} == {(S, 3, 2), (A, 1, 1)}


def page(spark):
    rows = [(0, "книга", S, 5), (1, "читаю", P, 2), (2, "интересную", "определение", 2), (3, "быстро", "обстоятельство", 1), (4, "книгами", A, 9)]
    return spark.createDataFrame(rows, "original_order int, text string, type_ru string, amount int")


def ranks(df):
    return [r["text"] for r in df.orderBy("rank").collect()]


def test_prefix_search(spark):
    p = page(spark)
    assert ranks(search.prefix_search(p, " КНИГ ")) == ["книга", "книгами"]
    assert ranks(search.prefix_search(p, "книга", order="frequency_desc")) == ["книгами", "книга"]
    assert ranks(search.prefix_search(p, "книга", order="alphabet_desc")) == ["книга", "книгами"]
    assert ranks(search.prefix_search(p, "", [P], "frequency_asc")) == ["читаю"]
    assert ranks(search.prefix_search(p, "", ())) == []
    assert ranks(search.prefix_search(p, order="frequency_asc"))[0] == "быстро"


def test_relevance(spark):
    p = page(spark)
    kinds = lambda *a: {r["text"]: r["match_type"] for r in search.relevance(p, *a).collect()}
    assert kinds("КНИГА")["книга"] == "exact" and kinds("КНИГА")["книгами"] == "partial"
    assert kinds("чит")["читаю"] == "partial" and set(kinds("zzz").values()) == {"none"}
    assert kinds("", P) == {"книга": "none", "читаю": "typeOnly", "интересную": "none", "быстро": "none", "книгами": "none"}
    assert ranks(search.relevance(p, "книгами"))[0] == "книгами"
    assert ranks(search.relevance(p, "у"))[0] == "интересную"
    assert ranks(search.reset(p)) == ["книга", "читаю", "интересную", "быстро", "книгами"]
    say = lambda n, t="": search.hit_message(search.hit_stats(search.relevance(p, n, t)), n, t).first()["message"]
    assert say("книга") == "✅ Найдено: 1 точных совпадений, 1 частичных совпадений"
    assert say("zzz") == "❌ Ничего не найдено" and say("") == "" and say("", P) == "✅ Найдено: 1 по типу"


VOCAB = [("[PAD]", 0), ("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3), ("при", 4), ("##вет", 5), (",", 6), ("мир", 7), ("как", 8), ("дела", 9), ("?", 10), ("!", 11)]


def encoded(spark, text):
    vocab = spark.createDataFrame(VOCAB, "token string, id long")
    sents = spark.createDataFrame([(1, 1, text)], "doc int, sent_no int, sentence string")
    subs = tokens.subtokens(annotate.units(sents), vocab, ["doc"])
    return subs, tokens.encode(subs, ["doc"])


def test_encode(spark):
    subs, enc = encoded(spark, "Привет, мир! Как дела?")
    rows = subs.orderBy("unit_no", "piece_no").collect()
    assert [r["token"] for r in rows] == ["при", "##вет", ",", "мир", "!", "как", "дела", "?"]
    assert [(r["start_b"], r["end_b"]) for r in rows][:4] == [(0, 6), (6, 12), (12, 13), (14, 20)]
    row = enc.first()
    assert row["input_ids"][:10] == [101, 4, 5, 6, 7, 11, 8, 9, 10, 102] and len(row["input_ids"]) == 128
    assert row["word_ids"][:10] == [-1, 0, 0, 1, 2, 3, 4, 5, 6, -1] and sum(row["attention_mask"]) == 10 and row["err"] == 0
    assert enc.select(tokens.decode(F.col("tokens")).alias("d")).first()["d"] == "привет , мир ! как дела ?"
    _, bad = encoded(spark, "мир xyz")
    assert bad.first()["err"] == 1 and bad.first()["input_ids"][:4] == [101, 7, 1, 102]
    _, long = encoded(spark, "мир " * 300 + "xyz")
    assert long.first()["err"] == 0 and sum(long.first()["attention_mask"]) == 128


def test_split_word():
    known = {t for t, _ in VOCAB}
    assert tokens.split_word("привет", known) == ["при", "##вет"]
    assert tokens.split_word("приветы", known) == ["[UNK]"]
    assert tokens.split_word("ы" * 51, known | {"ы", "##ы"}) == ["[UNK]"]
    assert tokens.split_word("ы" * 50, known | {"ы", "##ы"}) == ["ы"] + ["##ы"] * 49


def test_merge_subwords(spark):
    rows = [(1, 1, 0, 0, "при", "I-SUBJECT", 0, 6), (1, 1, 0, 1, "##вет", "B-SUBJECT", 6, 12), (1, 1, 1, 0, "мир", "O", 13, 19)]
    df = spark.createDataFrame(rows, "doc int, sent_no int, unit_no int, piece_no int, token string, label string, start_b long, end_b long")
    got = tokens.merge_subwords(df, ["doc"]).orderBy("word_no").collect()
    assert [(r["word"], r["main_label"], r["has_b"], r["end_b"]) for r in got] == [("привет", "B-SUBJECT", True, 12), ("мир", "O", False, 19)]


def test_labels(spark):
    rows = [(1, 0, "SUBJECT"), (1, 1, "SUBJECT"), (1, 2, "O"), (1, 3, "SUBJECT"), (2, 0, "SUBJECT")]
    df = spark.createDataFrame(rows, "doc int, unit_no int, tag string")
    assert [r["bio"] for r in labels.bio(df, ["doc"]).orderBy("doc", "unit_no").collect()] == ["B-SUBJECT", "I-SUBJECT", "O", "B-SUBJECT", "B-SUBJECT"]
    bad = spark.createDataFrame([(1, 0, "I-SUBJECT"), (1, 1, "I-SUBJECT"), (1, 2, "I-ADDITION"), (1, 3, "Q")], "doc int, unit_no int, label string")
    assert [r["unit_no"] for r in labels.violations(bad, ["doc"]).orderBy("unit_no").collect()] == [0, 2]
    assert [r["label"] for r in labels.invalid(bad).collect()] == ["Q"]
    subs = [(1, 0, 0, "a", "B-SUBJECT"), (1, 0, 1, "##b", "B-SUBJECT"), (1, 1, 0, ",", "O"), (1, 2, 0, "c", "I-SUBJECT"), (1, 2, 1, "##d", "I-SUBJECT"), (1, 3, 0, "e", "O")]
    got = labels.align(spark.createDataFrame(subs, "doc int, unit_no int, piece_no int, token string, label string"), ["doc"])
    assert [r["aligned"] for r in got.orderBy("unit_no", "piece_no").collect()] == [3, 4, -100, 4, 0, 0]
    split = labels.train_val_split(spark.range(101), "id")
    assert split.filter("split = 'train'").count() == 80
    assert labels.train_val_split(spark.range(0), "id").count() == 0


def test_metrics(spark):
    pairs = [("B-SUBJECT", "I-SUBJECT")] * 3 + [("B-SUBJECT", "O")] + [("O", "O")] * 2 + [("O", "B-ADDITION")]
    df = spark.createDataFrame(pairs, "true_label string, pred_label string")
    cells = metrics.confusion(df)
    assert cells.count() == 36
    got = {r["class"]: r for r in metrics.per_class(cells).collect()}
    assert set(got) == {"O", "SUBJECT"}
    assert (got["SUBJECT"]["precision"], got["SUBJECT"]["recall"], got["SUBJECT"]["support"]) == (1.0, 0.75, 4)
    assert abs(got["O"]["f1"] - 2 / 3) < 1e-12
    w = metrics.weighted(metrics.per_class(cells)).first()
    assert abs(w["recall"] - 5 / 7) < 1e-12
    m = metrics.macro(metrics.per_class(cells)).first()
    assert (m["best"], m["worst"]) == ("SUBJECT", "O")
    assert metrics.macro(metrics.per_class(cells), include_o=False).first()["worst"] == "SUBJECT"
    assert {r["share"] for r in metrics.normalized(cells).filter("true_class = 'PREDICATE'").collect()} == {0.0}
    assert "SUBJECT" in metrics.report(metrics.per_class(cells), 7)


def test_taggers(spark):
    scores = spark.createDataFrame([([0.1, 0.9, 0.9],), ([2.0, 1.0, 0.0],)], "s array<float>")
    assert [r[0] for r in scores.select(taggers.argmax(F.col("s"))).collect()] == [1, 0]
    units = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc int, unit_no int, unit string")
    gold = spark.createDataFrame([(1, 1, "B-SUBJECT")], "doc int, unit_no int, label string")
    assert [r["label"] for r in taggers.GoldTagger(gold, ["doc"])(units).orderBy("unit_no").collect()] == ["O", "B-SUBJECT"]
    odd = taggers.named(units.withColumn("label_id", F.lit(99)))
    assert odd.count() == 0 and taggers.named(units.withColumn("label_id", F.lit(99)), "O").first()["label"] == "O"


def test_markup(spark):
    # the gap before an entity that is not shown comes again in what follows
    rows = [(1, 1, 1, "кот", S, "X", 2, 5), (1, 1, 2, "спит", P, "X", 6, 10), (1, 1, 3, "т", A, "X", 4, 5), (1, 1, 4, "?", A, "X", 11, 40)]
    df = spark.createDataFrame([(*r, "« кот спит!»") for r in rows], "doc int, sent_no int, ent_no int, text string, type_ru string, base string, start_c long, end_c long, sentence string")
    got = annotate.markup(df, ["doc"]).orderBy("piece_no").collect()
    assert [(r["piece"], r["role"]) for r in got] == [("«", ""), ("кот", "подл."), ("спит", "сказ."), ("!", ""), ("!", ""), ("»", "")]
    assert [r["piece_no"] for r in got] == list(range(6))


def test_offsets_and_specials(spark):
    rows = [(1, 0, "[CLS]", 0, 0), (1, 1, "a", 3, 1), (1, 2, "b", 0, 0), (1, 3, "[UNK]", 5, 6), (1, 4, "[SEP]", 0, 0)]
    df = spark.createDataFrame(rows, "doc int, pos int, token string, start_b long, end_b long")
    got = tokens.repair_offsets(df, ["doc"], "pos").orderBy("pos").collect()
    assert [(r["pos"], r["start_b"], r["end_b"]) for r in got] == [(0, 0, 0), (1, 1, 3), (3, 5, 6)]
    assert [r["token"] for r in tokens.drop_special(df).orderBy("pos").collect()] == ["a", "b", "[UNK]"]
    assert [r["token"] for r in tokens.drop_special(df, unknown=True).orderBy("pos").collect()] == ["a"]


def test_wordpiece_of_a_vocabulary_too_large_to_broadcast(spark, monkeypatch):
    from glossaflow.operators import tokens

    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(["[UNK]", "сло", "##во", "##в", "##о", "а", "##б", "слово"])], "token string, id long")
    words = spark.createDataFrame([(w, n) for n, w in enumerate(["слово", "словов", "аб", "аб", "абв", "я", "", "а" * 60, "аббб"])], "word string, n long")
    want = sorted((r["n"], r["word"], r["pieces"]) for r in tokens.wordpiece(words, vocab).collect())
    monkeypatch.setattr(tokens, "MAX_VOCABULARY", 3)
    out = tokens.wordpiece(words, vocab)
    assert out.columns == ["word", "n", "pieces", "ids"]
    assert all(r["ids"] == [{"[UNK]": 100}.get(p, ["[UNK]", "сло", "##во", "##в", "##о", "а", "##б", "слово"].index(p)) for p in r["pieces"]] for r in out.filter("not array_contains(pieces, '[UNK]')").collect())
    assert sorted((r["n"], r["word"], r["pieces"]) for r in out.collect()) == want
    assert (0, "слово", ["слово"]) in want and (2, "аб", ["а", "##б"]) in want


def test_split_is_exact_with_repeated_keys(spark):
    for n, keys in ((42, 6), (50, 1), (40, 40), (0, 1), (1, 1)):
        df = spark.createDataFrame([(i % keys if i % 7 else None, i) for i in range(n)], "k long, i long").repartition(3)
        got = labels.train_val_split(df, "k").collect()
        assert len(got) == n and sum(r["split"] == "train" for r in got) == int(n * 0.8)
        assert {r["split"] for r in got} <= {"train", "val"}


def test_numbers_run_through_all_ranges(spark):
    from glossaflow.operators.order import numbered

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("t")).repartition(7)
    got = numbered(df, [F.desc("k")], "no", 0).collect()
    assert sorted((r["no"], r["k"]) for r in got) == [(i, 999 - i) for i in range(1000)]
    assert sorted(r["rank"] for r in numbered(df).collect()) == list(range(1, 1001))
    assert numbered(df.limit(0), ["k"]).count() == 0


def test_a_long_sentence_takes_seconds(spark):
    text = "слово, " * 20_000
    sents = spark.createDataFrame([(1, 1, text)], "doc long, sent_no int, sentence string")
    began = time.time()
    units = annotate.units(sents).drop("sentence")
    last = units.agg(F.count("*").alias("n"), F.max("end_c").alias("c"), F.max("end_b").alias("b")).first()
    assert (last["n"], last["c"], last["b"]) == (40_000, 7 * 20_000 - 1, 12 * 20_000 - 1)
    ents = annotate.entities(taggers.RuleTagger()(units.filter("not is_mark")), ["doc"])
    assert annotate.markup(ents, ["doc"], sents).filter("kind = 'gap'").count() == 20_000
    pred = units.select("doc", "start_c", "unit")
    gold = spark.range(20_000).select(F.lit(1).cast("long").alias("doc"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 5).alias("end"), F.lit("B-SUBJECT").alias("label"))
    aligned = metrics.align_gold(pred, gold, ["doc"])
    assert aligned.groupBy("true_label").count().orderBy("true_label").collect() == [("B-SUBJECT", 20_000), ("O", 20_000)]
    assert time.time() - began < 150


def test_gold_tags_twice_for_a_unit(spark):
    units = annotate.units(spark.createDataFrame([(1, 1, "Кот спит")], "doc long, sent_no int, sentence string"))
    gold = spark.createDataFrame([(1, 1, 0, "B-SUBJECT"), (1, 1, 0, "B-ADDITION"), (1, 1, 0, "B-SUBJECT")], "doc long, sent_no int, unit_no int, label string")
    got = taggers.GoldTagger(gold, ["doc", "sent_no"])(units).orderBy("unit_no").collect()
    assert [r["label"] for r in got] == ["B-ADDITION", "O"]


def test_analysis_from_texts_to_results(spark):
    vocab = spark.createDataFrame([("при", 4), ("##вет", 5), (",", 6), ("мир", 7), ("как", 8), ("дела", 9), ("?", 10), ("!", 11)], "token string, id long")
    docs = spark.createDataFrame([(1, "Привет, мир! Как дела? Неизвестно."), (2, None), (3, " ")], "doc_id long, text string")

    def tagger(encoded):
        # O for the mark, B-SUBJECT and I-SUBJECT, an unknown id for anything else
        ids = F.create_map(*[F.lit(x) for pair in (("при", 3), ("##вет", 0), (",", 0), ("мир", 4), ("как", 5), ("дела", 6), ("?", 0)) for x in pair])
        return encoded.withColumn("label_ids", F.transform("tokens", lambda t: F.coalesce(F.get(F.map_values(F.map_filter(ids, lambda k, v: k == t)), F.lit(0)), F.lit(99))))

    out = analysis.analyze(docs, ["doc_id"], vocab, tagger)
    assert out.drop("doc_id").schema.simpleString() == spark.createDataFrame([], schema.SENTENCE_RESULT).drop("doc_id").schema.simpleString()
    rows = out.orderBy("sent_no").collect()
    assert [(r["doc_id"], r["sent_no"], r["text"], r["err"]) for r in rows] == [(1, 1, "Привет, мир!", 0), (1, 2, "Как дела?", 0), (1, 3, "Неизвестно.", 1)]
    assert [tuple(e) for e in rows[0]["entities"]] == [("Привет мир", "B-SUBJECT", "подлежащее", 0, 20)]
    assert [tuple(e) for e in rows[1]["entities"]] == [("Как дела", "B-PREDICATE", "сказуемое", 0, 15)]
    assert rows[0]["tokens"][:8] == ["[CLS]", "при", "##вет", ",", "мир", "!", "[SEP]", "[PAD]"] and len(rows[0]["token_labels"]) == 128
    assert (rows[2]["entities"], rows[2]["tokens"]) == ([], [])
    assert [r["text"] for r in analysis.phrases(out, ["doc_id"]).orderBy("sent_no").collect()] == ["Привет мир", "Как дела"]
    with pytest.raises(Exception, match="not encoded"):
        analysis.strict(out).collect()
    assert analysis.strict(out.filter("sent_no < 3")).count() == 2
    assert analysis.analyze(docs.limit(0), ["doc_id"], vocab, tagger).count() == 0


@pytest.mark.parametrize("text", ["word " * 100_000, "[" * 100_000, "a [" * 50_000 + "\n" + "[x] b. " * 1000, "»" * 100_000, "…" + "»" * 100_000, "a." * 50_000])
def test_from_text_to_units_in_linear_time(spark, text):
    df = spark.createDataFrame([(1, text)], "doc int, text string")
    annotate.units(annotate.sentences(spark.createDataFrame([(1, "a b.")], "doc int, text string"), ["doc"])).count()
    began = time.time()
    assert annotate.units(annotate.sentences(df, ["doc"])).agg(F.count("unit")).first()[0] >= 0
    assert time.time() - began < 5


def test_texts_are_split_once(spark, tmp_path):
    """A filter on the sentences' number would be pushed to the scan, and split every text there as well."""
    texts = [("a", "Раз. Два… Три"), ("b", ""), ("a", None), ("c", " [x] ")]
    spark.createDataFrame(texts, "lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = annotate.sentences(spark.read.parquet(str(tmp_path / "documents.parquet")), ["lang"])
    sums = queries.sentence_word_stats(spark, str(tmp_path))
    for df in (rows, sums):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"[^\p{L}\p{N}\x09-\x0D \p{P}]") == 1
    assert sorted(map(tuple, rows.collect())) == [("a", 1, "Раз."), ("a", 2, "Два…"), ("a", 3, "Три")]
    assert list(map(tuple, sums.collect())) == [("a", 3, 3)]


def test_encoding_in_the_row(spark):
    """The same arrays as by rows of units, long sentences and unknown words included, without an exchange by key."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["привет", "Мир", "как", "дела", "zz", "при", "при-вет", ",", "а" * 60]) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(60)]
    texts += ["?", "a" * 5000, ""]
    words = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "при", "##вет", ",", "мир", "как", "дела", "?", "!", "-", "вет"]
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(words)] + [("мир", 40)], "token string, id long")
    sents = annotate.sentences(spark.createDataFrame(list(enumerate(texts)), "doc int, text string"), ["doc"])
    for more in ({}, {"pad": False, "max_len": 20}):
        by_rows = tokens.encode(tokens.subtokens(annotate.units(sents).drop("sentence"), vocab, ["doc"]), ["doc"], **more)
        in_row = tokens.encode_sentences(sents, vocab, ["doc"], **more)
        a, b = (df.select(*by_rows.columns).orderBy("doc", "sent_no").collect() for df in (by_rows, in_row))
        assert a == b and len(a) > 40
    assert "hashpartitioning" not in in_row._jdf.queryExecution().executedPlan().toString()


def test_split_descends_to_a_few_hashes(spark):
    """The same cut however few hashes one task may order, also with keys that repeat."""
    for rows in ([(i % 700,) for i in range(3000)], [(7,)] * 500 + [(i,) for i in range(20)]):
        df = spark.createDataFrame(rows, "k int")
        want = sorted(map(tuple, labels.train_val_split(df, "k").groupBy("k", "split").count().collect()))
        assert sorted(map(tuple, labels.train_val_split(df, "k", few=0).groupBy("k", "split").count().collect())) == want
        assert sum(n for _, s, n in want if s == "train") == int(len(rows) * 0.8)


def test_open_brackets_stay(spark):
    rows = ["[a] b [c", "[a\n] b", "[[x] y] z", "x ] [ y", "[", "[]", "a [b\n[c] d"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(T.sanitize(F.col("s"))).collect()]
    assert got == ["b [c", "[a ] b", "y] z", "x ] [ y", "[", "", "a [b d"]
