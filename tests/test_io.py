import datetime
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glossaflow.operators import annotate, metrics, stats, taggers
from glossaflow.plans import queries
from glossaflow.sources import readers, writers
from glossaflow.streaming import annotate as streams


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Привет", encoding="utf-8")
    (tmp_path / "b.TXT").write_bytes(b"\xff\xfe")
    (tmp_path / "c.md").write_text("x")
    (tmp_path / "d.txt").write_bytes(b"x" * (300 * 1024 + 1))
    (tmp_path / "e.txt").write_text("a�b", encoding="utf-8")
    got = {r["path"][-5:]: (r["state"], r["text"]) for r in readers.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("ok", "Привет"), "b.TXT": ("utf8", None), "/c.md": ("suffix", None), "d.txt": ("size", None), "e.txt": ("utf8", None)}
    assert [r["text"] for r in readers.accepted_files(spark, str(tmp_path)).collect()] == ["Привет"]


def test_row_files(spark, tmp_path):
    rows = [(i % 7, None if i == 3 else f"Привет\n{i}\r") for i in range(40)] + [(None, "a/b")]
    df = spark.createDataFrame(rows, "k int, t string").repartition(3)
    folders = writers.row_files(df, f"file://{tmp_path}/out", "k", "t")
    assert all(f.startswith(f"file://{tmp_path}/out/") for f in folders)
    files = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert sorted(p.read_bytes().decode() for p in files) == sorted((t or "") + "\n" for _, t in rows)
    assert sorted(p.name.split("-", 1)[1] for p in files) == sorted(f"{'' if k is None else k}.txt" for k, _ in rows)
    assert sorted(r["text"] for r in readers.text_files(spark, folders).collect()) == sorted((t or "") + "\n" for _, t in rows)
    assert readers.accepted_files(spark, folders).count() == readers.whole_text(spark, folders).count() == 41
    assert readers.text_files(spark, writers.row_files(df.limit(0), f"file://{tmp_path}/none", "k", "t")).count() == 0
    [odd] = writers.row_files(df.limit(1).select(F.lit("../x é=1").alias("k"), "t"), f"file://{tmp_path}/odd", "k", "t")
    assert [r["path"] for r in readers.text_files(spark, odd).collect()] == [f"{odd.replace('file://', 'file:')}/00000000-..%2Fx%20%C3%A9=1.txt"]


def test_page_files_are_in_few_folders(spark):
    """A listing costs a task a folder, so there may not be one for each page."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    folders = queries._page_files(spark, "/root/testdata/sf0.001")
    assert len(folders) <= 4 < pages and readers.text_files(spark, folders).count() == pages


def test_small_files_share_tasks(spark, tmp_path):
    """A scan makes a task for each few small files, however small."""
    folders = writers.row_files(spark.range(300).select("id", F.lit("x").alias("t")), f"file://{tmp_path}/out", "id", "t")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        for df, times in ((readers.text_files(spark, folders), 2), (readers.accepted_files(spark, folders), 1), (readers.whole_text(spark, folders), 1)):
            assert df.rdd.getNumPartitions() <= 16 * times and df.count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_consoles(spark):
    rows = [(k, i, t) for k, lines in enumerate((["a [x]", " b ", "", "c"], [" ", " d", "QUIT", "e"], ["", "f"], [" Q"], ["exit "], ["g"])) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "k int, at int, text string").repartition(3)
    listed = lambda x: sorted((r["k"], r["text"]) for r in x.collect())
    assert listed(readers.lines_until_blank(df, ["k"], "at")) == [(0, " b "), (0, "a [x]"), (1, " "), (1, " d"), (1, "QUIT"), (1, "e"), (3, " Q"), (4, "exit "), (5, "g")]
    assert listed(readers.lines_until_quit(df, ["k"], "at")) == [(0, "a [x]"), (0, "b"), (0, "c"), (1, "d"), (2, "f"), (5, "g")]


def test_small_sources(spark, tmp_path):
    assert [r["state"] for r in readers.typed(spark, ["Да.", "  ", "+++"]).orderBy("doc_id").collect()] == ["ok", "empty"]
    (tmp_path / "l.txt").write_text("one\n\n  two \nx\n")
    assert [r["text"] for r in readers.lines(spark, str(tmp_path / "l.txt")).collect()] == ["one", "two", "x"]
    assert readers.whole_text(spark, str(tmp_path / "l.txt")).first()["text"].startswith("one\n")
    assert readers.blank_labels(spark, str(tmp_path / "l.txt")).first()["tags"] == [""]
    (tmp_path / "v.txt").write_text("[PAD]\r\n\na\nb\na\n")
    assert {r["token"]: r["id"] for r in readers.vocabulary(spark, str(tmp_path / "v.txt")).collect()} == {"[PAD]": 0, "a": 3, "b": 2}
    (tmp_path / "c.json").write_text(json.dumps({"id2label": {"0": "O", "3": "B-SUBJECT"}}))
    assert {r["label_id"]: r["type_ru"] for r in readers.label_config(spark, str(tmp_path / "c.json")).collect()} == {0: "другое", 3: "подлежащее"}
    assert readers.label_config(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "d.json").write_text(json.dumps([{"tokens": ["a", "b"], "tags": ["O", "O"]}, {"tokens": ["a"], "tags": []}]))
    assert [r["text"] for r in readers.labelled(spark, str(tmp_path / "d.json")).collect()] == ["a b"]
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        readers.labelled(spark, str(tmp_path / "e.json"))
    assert list(readers.until_blank(["a", " ", "", "b"])) == ["a", " "]
    assert list(readers.until_quit([" a ", "", "Quit", "b"])) == ["a"]
    assert readers.asset(str(tmp_path / "none")) == readers.asset(None) == "" and readers.asset(str(tmp_path / "e.json")) == "[]"
    samples = spark.createDataFrame([(["a", "б"], ["O", "O"]), (["c"], ["B-SUBJECT"])], "tokens array<string>, tags array<string>")
    writers.dataset_json(samples.repartition(5), str(tmp_path / "set"))
    assert sorted(r["text"] for r in readers.labelled(spark, str(tmp_path / "set")).collect()) == ["a б", "c"]
    for f in (tmp_path / "set").glob("*.txt"):
        json.loads(f.read_text())
    writers.metadata(spark, str(tmp_path / "m" / "metadata.json"), "x")
    assert json.loads((tmp_path / "m" / "metadata.json").read_text())["id2label"]["3"] == "B-SUBJECT"
    with pytest.raises(FileExistsError):
        writers.metadata(spark, str(tmp_path / "m" / "metadata.json"), "x")


def test_reports(spark, tmp_path):
    texts = spark.createDataFrame([(1, 'Кот "спит" <b>. Кот ест рыбу!')], "doc int, text string")
    sents = annotate.sentences(texts, ["doc"])
    ents = annotate.entities(taggers.RuleTagger()(annotate.units(sents).filter("not is_mark")), ["doc"])
    items = writers.item_rows  # noqa: F841
    from glossaflow.operators import search

    found = search.with_order(stats.search_items(ents, ["doc"]))
    pages = writers.analysis(found, sents, ents, str(tmp_path / "out"))
    text = Path(pages[0]).read_text(encoding="utf-8")
    assert 'data-original-order="0"' in text and "<script>" in text and '<li>Кот &quot;спит&quot;' in text
    assert "Предложений" in Path(pages[1]).read_text(encoding="utf-8")
    with pytest.raises(FileExistsError):
        writers.analysis(found, sents, ents, str(tmp_path / "out"))
    writers.analysis(found, sents, ents, str(tmp_path / "out"), overwrite=True)
    writers.results_json(sents, ents, ["doc"], str(tmp_path / "json"))
    row = spark.read.json(str(tmp_path / "json")).first()
    assert row["total_sentences"] == 2 and row["total_entities"] == ents.count()
    assert writers.listing(sents, ents.filter("sent_no = 1"), ["doc"]).orderBy("sent_no").collect()[1]["line"] == "-"
    writers.item_pages(found, str(tmp_path / "pages"), per_page=2)
    pages = spark.read.text(str(tmp_path / "pages"), wholetext=True).collect()
    assert sum(r["value"].count("data-original-order") for r in pages) == found.count() and len(pages) == -(-found.count() // 2)
    pairs = spark.createDataFrame([("O", "O")], "true_label string, pred_label string")
    writers.evaluation(metrics.per_class(metrics.confusion(pairs)), metrics.confusion(pairs), str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text())["macro"]["f1"] == 1.0
    vocab = spark.createDataFrame([("b", 1), ("a", 0)], "token string, id long")
    writers.vocabulary_text(vocab, str(tmp_path / "vocab"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "vocab")).collect()] == ["a", "b"]


def test_vocabulary_in_several_files(spark, tmp_path):
    vocab = spark.createDataFrame([(f"t{i}", i) for i in range(1000)], "token string, id long")
    writers.vocabulary_text(vocab, str(tmp_path / "v"), files=7)
    assert len(list((tmp_path / "v").glob("part-*"))) > 3
    assert sorted(map(tuple, readers.vocabulary(spark, str(tmp_path / "v")).collect())) == sorted(map(tuple, vocab.collect()))


def test_search_site(spark, tmp_path):
    from glossaflow.operators import search

    texts = spark.createDataFrame([(i, f'Кот "спит" <b> {i}. Кот ест рыбу!') for i in range(40)], "doc int, text string")
    sents = annotate.sentences(texts, ["doc"])
    ents = annotate.phrases(sents, taggers.RuleTagger().in_row, lambda u: u != "")
    items = search.with_order(stats.item_counts(ents, ["doc"]))
    contexts = stats.item_contexts(ents, ["doc"], sents)
    page = writers.search_site(items, contexts, ["doc"], str(tmp_path / "site"), lines=50)
    text = Path(page).read_text(encoding="utf-8")
    names = json.loads(text.split("const SHARDS=")[1].split(",BOUNDS")[0])
    bounds = json.loads(text.split(",BOUNDS=")[1].split(";\n")[0])
    found, held = [], []
    for name, (first, last) in zip(names, bounds):
        lines = (tmp_path / "site" / name).read_text(encoding="utf-8").splitlines()
        assert len(lines) <= 50
        orders = [int(x[2:].split(",")[0].rstrip(")")) for x in lines]
        assert (min(orders), max(orders)) == (first, last) and orders == sorted(orders)
        found += [x for x in lines if x.startswith("i(")]
        held += [json.loads("[" + x[2:-2] + "]") for x in lines if x.startswith("c(")]
    assert len(names) > 2 and len(found) == items.count() and len(held) == contexts.count()
    by = {r["original_order"]: (r["type_ru"], r["text"]) for r in items.collect()}
    assert sorted((*by[o], s) for o, s in held) == sorted((r["type_ru"], r["text"], r["sentence"]) for r in contexts.collect())
    with pytest.raises(FileExistsError):
        writers.search_site(items, contexts, ["doc"], str(tmp_path / "site"))


def test_search_site_writes_its_ranges(spark, tmp_path, monkeypatch):
    """Lines go to the shards from the sorted ranges, without a table between; contexts of one pass are those of the join, and repeated ones are lines once."""
    from glossaflow.operators import search

    texts = spark.createDataFrame([(i, f"Кот ест и кот ест. Рыба плывёт {i % 5}!") for i in range(30)], "doc int, text string")
    sents, keep = annotate.sentences(texts, ["doc"]), lambda u: u != ""
    ents = annotate.phrases(sents, taggers.RuleTagger().in_row, keep)
    found = annotate.contexts(sents, taggers.RuleTagger().in_row, keep)
    columns = ["type_ru", "text", "doc", "sent_no", "sentence"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, stats.item_contexts(ents, ["doc"], sents).select(columns).collect()))
    monkeypatch.setattr(writers, "stored", None)
    items = search.with_order(stats.item_counts(ents, ["doc"]))
    writers.search_site(items, found.unionByName(found), ["doc"], str(tmp_path / "site"), lines=7)
    shards = [p.read_text(encoding="utf-8").splitlines() for p in (tmp_path / "site" / "shards").glob("part-*")]
    assert max(map(len, shards)) <= 7 and sum(map(len, shards)) == items.count() + found.count()


def test_stream_of_phrases_after_any_order(spark, tmp_path):
    """Counts and tops of a stream equal those of the table, whatever the order and the batches."""
    import random

    from glossaflow.streaming import counts

    rng = random.Random(3)
    rows = [(rng.choice(["подлежащее", "сказуемое", "дополнение"]), rng.choice(["Кот", "кот", "пёс", "Дом", "я", "", "ты"])) for _ in range(300)]
    rows += [("определение", "раз"), ("", "кот")]
    df = spark.createDataFrame(rows, "type_ru string, text string")
    want = {(r["type_ru"], r["word"]): r["n"] for r in stats.word_counts(df).collect()}
    tops = sorted(map(tuple, stats.top_member(df).collect()))
    for k in range(2):
        rng.shuffle(rows)
        inbox = tmp_path / f"in{k}"
        for i in range(0, len(rows), 100):
            spark.createDataFrame(rows[i : i + 100], df.schema).coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(inbox))
        q = counts.phrase_counts(stream, shards=2).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True)
        q.foreachBatch(lambda b, _, k=k: b.write.mode("append").parquet(str(tmp_path / f"out{k}"))).start().awaitTermination()
        updates = spark.read.schema(counts.SCHEMA).parquet(str(tmp_path / f"out{k}"))
        assert {(r["type_ru"], r["word"]): r["n"] for r in counts.counted(updates).collect()} == want
        assert sorted(map(tuple, counts.top_members(updates).collect())) == tops


def test_stream_equals_batch(spark, tmp_path):
    ts = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, ts + datetime.timedelta(minutes=i), f"Раз {i}. Два!") for i in range(12)], "doc int, ts timestamp, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.sentences(stream).writeStream.format("memory").queryName("sents").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r["doc"], r["sent_no"], r["sentence"]) for r in d.collect())
    assert key(spark.table("sents")) == key(streams.sentences(df)) == key(annotate.sentences(df, ["doc"]))
    q = streams.window_counts(stream).writeStream.outputMode("complete").format("memory").queryName("wins").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["sentences"] for r in spark.table("wins").collect()) == [4, 10, 10]
