"""Units and phrases by Arrow functions."""

import re

import pytest
from pyspark.sql import functions as F

from glossaflow import session
from glossaflow.functions import arrow, text as T
from glossaflow.operators import annotate, tokens


@pytest.mark.parametrize("size", [1, 1 << 21])
def test_units_have_places(spark, monkeypatch, size):
    monkeypatch.setattr(arrow, "SLICE", size)
    texts = [None, "", "день—ночь, a-b… «да»", "😀x ...-", "plain  text."]
    df = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    df = df.select("s", arrow.units(F.col("s")).alias("u"), annotate.unit_list(F.col("s")).alias("p"), annotate.unit_list(F.col("s"), 2).alias("two"), T.units(F.col("s")).alias("want"))
    for r in df.collect():
        assert r["u"] == r["want"]
        if r["s"] is None:
            assert r["p"] is None
            continue
        assert [x["unit"] for x in r["p"]] == r["want"] and r["two"] == r["p"][:2]
        for x in r["p"]:
            assert r["s"][x["start_c"] : x["end_c"]] == x["unit"]
            assert r["s"].encode()[x["start_b"] : x["end_b"]].decode() == x["unit"]


def test_units_are_one_arrow_function(spark):
    plan = spark.range(1).select(annotate.unit_list(F.lit("a b").substr(F.lit(1), F.col("id").cast("int"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and len(re.findall(r"ArrowEvalPython", plan)) == 1


def test_one_file_is_dealt_out(spark, tmp_path):
    spark.range(20_000).selectExpr("repeat(sha2(string(id), 512), 4) AS s").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= spark.sparkContext.defaultParallelism << 20 or df.count()
    rows = session.dealt(df).select("s", F.spark_partition_id().alias("k")).groupBy("k").count().collect()
    assert len(rows) >= 4 and max(r["count"] for r in rows) < 10_000


def test_vocabulary_counts_words_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(tokens, "stored", lambda df, label: made.append(label) or session.stored(df, label))
    units = spark.createDataFrame([("ab",)] * 3 + [("c",)], "unit string")
    assert tokens.vocabulary(units).count() == 4 + 4 + 3
    assert made == ["vocabulary-words", "vocabulary"]


def test_analysis_shuffles_no_tokens(spark):
    """Sentences are split and encoded once, and phrases are made inside the row."""
    from glossaflow.operators import analysis, taggers

    docs = spark.createDataFrame([(1, "One two. Three, four!"), (2, None), (3, "...")], "doc int, text string")
    vocab = tokens.vocabulary(annotate.units(annotate.sentences(docs, ["doc"])), 1)
    out = analysis.analyze(docs, ["doc"], vocab, taggers.RuleTokenTagger())
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r["doc"], r["text"], r["err"]) for r in out.orderBy("doc", "sent_no").collect()][:2] == [(1, "One two.", 0), (1, "Three, four!", 0)]


def test_stream_counts_need_no_python(spark):
    from glossaflow.streaming import counts

    plan = counts.phrase_counts(spark.createDataFrame([("a", "B")], "type_ru string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Pandas" not in plan
