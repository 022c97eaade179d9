import random

from glossaflow import schema
from glossaflow.operators import index, search


def items(spark, n=800):
    rng = random.Random(2)
    texts = {"".join(rng.choice("abcдеж é😀") for _ in range(rng.randrange(0, 9))) for _ in range(n)} | {"", "a", "Абв", "ab", "%", "ab_c"}
    rows = [(t, rng.choice(schema.CATEGORIES), rng.randrange(5)) for t in sorted(texts)]
    return spark.createDataFrame(rows, "text string, type_ru string, amount int")


def test_prefix(spark, tmp_path):
    df = items(spark)
    index.write_prefixes(df, str(tmp_path / "p"))
    shown = lambda x: [tuple(r) for r in x.select("rank", "text", "type_ru", "amount").orderBy("rank").collect()]
    for needle in ("", "a", "AB", "д", " е ", "é", "😀", "абв", "zz", "%"):
        for order in search.ORDERS if needle == "AB" else search.ORDERS[2:3]:
            assert shown(index.prefix_search(spark, str(tmp_path / "p"), needle, order=order)) == shown(search.prefix_search(df, needle, order=order))
    plan = index.with_prefix(spark, str(tmp_path / "p"), "ab")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lead" in plan and "StringStartsWith(key,ab)" in plan and "GreaterThanOrEqual(key,ab)" in plan


def test_postings(spark, tmp_path):
    df = search.with_order(items(spark))
    path = str(tmp_path / "q")
    index.write_postings(df, path)
    shown = lambda x: [tuple(r) for r in x.select("rank", "text", "type_ru", "match_type").orderBy("rank").collect()]
    for needle, kind in (("a", ""), ("ab", ""), ("ABC", ""), ("abca", ""), ("деж", schema.CATEGORIES[0]), ("", schema.CATEGORIES[1]), ("", ""), ("zzz", ""), ("😀", "")):
        want = shown(search.relevance(df, needle, kind).filter("visible"))
        assert shown(index.relevance_search(spark, path, needle, kind)) == want, needle
    plan = index.candidates(spark, path, "abc")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram,abc)" in plan
