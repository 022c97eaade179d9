"""Phrase counts and top members over a stream: keyed state, right after any order of arrival.

State is a count for each (category, phrase), kept by Spark's own aggregation, so no key
is hot and no row goes through Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import categories

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "type_ru string, shard int, word string, n long"


def phrase_counts(ents: DataFrame, shards: int = 32) -> DataFrame:
    """A stream of phrases (type_ru, text) to updates (type_ru, shard, word, n): the new count of each phrase of a batch.

    Write it in update mode. An update replaces earlier ones of the same (type_ru, word);
    shard deals the words of a category out. Rows may come in any order and however late:
    counts don't depend on time, so there is no watermark. Phrases without a text or type
    don't count.
    """
    spark = ents.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    rows = ents.filter("text <> '' AND type_ru <> ''").select("type_ru", F.lower("text").alias("word"))
    n = rows.groupBy("type_ru", "word").agg(F.count("*").alias("n"))
    return n.select("type_ru", F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard"), "word", "n")


def counted(updates: DataFrame) -> DataFrame:
    """(type_ru, word, n) of all updates so far, in any order: counts only grow."""
    return updates.groupBy("type_ru", "word").agg(F.max("n").alias("n"))


def top_members(updates: DataFrame) -> DataFrame:
    """stats.top_member() of all updates so far: a phrase's last update has its highest count, so earlier ones don't come before it; of equals the least word."""
    best = updates.groupBy("type_ru").agg(F.min_by(F.struct("word", "n"), F.struct((-F.col("n")).alias("m"), "word")).alias("b"))
    ok = F.col("b.n") > 1
    found = categories(updates).join(best, "type_ru", "left")
    return found.select("cat_no", "type_ru", F.when(ok, F.col("b.word")).otherwise("-").alias("top_word"), F.when(ok, F.col("b.n")).otherwise(F.lit(0)).alias("top_count"))
