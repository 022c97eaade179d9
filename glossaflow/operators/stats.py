"""Counts over sentences and entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T


def categories(df: DataFrame) -> DataFrame:
    """The six categories in order, made from literals."""
    rows = F.array(*[F.struct(F.lit(i).alias("cat_no"), F.lit(c).alias("type_ru")) for i, c in enumerate(schema.CATEGORIES)])
    return df.sparkSession.range(1).select(F.explode(rows).alias("x")).select("x.*")


def _named(ents: DataFrame) -> DataFrame:
    """Entities without a text or type don't count."""
    return ents.filter("text <> '' and type_ru <> ''")


def global_stats(sents: DataFrame, ents: DataFrame) -> DataFrame:
    """One row: sentences_total, words_total, members_total and a total for each category."""
    base = sents.agg(F.count("*").alias("sentences_total"), F.coalesce(F.sum(T.count_words(F.col("sentence"))), F.lit(0)).alias("words_total"))
    parts = [F.count_if(F.col("type_ru") == c).alias(f"total_{i}") for i, c in enumerate(schema.CATEGORIES)]
    return base.join(F.broadcast(_named(ents).agg(F.count("*").alias("members_total"), *parts)))


def category_totals(ents: DataFrame) -> DataFrame:
    n = _named(ents).groupBy("type_ru").agg(F.count("*").alias("n"))
    return categories(ents).join(n, "type_ru", "left").select("cat_no", "type_ru", F.coalesce("n", F.lit(0)).alias("n"))


def totals_of(words: DataFrame) -> DataFrame:
    """category_totals() of word_counts()."""
    n = words.groupBy("type_ru").agg(F.sum("n").alias("n"))
    return categories(words).join(n, "type_ru", "left").select("cat_no", "type_ru", F.coalesce("n", F.lit(0)).alias("n"))


def sentence_parts(ents: DataFrame) -> DataFrame:
    """Counts by category; unknown types count as other, and nothing is skipped."""
    kind = F.when(F.col("type_ru").isin(*schema.CATEGORIES), F.col("type_ru")).otherwise(schema.CATEGORIES[-1])
    n = ents.groupBy(kind.alias("type_ru")).agg(F.count("*").alias("n"))
    return categories(ents).join(n, "type_ru", "left").select("cat_no", "type_ru", F.coalesce("n", F.lit(0)).alias("n"))


def shares(totals: DataFrame) -> DataFrame:
    """totals with share (0 if there is nothing) and percent to one decimal; six rows, so the window is small."""
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))
    share = F.coalesce(F.try_divide("n", F.nullif(whole, F.lit(0))), F.lit(0.0))
    return totals.withColumn("share", F.round(share, 6)).withColumn("percent", F.round(share * 100, 1))


def word_counts(ents: DataFrame) -> DataFrame:
    return _named(ents).groupBy("type_ru", F.lower("text").alias("word")).agg(F.count("*").alias("n"))


def top_member(ents: DataFrame) -> DataFrame:
    """The most frequent word of each category, the first by code point of equals; ('-', 0) if none occurs twice.

    An aggregation with map-side combine, not a window: hot categories stay spread out.
    """
    return top_of(word_counts(ents))


def top_of(words: DataFrame) -> DataFrame:
    """top_member() of word_counts()."""
    best = words.groupBy("type_ru").agg(F.min_by(F.struct("word", "n"), F.struct((-F.col("n")).alias("m"), F.col("word"))).alias("b"))
    ok = F.col("b.n") > 1
    return categories(words).join(best, "type_ru", "left").select(
        "cat_no", "type_ru", F.when(ok, F.col("b.word")).otherwise("-").alias("top_word"), F.when(ok, F.col("b.n")).otherwise(F.lit(0)).alias("top_count")
    )


def item_contexts(ents: DataFrame, keys: Sequence[str], sents: DataFrame) -> DataFrame:
    """(type_ru, text, keys, sent_no, sentence): the distinct sentences of each phrase, a row each, so a common phrase is many rows and no large one."""
    by = [*keys, "sent_no"]
    places = _named(ents).select("type_ru", F.lower("text").alias("text"), *by).distinct()
    return places.join(sents.select(*by, "sentence"), by).select("type_ru", "text", *by, "sentence")


def search_items(ents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(type_ru, text, amount, n_sentences, sentences): phrases by lower-cased text with their distinct contexts in order.

    For the items of a page: all contexts of a phrase stand in its row. Where phrases
    may be common, item_counts() and item_contexts() have the same as rows.
    """
    context = F.struct(*keys, "sent_no", "sentence")
    return (
        _named(ents)
        .groupBy("type_ru", F.lower("text").alias("text"))
        .agg(F.count("*").alias("amount"), F.array_sort(F.collect_set(context)).alias("sentences"))
        .withColumn("n_sentences", F.size("sentences").cast("long"))
    )


def item_counts(ents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """search_items without the contexts themselves: (type_ru, text, amount, n_sentences); no array is ever built."""
    per = _named(ents).groupBy("type_ru", F.lower("text").alias("text"), *keys, "sent_no").agg(F.count("*").alias("n"))
    return per.groupBy("type_ru", "text").agg(F.sum("n").alias("amount"), F.count("*").alias("n_sentences"))


def by_type(ents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Console listing: the texts of each type in a sentence, in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ent_no", "text"))), lambda x: x["text"])
    return ents.groupBy(*keys, "sent_no", "type_ru").agg(F.array_join(texts, ", ").alias("texts"))


def file_totals(sents: DataFrame, ents: DataFrame, key: str) -> DataFrame:
    """Sentences and entities of each text."""
    n = ents.groupBy(key).agg(F.count("*").alias("total_entities"))
    return sents.groupBy(key).agg(F.count("*").alias("total_sentences")).join(n, key, "left").select(key, "total_sentences", F.coalesce("total_entities", F.lit(0)).alias("total_entities"))
