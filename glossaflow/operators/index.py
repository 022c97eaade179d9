"""Items stored for searching: a search reads what its needle can be in, not all items.

Prefixes: items are written in ranges of their lower-cased text, in a folder for each
first character. A needle names the folder (partition filter), and within it the files'
and row groups' bounds leave only the needle's range (pushed-down filters).

Substrings: for each item the grams of one to three characters that it holds are written
as postings, in folders by a hash of the gram and sorted inside. A needle's grams name the
folders; the items that hold all of them are candidates, which are then verified. A
common gram is many rows of a range, never one list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import search

#: Folders of postings; they part the grams, so a search reads about one of them a gram.
BUCKETS = 64
_GRAM = 3


def _lead(text: Column) -> Column:
    """What names an item's folder: the code point of its first character, 0 for an empty text."""
    return F.when(text == "", F.lit(0)).otherwise(F.ascii(F.left(text, F.lit(1)))).cast("int")


def write_prefixes(items: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """items (type_ru, text, …) for prefix(): sorted by lower-cased text, which is kept as key."""
    rows = items.withColumn("key", F.lower("text")).withColumn("lead", _lead(F.col("key")))
    order = ["lead", "key", "type_ru"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("lead").parquet(path)


def with_prefix(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """The items whose text begins with needle in any case, from what write_prefixes() wrote."""
    rows, low = spark.read.parquet(path), needle.strip().lower()
    if low:
        rows = rows.filter((F.col("lead") == ord(low[0])) & (F.col("key") >= low) & F.col("key").startswith(low))
    return rows.drop("key", "lead")


def prefix_search(spark: SparkSession, path: str, needle: str = "", members: Sequence[str] = schema.CATEGORIES, order: str = "alphabet_asc") -> DataFrame:
    """search.prefix_search() over the stored items."""
    return search.prefix_search(with_prefix(spark, path, needle), needle, members, order)


def _grams(text: Column) -> Column:
    """The distinct runs of one to three characters of a text."""

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.filter(F.concat(*[runs(n) for n in range(1, _GRAM + 1)]), lambda g: g != ""))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(F.encode(gram, "UTF-8")), F.lit(BUCKETS)).cast("int")


def write_postings(items: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """items with original_order: rows at path/items, sorted by it, and postings (gram, original_order) at path/postings."""
    items.repartitionByRange("original_order").sortWithinPartitions("original_order").write.mode(mode).parquet(f"{path}/items")
    rows = items.select(F.explode(_grams(F.lower("text"))).alias("gram"), "original_order").withColumn("bucket", _bucket(F.col("gram")))
    order = ["bucket", "gram", "original_order"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")


def needle_grams(needle: str) -> list[str]:
    """The grams that an item with the needle inside must hold: the longest ones do."""
    low = needle.strip().lower()
    n = min(_GRAM, len(low))
    return sorted({low[i : i + n] for i in range(len(low) - n + 1)}) if low else []


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """(original_order) of items that hold all grams of a needle, which isn't blank."""
    import zlib

    grams = needle_grams(needle)
    buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})
    rows = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    if len(grams) == 1:
        return rows.select("original_order")
    return rows.groupBy("original_order").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("original_order")


def relevance_search(spark: SparkSession, path: str, needle: str, type_ru: str = "") -> DataFrame:
    """The visible items of search.relevance() with the same match_type and rank; a blank needle finds all items of the type."""
    rows = spark.read.parquet(f"{path}/items")
    if needle.strip():
        rows = rows.join(candidates(spark, path, needle), "original_order", "left_semi")
    kind = search.match_type(needle) if not type_ru else F.when(F.col("type_ru") == type_ru, search.match_type(needle)).otherwise("none")
    return search.relevance(rows.filter(kind != "none"), needle, type_ru)
