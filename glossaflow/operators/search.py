"""The two search families: prefix search with four orders, and relevance search of a saved page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from .order import numbered

ORDERS = ("alphabet_asc", "alphabet_desc", "frequency_desc", "frequency_asc")


def matches_text(needle: str) -> Column:
    needle = needle.strip()
    return F.lit(True) if not needle else F.lower("text").startswith(needle.lower())


def matches_member(members: Sequence[str]) -> Column:
    return F.col("type_ru").isin(*members) if members else F.lit(False)


def prefix_search(items: DataFrame, needle: str = "", members: Sequence[str] = schema.CATEGORIES, order: str = "alphabet_asc") -> DataFrame:
    """Items whose text starts with needle, of the given members, with their rank.

    The filter goes before the ordering; equal texts are told apart by type.
    """
    exact = (F.lower("text") == needle.strip().lower()).cast("int") if needle.strip() else F.lit(0)
    low = F.lower("text")
    by = {
        "alphabet_asc": [exact.desc(), low.asc()],
        "alphabet_desc": [exact.desc(), low.desc()],
        "frequency_desc": [F.desc("amount"), exact.desc(), low.asc()],
        "frequency_asc": [F.asc("amount"), exact.desc(), low.asc()],
    }[order]
    found = items.filter(matches_text(needle) & matches_member(members))
    return numbered(found, [*by, F.asc("type_ru")])


def match_type(needle: str) -> Column:
    """typeOnly, exact, partial (anywhere inside) or none."""
    needle = needle.strip().lower()
    low = F.lower("text")
    return F.lit("typeOnly") if not needle else F.when(low == needle, "exact").when(low.contains(needle), "partial").otherwise("none")


def relevance(items: DataFrame, needle: str = "", type_ru: str = "", current: str = "original_order") -> DataFrame:
    """All items with match_type, visible and rank: visible ones by exact, partial, typeOnly, then current; hidden ones last.

    current is the order that the items stand in: the original one, or the rank that an earlier search left.
    """
    kind = match_type(needle) if not type_ru else F.when(F.col("type_ru") == type_ru, match_type(needle)).otherwise("none")
    df = items.withColumn("match_type", kind).withColumn("visible", F.col("match_type") != "none")
    place = F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "partial", 1).when(F.col("match_type") == "typeOnly", 2).otherwise(3)
    return numbered(df, [(~F.col("visible")).cast("int"), place, F.col(current)])


def hit_stats(found: DataFrame) -> DataFrame:
    """One row: exact, partial, type_only."""
    return found.agg(*[F.count_if(F.col("match_type") == k).alias(n) for k, n in (("exact", "exact"), ("partial", "partial"), ("typeOnly", "type_only"))])


def hit_message(stats: DataFrame, needle: str = "", type_ru: str = "") -> DataFrame:
    """stats with the message of the saved page."""
    parts = F.concat_ws(
        ", ",
        F.when(F.col("exact") > 0, F.concat(F.col("exact").cast("string"), F.lit(schema.SAID["exact"]))),
        F.when(F.col("partial") > 0, F.concat(F.col("partial").cast("string"), F.lit(schema.SAID["partial"]))),
        F.when((F.col("type_only") > 0) & F.lit(not needle.strip()), F.concat(F.col("type_only").cast("string"), F.lit(schema.SAID["type_only"]))),
    )
    none = (F.col("exact") + F.col("partial") + F.col("type_only")) == 0
    said = F.when(none, schema.SAID["none"]).otherwise(F.concat(F.lit(schema.SAID["found"]), parts))
    return stats.withColumn("message", said if needle.strip() or type_ru else F.lit(""))


def reset(items: DataFrame) -> DataFrame:
    """All items, visible, in their original order."""
    return numbered(items.withColumn("visible", F.lit(True)), ["original_order"])


def with_order(items: DataFrame) -> DataFrame:
    """items with original_order from 0: by type, then text."""
    return numbered(items, ["type_ru", "text"], "original_order", 0)
