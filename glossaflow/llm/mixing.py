"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key (hex md5 of seed and doc_id). Within a source the
rows are ordered by key; word counts are summed over key ranges, prefix sums run
over the ranges, and the range that holds the cut is refined until it is small
enough to be ordered row by row. So a source of any size, also one with a third of
all rows, is cut at its exact budget without one task ever holding its rows, and
whether a row is taken is then a comparison with its source's cut key: the texts
are not shuffled at all.

A target above the source's own size means whole epochs first, then the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, spread, stored

#: Hex digits of the key that a refinement step looks at: 256 ranges a source and step.
DIGITS = 2


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(sk, source, source_size, target) from (sk, source, source_size), a row for each source.

    Sources by code point, null last, weigh as listed, over and over. They share
    share[0] / share[1] of all sizes; no target exceeds most times its source's
    size, and the excess is reshared by weight until none does. The closed form:
    sources fill up in the order of size / weight, and those past the level take
    their weight's share of what is left.
    """
    num, den = share
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = sizes.withColumn("w", w)
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        full.withColumn("total", F.sum("source_size").over(every))
        .withColumn("left", F.col("total") * num - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * (most * den))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        # full to the brim where even this source's share of what is left reaches its bound
        .withColumn("brim", F.col("left") * F.col("w") >= F.col("source_size") * (most * den) * F.col("w_left"))
    )
    open_ = F.min(F.when(~F.col("brim"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source", F.col("left").alias("left"), F.col("w_left").alias("w_left")))).over(every)
    return level.withColumn("open", open_).select(
        "sk",
        "source",
        "source_size",
        F.when(F.col("brim"), (F.col("source_size") * most).cast("double")).otherwise(F.col("open.left").cast("double") * F.col("w") / (F.col("open.w_left") * den)).alias("target"),
    )


def _key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    seed: int = 42,
    range_rows: int = 2_000,
) -> DataFrame:
    """docs with size, source_size, target and taken (names get underscores before them if docs has them).

    taken is the number of words the mix takes of the row: size times the whole
    epochs, and once more if its key is below the cut. The row at the cut is taken
    in part, up to the exact budget. Rows with the same doc_id share a key; if they
    meet the cut they take the remainder in proportion to their sizes. Null texts
    have size 0, a null source is a source of its own, an empty table gives an
    empty one. Reruns agree, whatever the partitioning.
    """
    names = {n: free_name(docs, n) for n in ("size", "source_size", "target", "taken", "sk", "key")}
    with_key = spread(docs).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        word_count(F.col(f"`{text}`")).alias(names["size"]),
        _source_key(F.col(f"`{source}`")).alias(names["sk"]),
        _key(F.col(f"`{doc_id}`"), seed).alias(names["key"]),
    )
    slim = stored(with_key.select(F.col(names["sk"]).alias("sk"), F.col(f"`{source}`").cast("string").alias("source"), F.col(names["size"]).alias("size"), F.col(names["key"]).alias("key")), "mix-keys")
    per = slim.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = stored(per, "mix-sources")
    plan = stored(
        source_targets(per.select("sk", "source", "source_size"), weights, share, most)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long")),
        "mix-plan",
    )
    most_rows = per.agg(F.max("n")).first()[0] or 0

    # descend to the range of keys that holds each source's cut
    cut = plan.filter("rest > 0").select("sk", F.lit("").alias("prefix"), "rest")
    depth = 0
    while most_rows > range_rows and depth < 30:
        depth += DIGITS
        most_rows /= 16**DIGITS
        ranges = _inside(slim, cut).groupBy("sk", F.substring("key", 1, depth).alias("prefix")).agg(F.sum("size").alias("s"), F.first("rest").alias("rest"))
        cut = stored(_at_cut(ranges, "prefix", "s").select("sk", "prefix", "rest"), "mix-cut")
    rows = _inside(slim, cut).groupBy("sk", "key").agg(F.sum("size").alias("s"), F.first("rest").alias("rest"))
    edge = _at_cut(rows, "key", "s").select("sk", F.col("key").alias("cut_key"), F.col("rest").alias("cut_rest"), F.col("s").alias("cut_size"))
    table = stored(plan.join(edge, "sk", "left").select("sk", "source_size", "target", "epochs", "cut_key", "cut_rest", "cut_size"), "mix-table")
    side, at = free_name(docs, "mix_sk"), free_name(docs, "mix_plan")
    size, key, plan_of = F.col(names["size"]), F.col(names["key"]), F.col(at)
    part = F.expr(f"`{names['size']}` * `{at}`.cut_rest div `{at}`.cut_size")  # the row at the cut
    extra = F.when(plan_of["cut_key"].isNull() | (key > plan_of["cut_key"]), 0).when(key < plan_of["cut_key"], size).otherwise(part).cast("long")
    plans = table.select(F.col("sk").alias(side), F.struct("source_size", "target", "epochs", "cut_key", "cut_rest", "cut_size").alias(at))
    return with_key.join(plans, F.col(names["sk"]) == F.col(side)).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        size.alias(names["size"]),
        plan_of["source_size"].alias(names["source_size"]),
        plan_of["target"].alias(names["target"]),
        (plan_of["epochs"] * size + extra).alias(names["taken"]),
    )


def apply(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: docs without the rows that it leaves out, and each other row once an epoch that takes it.

    Adds the columns of mix(), where taken is what this copy gives, and epoch from 0
    (names get underscores before them if docs has them). A copy gives its whole text;
    only the row at a source's cut gives less, the first taken words of it. Rows without
    words are left out, an empty table gives an empty one.
    """
    size, taken, epoch = free_name(docs, "size"), free_name(docs, "taken"), free_name(docs, "epoch")
    mixed = mix(docs, **kw).filter(F.col(taken) > 0)
    last = F.ceil(F.col(taken) / F.col(size)) - 1
    each = mixed.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return each.withColumn(taken, F.least(size, F.col(taken) - F.col(epoch) * F.col(size)))


def _inside(slim: DataFrame, cut: DataFrame) -> DataFrame:
    """The rows whose key lies in the range that holds their source's cut."""
    c = cut.select(F.col("sk").alias("_csk"), F.col("prefix").alias("_cp"), "rest")
    return slim.join(c, F.col("sk") == F.col("_csk")).filter("startswith(key, _cp)").select("sk", "key", "size", "rest")


def _at_cut(ranges: DataFrame, by: str, size: str) -> DataFrame:
    """For each source, the range in which the running sum passes rest, and what is left for it."""
    run = F.sum(size).over(Window.partitionBy("sk").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = ranges.withColumn("_run", run)
    return r.filter(f"_run > rest and _run - {size} <= rest").withColumn("rest", F.col("rest") - (F.col("_run") - F.col(size)))
