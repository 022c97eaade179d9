"""Labels of words and sub-tokens: schemes, checks, alignment, split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from .order import numbered

#: Tokens that get no label.
UNLABELLED = (",", ".", "!", "?", ";", ":", "-", "(", ")", "'", '"', "``", "''")
IGNORED = -100


def bio(df: DataFrame, keys: Sequence[str], tag: str = "tag", order: str = "unit_no") -> DataFrame:
    """df with bio: O stays, a tag like the one before it becomes I-, any other B-."""
    before = F.lag(tag).over(Window.partitionBy(*keys).orderBy(order))
    t = F.col(tag)
    return df.withColumn("bio", F.when(t == "O", "O").when(t == before, F.concat(F.lit("I-"), t)).otherwise(F.concat(F.lit("B-"), t)))


def violations(df: DataFrame, keys: Sequence[str], label: str = "label", order: str = "unit_no") -> DataFrame:
    """Rows whose I- label is the first, or follows a label that doesn't end with the same name."""
    before = F.lag(label).over(Window.partitionBy(*keys).orderBy(order))
    x = F.col(label)
    marked = df.withColumn("_before", before)
    return marked.filter(x.startswith("I-") & (F.col("_before").isNull() | ~F.endswith(F.col("_before"), F.substring(x, 3, 1 << 20)))).drop("_before")


def invalid(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels outside the eleven."""
    valid = schema.labels(df.sparkSession).select(F.col("label").alias("_valid"))
    return df.select(F.col(label).alias("label")).distinct().join(F.broadcast(valid), F.col("label") == F.col("_valid"), "left_anti")


def align(subs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """subs (unit_no, piece_no, token, label of the word) with aligned ids.

    Marks get -100; a word's first piece its label; later pieces I- of a B- label,
    else O. After a mark a word starts anew, even amid its pieces.
    """
    order = Window.partitionBy(*keys, "unit_no").orderBy("piece_no")
    ignored = F.col("token").isin(*UNLABELLED)
    first = F.col("piece_no") == 0
    anew = first | F.lag(ignored).over(order)
    inside = F.when(F.col("label").startswith("B-"), schema.label_id(F.concat(F.lit("I-"), F.substring("label", 3, 100)))).otherwise(0)
    return subs.withColumn("aligned", F.when(ignored, IGNORED).when(anew, schema.label_id(F.col("label"))).otherwise(inside))


def counts(df: DataFrame) -> DataFrame:
    """Labels of each class: b, i, total."""
    base = T.base_label(F.col("label"))
    return df.groupBy(base.alias("base")).agg(F.count_if(F.col("label").startswith("B-")).alias("b"), F.count_if(F.col("label").startswith("I-")).alias("i"), F.count("*").alias("total"))


def class_counts(df: DataFrame) -> DataFrame:
    n = df.groupBy(T.metric_class(F.col("label")).alias("class")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "class")))


def unit_hash(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def train_val_split(df: DataFrame, key: str, val: float = 0.2, seed: int = 42, few: int = 4096) -> DataFrame:
    """df with split: exactly int(n * (1 - val)) rows are train, in the order of a seeded hash; a null key counts as empty text.

    The cut is found by counting hash ranges, as a global order would put all rows in
    one task: 4096 ranges, then 4096 parts of the one that holds the cut, until its
    hashes are few. Of rows whose equal keys meet the cut, as many as are wanted are train.
    """
    h = df.withColumn("_h", unit_hash(F.col(key), seed))
    n = df.count()
    want = int(n * (1 - val))
    cut, more = "", want
    if want >= n:
        return h.withColumn("split", F.lit("train")).drop("_h")
    inside = h
    for digits in (3, 6, 9, 12, 32):
        at = _passing(inside.groupBy(F.substring("_h", 1, digits).alias("p")).agg(F.count("*").alias("c")), "p", more)
        cut, more = at["p"], more - (at["run"] - at["c"])
        if digits == 32:
            break
        inside = h.filter(F.col("_h").startswith(cut))
        if at["c"] <= few:
            at = _passing(inside.groupBy(F.col("_h").alias("p")).agg(F.count("*").alias("c")), "p", more)
            cut, more = at["p"], more - (at["run"] - at["c"])
            break
    named = h.withColumn("split", F.when(F.col("_h") < cut, "train").otherwise("val"))
    if more:
        tied = numbered(h.filter(F.col("_h") == cut), name="_no")
        tied = tied.withColumn("split", F.when(F.col("_no") <= more, "train").otherwise("val")).drop("_no")
        named = named.filter(F.col("_h") != cut).unionByName(tied)
    return named.drop("_h")


def _passing(counts: DataFrame, by: str, want: int):
    """The row of counts at which the running sum of c passes want, with the sum as run; few rows, so the window is small."""
    run = F.sum("c").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("run", run).filter(F.col("run") > want).orderBy(by).first()
