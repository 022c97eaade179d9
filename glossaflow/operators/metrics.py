"""Evaluation of predicted against true labels.

Everything after the confusion counts works on 36 rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..functions.arrays import let, running
from ..session import put_text


def base_class(label: Column) -> Column:
    return T.metric_class(label)


def _classes(df: DataFrame, name: str, no: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias(no), F.lit(c).alias(name)) for i, c in enumerate(schema.CLASSES)])
    return df.sparkSession.range(1).select(F.explode(rows).alias("x")).select("x.*")


def confusion(pairs: DataFrame) -> DataFrame:
    """(true_class, pred_class, n) for all 6 x 6 cells, from rows of true_label and pred_label."""
    n = pairs.groupBy(base_class(F.col("true_label")).alias("true_class"), base_class(F.col("pred_label")).alias("pred_class")).agg(F.count("*").alias("n"))
    cells = _classes(pairs, "true_class", "true_no").join(F.broadcast(_classes(pairs, "pred_class", "pred_no")))
    return cells.join(n, ["true_class", "pred_class"], "left").select("true_class", "pred_class", F.coalesce("n", F.lit(0)).alias("n"))


def normalized(cells: DataFrame) -> DataFrame:
    """cells with the share of their row; empty rows stay 0."""
    row = F.sum("n").over(Window.partitionBy("true_class"))
    return cells.withColumn("share", F.round(F.coalesce(F.try_divide("n", F.nullif(row, F.lit(0))), F.lit(0.0)), 6))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))


def per_class(cells: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of the classes that occur in the truth."""
    hit = F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(0)
    t = cells.groupBy(F.col("true_class").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    p = cells.groupBy(F.col("pred_class").alias("class")).agg(F.sum("n").alias("predicted"))
    df = t.join(p, "class").filter("support > 0").withColumn("precision", _ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", _ratio(F.col("tp"), F.col("support")))
    return df.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "precision", "recall", "f1", "support")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def ranked(classes: DataFrame) -> DataFrame:
    """classes by f1, best first; equals in the fixed order of classes."""
    place = F.array_position(F.array(*[F.lit(c) for c in schema.CLASSES]), F.col("class"))
    return classes.withColumn("rank", F.row_number().over(Window.orderBy(F.round("f1", 6).desc(), place)))


def weighted(classes: DataFrame) -> DataFrame:
    return classes.agg(*[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in ("precision", "recall", "f1")], F.sum("support").alias("support"))


def macro(classes: DataFrame, include_o: bool = True) -> DataFrame:
    """Means over the classes, and the best and the worst by f1 with their gap."""
    place = F.array_position(F.array(*[F.lit(c) for c in schema.CLASSES]), F.col("class"))
    rivals = F.lit(True) if include_o else F.col("class") != "O"
    f1 = F.round("f1", 6)
    best = F.min_by(F.when(rivals, F.col("class")), F.when(rivals, F.struct((-f1).alias("f"), place.alias("p"))))
    worst = F.min_by(F.when(rivals, F.col("class")), F.when(rivals, F.struct(f1.alias("f"), place.alias("p"))))
    gap = F.max(F.when(rivals, F.col("f1"))) - F.min(F.when(rivals, F.col("f1")))
    return classes.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), best.alias("best"), worst.alias("worst"), gap.alias("gap"))


def spans_of_words(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tokens (keys, pos from 0, word, label) of texts that join words by one space, with their places start and end."""
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("word") + 1).over(before) - 1
    return tokens.withColumn("end", end).withColumn("start", F.col("end") - F.length("word"))


def align_gold(predicted: DataFrame, gold: DataFrame, keys: Sequence[str], at: str = "start_c") -> DataFrame:
    """predicted (keys, start_c, …) with the label of the gold span [start, end) that holds start_c, O if there is none.

    Spans of a text don't overlap, so the last one that starts at or before a place is
    the only one that can hold it: one window over both, however long the text.
    """
    spans = gold.select(*keys, F.col("start").cast("long").alias("_at"), F.lit(0).alias("_side"), F.struct(F.col("end").cast("long").alias("end"), "label").alias("_span"))
    rows = predicted.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in predicted.columns]).alias("_row"))
    order = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = spans.unionByName(rows, allowMissingColumns=True).withColumn("_last", F.last("_span", ignorenulls=True).over(order)).filter("_side = 1")
    true = F.when(F.col("_at") < F.col("_last.end"), F.col("_last.label")).otherwise("O")
    return both.select("_row.*", F.coalesce(true, F.lit("O")).alias("true_label"))


#: A word of a labelled text: a run of anything but white space of any kind.
_WORD = T.ANY_SPACE.replace("[", "[^", 1) + "++"


def _placed(x: Column) -> Column:
    """Places of words w that follow gaps g."""
    begin = running(F.zip_with(x["g"], x["w"], lambda g, w: (F.length(g) + F.length(w)).cast("long")))
    zipped = F.arrays_zip(x["g"].alias("g"), x["w"].alias("w"), begin.alias("at"))
    return F.transform(zipped, lambda z: F.struct((z["at"] + F.length(z["g"])).alias("start"), (z["at"] + F.length(z["g"]) + F.length(z["w"])).alias("end")))


def gold_spans(texts: DataFrame, keys: Sequence[str], text: str = "text", tags: str = "tags") -> DataFrame:
    """(keys, start, end, label) of each word of texts whose tags, an array, are as many as their words."""
    gaps = F.regexp_extract_all(text, F.lit(f"({T.ANY_SPACE}*+){_WORD}"), F.lit(1))
    words = let(F.struct(gaps.alias("g"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("w")), _placed)
    rows = texts.select(*keys, F.col(tags).alias("_tags"), words.alias("_words")).filter(F.size("_words") == F.size("_tags"))
    return rows.select(*keys, F.explode(F.arrays_zip("_words", "_tags")).alias("x")).select(*keys, "x._words.start", "x._words.end", F.col("x._tags").alias("label"))


def collect_pairs(tokens: DataFrame, texts: DataFrame, keys: Sequence[str], text: str = "text", tags: str = "tags") -> DataFrame:
    """Rows (keys, pos, pred_label, true_label): the predicted labels of tokens beside the gold ones.

    tokens: (keys, pos from 0, start_c, pred_label); texts: (keys, text, tags). A token's
    gold label is that of the word that its start lies in. In a text with more or fewer
    tags than words, tags go by position instead. What has no tag is O, and so is a
    label, gold or predicted, that isn't one of the eleven.
    """
    n_words = F.regexp_count(F.col(text), F.lit(_WORD))
    odd = texts.select(*keys, F.when(n_words != F.size(tags), F.col(tags)).alias("_by_pos"))
    placed = align_gold(tokens, gold_spans(texts, keys, text, tags), keys)
    true = F.when(F.col("_by_pos").isNotNull(), F.coalesce(F.get("_by_pos", F.col("pos").cast("int")), F.lit("O"))).otherwise(F.col("true_label"))
    known = [x[1] for x in schema.LABELS]
    both = placed.join(odd, list(keys)).select(*keys, "pos", F.col("pred_label"), true.alias("true_label"))
    return both.withColumns({c: F.when(F.col(c).isin(*known), F.col(c)).otherwise("O") for c in ("pred_label", "true_label")})


def masked_pairs(encoded: DataFrame, keys: Sequence[str], predicted: str = "label_ids", true: str = "true_ids", mask: str = "attention_mask") -> DataFrame:
    """Rows (keys, pos, pred_id, true_id) of arrays of a sequence's length, where its mask is 1."""
    zipped = F.arrays_zip(F.col(predicted).alias("p"), F.col(true).alias("t"), F.col(mask).alias("m"))
    rows = encoded.select(*keys, F.posexplode(zipped).alias("pos", "x")).filter("x.m = 1")
    return rows.select(*keys, "pos", F.col("x.p").alias("pred_id"), F.col("x.t").alias("true_id"))


def report(classes: DataFrame, n_tokens: int, path: str | None = None) -> str:
    """Text table of the classes (six rows at most reach the driver), written to path if there is one."""
    rows = ranked(classes).orderBy("rank").collect()
    lines = [f"Tokens: {n_tokens}", f"{'class':<12}{'precision':>10}{'recall':>10}{'f1':>10}{'support':>10}"]
    text = "\n".join(lines + [f"{r['class']:<12}{r['precision']:>10.4f}{r['recall']:>10.4f}{r['f1']:>10.4f}{r['support']:>10}" for r in rows])
    if path:
        put_text(classes.sparkSession, path, text + "\n", overwrite=True)
    return text
