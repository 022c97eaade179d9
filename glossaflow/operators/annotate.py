"""From texts to entities: sentences, units, labels, phrases.

All steps take and give DataFrames; ``keys`` names the columns that identify a text.
Sentences and units are made inside the row, and so are phrases where the labels come
from a Column (:func:`phrases`): then nothing is shuffled. Labels that come as rows, from
a join or a model, need one shuffle by (keys, sent_no) (:func:`entities`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import arrow, text as T
from ..functions.arrays import blocks, cut, let, running
from ..session import dealt


def _cut(df: DataFrame, keys: Sequence[str], text: str, clean: bool) -> tuple[DataFrame, Column]:
    """A row for each text, and the array of its sentences as a Column of those rows."""
    c = F.coalesce(F.col(text), F.lit(""))
    df = dealt(df.select(*keys, text)).select(*keys, (T.sanitize(c) if clean else c).alias("_clean"))
    df = df.select(*keys, T.sentence_heads(F.col("_clean")).alias("_heads"), T.sentence_tail(F.col("_clean")).alias("_tail"))
    return df, T.join_sentences(F.col("_heads"), F.col("_tail"))


def sentence_lists(df: DataFrame, keys: Sequence[str], text: str = "text", clean: bool = True) -> DataFrame:
    """(keys, sentences): a row for each text, its sentences in an array.

    A filter on the array would be pushed down to the scan and split each text there again.
    """
    df, listed = _cut(df, keys, text, clean)
    return df.select(*keys, listed.alias("sentences"))


def sentences(df: DataFrame, keys: Sequence[str], text: str = "text", clean: bool = True) -> DataFrame:
    """(keys, sent_no from 1, sentence).

    The array is no column before it is exploded: of a column, Spark infers a filter on its
    size, and pushes that down with all that makes it.
    """
    df, listed = _cut(df, keys, text, clean)
    return df.select(*keys, F.posexplode(listed).alias("_at", "sentence")).select(*keys, (F.col("_at") + 1).alias("sent_no"), "sentence")


def unit_list(s: Column, most: int | None = None) -> Column:
    """The units of a sentence in order (the first most, if that is given), as (unit, start_c, end_c, start_b, end_b): places in code points and bytes, ends exclusive."""
    return arrow.placed_units(s, most)


def units(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    """df with a row for each unit: unit_no from 0, unit, is_mark and its place in code points and bytes, ends exclusive.

    Drop the sentence from the result where it isn't needed: else each unit carries it.
    """
    placed_units = df.select(*df.columns, F.posexplode(unit_list(F.col(sentence))).alias("unit_no", "_u"))
    return placed_units.select(*df.columns, "unit_no", "_u.*").withColumn("is_mark", T.is_mark(F.col("unit")))


def phrase_list(words: Column, chars: bool = False) -> Column:
    """The phrases of a sentence's labelled words, inside the row; words and result are arrays.

    The rule is that of :func:`entities`. A word that doesn't go on with the one before it
    begins a phrase.
    """
    made = arrow.phrases(words, "c" if chars else "b")
    return F.filter(made, lambda p: p["base"] != "O") if chars else made


def phrases(sents: DataFrame, tagger: Callable[[Column], Column], keep: Callable[[Column], Column], chars: bool = False) -> DataFrame:
    """The phrases of sentences without any shuffle: all but the sentence of sents, ent_no from 1 and the columns of :func:`entities`.

    tagger makes an array of units with label and base of an array of units, and keep
    tells of a unit whether it counts as a word; it is asked after the labelling.
    """
    rest = [c for c in sents.columns if c != "sentence"]
    words = F.filter(tagger(unit_list(F.col("sentence"))), lambda x: keep(x["unit"]))
    out = sents.select(*rest, F.posexplode(phrase_list(words, chars)).alias("_at", "_p"))
    return out.select(*rest, (F.col("_at") + 1).cast("long").alias("ent_no"), "_p.*").withColumn("type_ru", T.type_name(F.col("type")))


def contexts(sents: DataFrame, tagger: Callable[[Column], Column], keep: Callable[[Column], Column]) -> DataFrame:
    """All of sents with (type_ru, text): a row for each distinct phrase of a sentence, lower-cased, beside the sentence itself; nothing is shuffled.

    The phrases are those of phrases(), and the rows those of stats.item_contexts() where
    keys are unique.
    """
    words = F.filter(tagger(unit_list(F.col("sentence"))), lambda x: keep(x["unit"]))
    named = F.transform(phrase_list(words), lambda p: F.struct(T.type_name(p["type"]).alias("type_ru"), F.lower(p["text"]).alias("text")))
    return sents.select(*sents.columns, F.explode(F.array_distinct(named)).alias("_p")).select(*sents.columns, "_p.*").filter("text <> '' and type_ru <> ''")


def entities(words: DataFrame, keys: Sequence[str], chars: bool = False) -> DataFrame:
    """Phrases of labelled words: (keys, sent_no, ent_no from 1, text, type, base, start_b, end_b, start_c, end_c, sentence).

    A word goes on with the phrase before it if its label is I- of the same base and
    the gap is at most 2: bytes, with phrases of O words as well, or (chars) code
    points, without them. words has label, base and the places of units; the phrases
    have a sentence if words do, and with_sentences() adds it later otherwise.
    """
    by = [*keys, "sent_no"]
    order = Window.partitionBy(*by).orderBy("unit_no")
    unit = "c" if chars else "b"
    gap = F.col(f"start_{unit}") - F.lag(f"end_{unit}").over(order)
    goes_on = F.col("label").startswith("I-") & (F.col("base") == F.lag("base").over(order)) & gap.between(0, 2)
    marked = words.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("ent_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if chars:
        marked = marked.filter("base <> 'O'")
    word = F.struct("unit_no", "unit")
    out = marked.groupBy(*by, "ent_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["unit"]), " ").alias("text"),
        F.min_by("label", "unit_no").alias("type"),
        F.min_by("base", "unit_no").alias("base"),
        F.min("start_b").alias("start_b"),
        F.max("end_b").alias("end_b"),
        F.min("start_c").alias("start_c"),
        F.max("end_c").alias("end_c"),
        *([F.first("sentence").alias("sentence")] if "sentence" in words.columns else []),
    )
    if chars:
        out = out.withColumn("ent_no", F.row_number().over(Window.partitionBy(*by).orderBy("ent_no")).cast("long"))
    return out.withColumn("type_ru", T.type_name(F.col("type")))


def with_sentences(rows: DataFrame, sents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows (keys, sent_no, …) with their sentence."""
    by = [*keys, "sent_no"]
    return rows.join(sents.select(*by, "sentence"), by)


def structure(ents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entities by category in a sentence's fixed order: (…, cat_no, pos, text, type_ru)."""
    rank = F.array_position(F.array(*[F.lit(b) for b in schema.STRUCTURE]), F.col("base"))
    order = Window.partitionBy(*keys, "sent_no").orderBy("cat_no", "start_c")
    return ents.filter("base <> 'O'").withColumn("cat_no", rank).withColumn("pos", F.row_number().over(order))


def markup(ents: DataFrame, keys: Sequence[str], sents: DataFrame | None = None) -> DataFrame:
    """A sentence as a stream of pieces: single characters of the gaps (no white space) and entities with their roles.

    Entities that end at or before what is shown already, or past the sentence, are
    skipped; all of this happens inside the sentence's row. sents is needed where ents
    don't carry their sentence.
    """
    by = [*keys, "sent_no"]
    item = F.struct("ent_no", "start_c", "end_c", "type_ru")
    listed = F.array_sort(F.collect_list(item)).alias("e")
    rows = ents.groupBy(*by).agg(F.first("sentence").alias("sentence"), listed) if sents is None else with_sentences(ents.groupBy(*by).agg(listed), sents, keys)
    kind = "array<struct<piece:string,kind:string,type_ru:string>>"

    def gap(text, a, b):
        chars = F.filter(F.split(cut(text, a, b), ""), lambda x: (x != "") & ~x.rlike(f"^{T.ANY_SPACE}$"))
        return F.transform(chars, lambda x: F.struct(x.alias("piece"), F.lit("gap").alias("kind"), F.lit("").alias("type_ru"))).cast(kind)

    def pieces(held):
        text, size = held["text"], held["size"]
        ends = F.transform("e", lambda e: F.when(e["end_c"] <= size, e["end_c"]).otherwise(0))
        marked = F.arrays_zip(F.col("e").alias("e"), running(ends, lambda a, b: F.greatest(a, b)).alias("at"))

        def each(z):
            e, at = z["e"], z["at"]
            word = F.struct(cut(text, e["start_c"], e["end_c"]).alias("piece"), F.lit("entity").alias("kind"), e["type_ru"].alias("type_ru"))
            shown = F.when((e["end_c"] > at) & (e["end_c"] <= size), F.array(word)).otherwise(F.array()).cast(kind)
            return F.concat(gap(text, at, e["start_c"]), shown)

        return F.concat(F.flatten(F.transform(marked, each)), gap(text, F.coalesce(F.array_max(ends), F.lit(0)), size))

    out = rows.select(*by, F.posexplode(let(F.struct(blocks(F.col("sentence")).alias("text"), F.length("sentence").cast("long").alias("size")), pieces)).alias("piece_no", "p"))
    return out.select(*by, "piece_no", "p.*").withColumn("role", F.when(F.col("kind") == "entity", T.role(F.col("type_ru"))).otherwise(""))
