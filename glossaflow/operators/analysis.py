"""The composed analysis: texts to sentences with their entities, by a model over encoded sentences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import arrow, text as T
from ..session import stored
from . import annotate, taggers, tokens

TokenTagger = Callable[[DataFrame], DataFrame]


def merged_words(tagged: DataFrame, keys: Sequence[str], unknown: str | None = None) -> DataFrame:
    """Words of encoded and labelled sentences: (keys, sent_no, unit_no, start_b, end_b, label, base).

    Special tokens go, ids without a label go or get the label unknown, places are
    repaired, and ## pieces go on with the word before them.
    """
    by = [*keys, "sent_no"]
    zipped = F.arrays_zip(F.col("tokens").alias("token"), F.col("label_ids").alias("label_id"), F.col("start_b").alias("start_b"), F.col("end_b").alias("end_b"))
    rows = tagged.select(*by, F.posexplode(zipped).alias("unit_no", "x")).select(*by, "unit_no", "x.*").withColumn("piece_no", F.lit(0))
    pieces = tokens.repair_offsets(taggers.named(tokens.drop_special(rows), unknown), by, "unit_no")
    words = tokens.merge_subwords(pieces, keys)
    return words.select(*by, F.col("word_no").alias("unit_no"), "word", "start_b", "end_b", F.col("main_label").alias("label"), T.base_label(F.col("main_label")).alias("base"))


def analyze(docs: DataFrame, keys: Sequence[str], vocab: DataFrame, tagger: TokenTagger, text: str = "text", clean: bool = True, max_len: int = 128, unknown: str | None = None) -> DataFrame:
    """A row for each sentence of each text: keys and the fields of schema.SENTENCE_RESULT.

    tagger adds label_ids to encoded sentences (see :mod:`.taggers`). err is 1 where a
    token is not in the vocabulary, 2 where a sentence has no token: such sentences have
    no tokens, labels and entities, and the others go on. Entities have places in bytes.
    Sentences are encoded inside their rows, once, and so are their entities made: nothing
    is shuffled.
    """
    by = [*keys, "sent_no"]
    sents = annotate.sentences(docs, keys, text, clean)
    encoded = tokens.encode_sentences(sents.withColumn("_text", F.col("sentence")), vocab, [*keys, "_text"], max_len)
    encoded = stored(encoded, "analysis-encoded")  # tagged and untagged sentences are read from it
    zipped = F.arrays_zip(F.col("tokens").alias("token"), F.col("label_ids").alias("label_id"), "start_b", "end_b")
    tagged = tagger(encoded.filter("err = 0")).withColumn("_e", arrow.token_phrases(zipped, F.col("_text"), unknown))
    listed = F.transform("_e", lambda x: F.struct(x["text"].alias("text"), x["type"].alias("type"), T.type_name(x["type"]).alias("type_ru"), x["start_b"].cast("int").alias("start"), x["end_b"].cast("int").alias("end")))
    kind = "array<struct<text:string,type:string,type_ru:string,start:int,end:int>>"

    def empty(of: str) -> Column:
        return F.array().cast(of)

    good = tagged.select(*by, F.col("_text").alias("text"), listed.cast(kind).alias("entities"), "tokens", F.col("label_ids").alias("token_labels"), F.lit(0).cast("smallint").alias("err"))
    none = [empty(kind).alias("entities"), empty("array<string>").alias("tokens"), empty("array<int>").alias("token_labels")]
    bad = encoded.filter("err <> 0").select(*by, F.col("_text").alias("text"), *none, F.col("err").cast("smallint").alias("err"))
    whole = good.unionByName(bad)
    if vocab.count() > tokens.MAX_VOCABULARY:  # there a sentence without any unit has no row
        left = sents.join(encoded.select(*by), by, "left_anti")
        whole = whole.unionByName(left.select(*by, F.col("sentence").alias("text"), *none, F.lit(2).cast("smallint").alias("err")))
    return whole


def strict(results: DataFrame) -> DataFrame:
    """results, of which the first sentence with an error ends the job when they are read."""
    failed = F.raise_error(F.concat(F.lit("sentence not encoded: "), F.col("text"))).cast("smallint")
    return results.withColumn("err", F.when(F.col("err") != 0, failed).otherwise(F.col("err")))


def phrases(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The entities of analyze() as rows: (keys, sent_no, ent_no from 1, text, type, type_ru, start_b, end_b, sentence)."""
    rows = results.select(*keys, "sent_no", F.col("text").alias("sentence"), F.posexplode("entities").alias("_at", "e"))
    return rows.select(*keys, "sent_no", (F.col("_at") + 1).alias("ent_no"), "e.text", "e.type", "e.type_ru", F.col("e.start").alias("start_b"), F.col("e.end").alias("end_b"), "sentence")
