"""Streams of texts: cleaning and sentences need no state; counts run in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def sentences(texts: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of texts, sent_no and sentence; the same for streams and tables."""
    others = [c for c in texts.columns if c != text]
    df = texts.select(*others, T.sanitize(F.coalesce(F.col(text), F.lit(""))).alias("_clean"))
    df = df.select(*others, T.sentence_heads(F.col("_clean")).alias("_heads"), T.sentence_tail(F.col("_clean")).alias("_tail"))
    return df.select(*others, F.posexplode(T.join_sentences(F.col("_heads"), F.col("_tail"))).alias("_at", "sentence")).select(*others, (F.col("_at") + 1).alias("sent_no"), "sentence")


def window_counts(texts: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Sentences and words of each window of event time; rows later than the watermark are left out."""
    sents = sentences(texts.withWatermark(ts, late))
    return sents.groupBy(F.window(ts, size)).agg(F.count("*").alias("sentences"), F.sum(T.count_words(F.col("sentence"))).alias("words"))
