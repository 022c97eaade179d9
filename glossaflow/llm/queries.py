"""The contract queries opN_<name>: thin digests of the operators' own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, html, langid, linededup, linekeep, media, mixing, pii, ppm, quality, simhash, tokenalign
from .common import read_table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    filters = langid.fit(docs.filter(~held).select("text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_share").alias("share"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"), out="spans")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose a passage: what is cut, by original offsets."""
    parts = linededup.passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    per = parts.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"), F.sum("words").alias("n_words"))
    spans = F.transform("s", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return per.select("doc_id", F.size("s").cast("long").alias("n_spans"), "n_words", F.array_join(spans, ",").alias("spans"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ppm.score_corpus(docs, ~langid.held_out(F.col("doc_id"), fold=1))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = quality.classify(docs, quality.fit(docs, quality.labelled_sample(docs, labels)))
    return found.select("doc_id", "quality", F.col("toxic").alias("toxic_score"), (F.col("toxic") >= 0.5).alias("toxic"), "keep")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    # a member that stays unreadable must not pass for a result
    payload = F.when(F.col("error").isNull(), F.col("payload")).otherwise(F.raise_error(F.col("error")).cast("binary"))
    rows = rows.withColumn("payload", payload)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_linekeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linekeep.apply(docs, linekeep.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_tokenalign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenalign.align(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- parts of the results above that SQL can express, over the same whole tables


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in pii.KINDS])


def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that each document loses as whole lines that stand earlier."""
    parts = linededup.passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"), least_run=None)
    return parts.groupBy("doc_id").agg(F.sum("words").cast("long").alias("n_words"))


def word_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_ppm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    contract = (op1_langid, op2_mixing, op3_pii, op4_linededup, op5_html, op6_ppm, op7_quality, op8_simhash, op9_decontaminate, op10_media, op11_centroids, op12_linekeep, op13_tokenalign)
    return {f.__name__: f for f in (*contract, pii_counts, dedup_lines, word_model, media_payloads)}
