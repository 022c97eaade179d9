"""Named queries over the tables; each has SQL of the same result in :mod:`.oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import arrow, text as T
from ..operators import analysis, annotate, index, labels, metrics, progress, punkt, search, stats, taggers, tokens, viterbi
from ..session import dealt, fresh_path
from ..sources import readers, writers
from ..streaming import annotate as streams, counts

TURN = ["conv_id", "turn"]
BY = [*TURN, "sent_no"]
NEEDLE = "re"
#: Literal rows for rules on Cyrillic, beside those of the tables.
SAMPLES = ("Привет МИР", "ЁЛКА Ї І Є ABC", "plain text", "смесь mixed ТЕКСТ", "", "Ӂ ӂ", "день—ночь")
#: The tables have no Cyrillic, so their lower-case letters become capitals of it for the rules on case.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyzàéüß", "АБЦДЕФГХИЙКЛМНОПЯРСТУВЩЫЧЗЁІЄЇ"


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in SAMPLES])).alias("i", "s")).select(long("i").alias("i"), "s")


def _docs(spark, d):
    return dealt(table(spark, d, "documents").select("doc_id", "lang", "text"))


def _conv(spark, d):
    return dealt(table(spark, d, "conversations").select(*TURN, "text"))


def _sents(spark, d):
    return annotate.sentences(table(spark, d, "conversations").select(*TURN, "text"), TURN)


def _units(spark, d):
    return annotate.units(_sents(spark, d)).drop("sentence")


def _words(spark, d, shift=0):
    return taggers.RuleTagger(shift)(_units(spark, d).filter("not is_mark"))


def _ents(spark, d):
    return annotate.phrases(_sents(spark, d), taggers.RuleTagger().in_row, lambda u: ~T.is_mark(u))


def _items(spark, d):
    return stats.item_counts(_ents(spark, d), TURN)


# --- texts and sentences


def sentence_word_stats(spark, d):
    listed = annotate.sentence_lists(table(spark, d, "documents").select("lang", "text"), ["lang"])
    words = F.aggregate("sentences", F.lit(0).cast("long"), lambda n, s: n + T.count_words(s))
    counts = listed.select("lang", long(F.size("sentences")).alias("n"), words.alias("words"))
    return counts.groupBy("lang").agg(F.sum("n").alias("sentences"), F.sum("words").alias("words")).filter("sentences > 0")


def sanitize_text(spark, d):
    df = _docs(spark, d).withColumn("clean", T.sanitize(F.col("text")))
    return df.select("doc_id", F.md5("clean").alias("clean_md5"), long(F.length("clean")).alias("n"), T.validity(F.col("clean"), F.col("text")).alias("state"))


def preprocess_text(spark, d):
    df = _docs(spark, d).withColumn("clean", T.preprocess(F.col("text")))
    return df.select("doc_id", F.md5("clean").alias("clean_md5"), long(F.length("clean")).alias("n"))


def sentences_regex(spark, d):
    return annotate.sentences(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"]).select("doc_id", long("sent_no").alias("sent_no"), "sentence")


def sentences_scan(spark, d):
    df = _conv(spark, d).select(*TURN, F.posexplode(T.sentences_scan(T.preprocess(F.col("text")))).alias("i", "sentence"))
    return df.select(*TURN, long(F.col("i") + 1).alias("sent_no"), "sentence")


def sentences_dot_fallback(spark, d):
    df = _conv(spark, d).select(*TURN, F.posexplode(T.sentences_dots(T.preprocess(F.col("text")))).alias("i", "sentence"))
    return df.select(*TURN, long(F.col("i") + 1).alias("sent_no"), "sentence")


def _around(spark, d):
    return punkt.neighbours(table(spark, d, "documents").select("text"))


def punkt_neighbours(spark, d):
    pairs = _around(spark, d).filter("before_ending in ('stop', 'ellipsis', 'hard')")
    return pairs.select("type", "ending", F.col("case").alias("letter"), "before", "before_ending", "n")


def punkt_types(spark, d):
    return punkt.types(_around(spark, d)).withColumn("score", F.round("score", 4) + F.lit(0.0))


def _kinds(spark, d):
    pairs = _around(spark, d)
    return pairs, punkt.types(pairs)


def punkt_collocations(spark, d):
    return punkt.collocations(*_kinds(spark, d)).withColumn("score", F.round("score", 3) + F.lit(0.0))


def punkt_starters(spark, d):
    return punkt.starters(punkt.in_context(*_kinds(spark, d))).withColumn("score", F.round("score", 3) + F.lit(0.0))


def sentences_punkt(spark, d):
    df = punkt.split(table(spark, d, "documents").select("doc_id", "text"), punkt.joined_stops(_around(spark, d)), ["doc_id"])
    return df.select("doc_id", long("sent_no").alias("sent_no"), F.md5("sentence").alias("sentence_md5"), long(F.length("sentence")).alias("n"))


def unit_tokens(spark, d):
    # units are counted inside the row first, so fewer rows come to the grouping by document and unit
    df = _docs(spark, d).select("doc_id", F.explode(arrow.unit_counts(T.sanitize(F.col("text")))).alias("x")).select("doc_id", "x.*")
    per = df.groupBy("doc_id", "unit").agg(F.sum("n").alias("n"))
    return per.groupBy("unit").agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs"))


def char_class_profile(spark, d):
    df = _docs(spark, d).select("doc_id", arrow.units(F.col("text")).alias("u"), "text")
    marks = F.size(F.filter("u", lambda x: T.is_mark(x)))
    return df.select(
        "doc_id",
        long(F.size("u")).alias("units"),
        long(marks).alias("marks"),
        long(F.regexp_count("text", F.lit(T.SPACE))).alias("spaces"),
        long(F.length(T.clean_word(F.col("text")))).alias("unmarked_chars"),
        T.is_space(F.substring("text", 1, 1)).alias("blank_first"),
    )


def cyrillic_lower(spark, d):
    df = _conv(spark, d).withColumn("s", F.translate("text", LATIN, CYRILLIC))
    capitals = F.length("s") - F.length(F.translate("s", T.UPPER, ""))
    return df.select(*TURN, F.md5(T.cyrillic_lower(F.col("s"))).alias("lowered"), F.md5(F.lower("s")).alias("folded"), long(capitals).alias("capitals"))


def cyrillic_detect(spark, d):
    text = samples(spark).select(F.lit("sample").alias("kind"), "i", "s")
    docs = _docs(spark, d).select(F.lit("document").alias("kind"), F.col("doc_id").alias("i"), F.col("text").alias("s"))
    return text.unionByName(docs).select("kind", "i", T.has_cyrillic(F.col("s")).alias("cyrillic"))


def string_primitives(spark, d):
    s = F.col("s")
    df = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.concat_ws(" ", "p_name", F.lit("Ёжик"), "p_type").alias("s")).unionByName(samples(spark))
    return df.select(
        "i",
        "s",
        long(F.length(s)).alias("chars"),
        T.char_at(s, 2).alias("third"),
        T.slice_inclusive(s, 1, 4).alias("middle"),
        long(T.find(s, "e")).alias("found"),
        long(T.find(s, "e", 5)).alias("found_later"),
        F.array_join(T.char_offsets(s), ",").alias("offsets"),
        long(T.byte_to_char(s, 6)).alias("at_byte"),
        long(T.symbol_bytes(T.char_at(s, 0))).alias("first_bytes"),
    )


def snippet_truncate(spark, d):
    return _sents(spark, d).select(*TURN, long("sent_no").alias("sent_no"), T.snippet_line(F.col("sent_no"), F.col("sentence")).alias("line"))


def highlight_mark(spark, d):
    df = _conv(spark, d)
    return df.select(*TURN, F.md5(T.highlight(F.col("text"), NEEDLE)).alias("marked_md5"), long(F.regexp_count("text", F.lit("(?iu)" + NEEDLE))).alias("hits"), T.highlight(F.lit("c++ C++ (c)"), "c++").alias("literal"))


def html_escape(spark, d):
    df = table(spark, d, "pages").select("page_id", T.escape_quotes(F.col("html")).alias("e"))
    return df.select("page_id", F.md5("e").alias("escaped_md5"), long(F.length("e")).alias("n"))


def file_sizes(spark, d):
    df = table(spark, d, "pages").select("page_id", long(F.octet_length("html")).alias("bytes"))
    return df.select("page_id", "bytes", T.file_size(F.col("bytes")).alias("mb"), (F.col("bytes") <= 300 * 1024).alias("accepted"))


# --- labels, words, phrases


def label_decode(spark, d):
    df = taggers.RuleTagger()(_units(spark, d)).withColumn("type_ru", T.type_name(F.col("label")))
    n = df.groupBy("label_id", "label", "base", "type_ru").agg(F.count("*").alias("n"))
    return n.select(long("label_id").alias("label_id"), "label", "base", T.metric_class(F.col("label")).alias("metric_class"), "type_ru", T.role(F.col("type_ru")).alias("role"), "n")


def unit_offsets(spark, d):
    return _units(spark, d).select(*TURN, long("sent_no").alias("sent_no"), long("unit_no").alias("unit_no"), "unit", "start_c", "end_c", "start_b", "end_b", "is_mark")


def entities_bytes(spark, d):
    return _ents(spark, d).select(*TURN, long("sent_no").alias("sent_no"), "ent_no", "text", "type", "type_ru", "start_b", "end_b")


def _ents_chars(spark, d):
    return annotate.phrases(_sents(spark, d), taggers.RuleTagger().in_row, lambda u: ~u.isin(*T.PHRASE_PUNCTUATION), chars=True)


def entities_chars(spark, d):
    return _ents_chars(spark, d).select(*TURN, long("sent_no").alias("sent_no"), "ent_no", "text", "type", "start_c", "end_c")


def sentence_structure(spark, d):
    df = annotate.structure(_ents_chars(spark, d), TURN)
    return df.select(*TURN, long("sent_no").alias("sent_no"), long("cat_no").alias("cat_no"), long("pos").alias("pos"), "text", "type_ru")


def markup_stream(spark, d):
    df = annotate.markup(_ents(spark, d), TURN, _sents(spark, d))
    return df.select(*TURN, long("sent_no").alias("sent_no"), long("piece_no").alias("piece_no"), "piece", "kind", "role", (F.col("role") == "подл.").alias("lit"))


def console_by_type(spark, d):
    return stats.by_type(_ents(spark, d), TURN).select(*TURN, long("sent_no").alias("sent_no"), "type_ru", "texts")


# --- counts


def global_stats(spark, d):
    df = stats.global_stats(_sents(spark, d), _ents(spark, d))
    return df.select(*[long(c).alias(c) for c in df.columns])


def category_totals(spark, d):
    return stats.category_totals(_ents(spark, d)).select(long("cat_no").alias("cat_no"), "type_ru", long("n").alias("n"))


def sentence_parts(spark, d):
    return stats.sentence_parts(_ents(spark, d).withColumn("type_ru", F.when(F.col("base") == "ADDITION", "?").otherwise(F.col("type_ru")))).select(long("cat_no").alias("cat_no"), "type_ru", long("n").alias("n"))


def category_share(spark, d):
    return stats.shares(stats.category_totals(_ents(spark, d))).select(long("cat_no").alias("cat_no"), "type_ru", long("n").alias("n"), "share", "percent")


def top_member_per_category(spark, d):
    return stats.top_member(_ents(spark, d)).select(long("cat_no").alias("cat_no"), "type_ru", "top_word", long("top_count").alias("top_count"))


def search_items(spark, d):
    return _items(spark, d).select("type_ru", "text", long("amount").alias("amount"), "n_sentences")


def search_contexts(spark, d):
    return stats.item_contexts(_ents(spark, d), TURN, _sents(spark, d)).select("type_ru", "text", *TURN, long("sent_no").alias("sent_no"), "sentence")


def file_totals(spark, d):
    return stats.file_totals(_sents(spark, d), _ents(spark, d), "conv_id")


# --- search


def _prefix(order: str, needle: str = "", members=schema.CATEGORIES) -> Callable:
    def run(spark, d):
        df = search.prefix_search(_items(spark, d), needle, members, order)
        return df.select("type_ru", "text", "amount", long("rank").alias("rank"))

    return run


def _page(spark, d):
    return search.with_order(_items(spark, d))


def _shown(df):
    return df.select("type_ru", "text", long("original_order").alias("original_order"), "match_type", "visible", long("rank").alias("rank"))


def search_relevance(spark, d):
    return _shown(search.relevance(_page(spark, d), NEEDLE))


def search_relevance_typed(spark, d):
    return _shown(search.relevance(_page(spark, d), "", schema.CATEGORIES[0]))


def search_relevance_again(spark, d):
    """A search for another needle, in the order that the first one left."""
    first = search.relevance(_page(spark, d), NEEDLE).withColumnRenamed("rank", "current").drop("match_type", "visible")
    return _shown(search.relevance(first, "an", current="current"))


def search_prefix_stored(spark, d):
    """The prefix search over items stored by ranges of their text."""
    path = fresh_path(spark, "items-by-text")
    index.write_prefixes(_items(spark, d), path)
    df = index.prefix_search(spark, path, NEEDLE, order="frequency_desc")
    return df.select("type_ru", "text", "amount", long("rank").alias("rank"))


def search_postings(spark, d):
    """The visible items of a search of the saved page, by postings."""
    path = fresh_path(spark, "items-postings")
    index.write_postings(_page(spark, d), path)
    df = index.relevance_search(spark, path, "tion")
    return df.select("type_ru", "text", long("original_order").alias("original_order"), "match_type", long("rank").alias("rank"))


def search_hit_stats(spark, d):
    # the counts need no order
    found = _items(spark, d).withColumn("match_type", search.match_type(NEEDLE))
    df = search.hit_message(search.hit_stats(found), NEEDLE)
    return df.select(long("exact").alias("exact"), long("partial").alias("partial"), long("type_only").alias("type_only"), "message")


def search_reset(spark, d):
    return search.reset(_page(spark, d)).select("type_ru", "text", "visible", long("rank").alias("rank"))


# --- sub-tokens


def _vocab(spark, d):
    return tokens.vocabulary(_units(spark, d))


def _subs(spark, d):
    return tokens.subtokens(_units(spark, d), _vocab(spark, d), TURN)


def vocabulary(spark, d):
    return _vocab(spark, d)


def wordpiece_tokens(spark, d):
    words = _units(spark, d).select(T.cyrillic_lower(F.col("unit")).alias("word")).distinct()
    return tokens.wordpiece(words, _vocab(spark, d)).select("word", F.array_join("pieces", " ").alias("pieces"))


def subtoken_offsets(spark, d):
    df = _subs(spark, d)
    return df.select(*TURN, *[long(c).alias(c) for c in ("sent_no", "unit_no", "piece_no")], "token", "id", long("start_b").alias("start_b"), long("end_b").alias("end_b"), long("err").alias("err"))


def _encoded(spark, d):
    return tokens.encode_sentences(_sents(spark, d), _vocab(spark, d), TURN)


def encode_padded(spark, d):
    df = _encoded(spark, d)
    return df.select(*TURN, long("sent_no").alias("sent_no"), F.array_join("input_ids", " ").alias("ids"), F.array_join("word_ids", " ").alias("word_ids"), long("err").alias("err"))


def attention_mask(spark, d):
    df = _encoded(spark, d)
    return df.select(*TURN, long("sent_no").alias("sent_no"), F.array_join("attention_mask", "").alias("mask"), long(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("n"))


def decode_roundtrip(spark, d):
    return _encoded(spark, d).select(*TURN, long("sent_no").alias("sent_no"), tokens.decode(F.col("tokens")).alias("decoded"))


def encode_unpadded(spark, d):
    df = tokens.encode_sentences(_sents(spark, d), _vocab(spark, d), TURN, pad=False)
    return df.select(*TURN, long("sent_no").alias("sent_no"), long(F.size("input_ids")).alias("n"), F.array_join("input_ids", " ").alias("ids"))


def encode_char_offsets(spark, d):
    df = _encoded(spark, d)
    pairs = F.zip_with("start_c", "end_c", lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string")))
    return df.select(*TURN, long("sent_no").alias("sent_no"), F.array_join(pairs, " ").alias("places"))


def sentence_results(spark, d):
    """The composed analysis, with a stand-in for the model."""
    df = _analysis(spark, d)
    listed = F.transform("entities", lambda e: F.concat_ws("|", e["text"], e["type"], e["type_ru"], e["start"].cast("string"), e["end"].cast("string")))
    labels_ = F.array_join(F.slice("token_labels", 1, F.size(F.filter("tokens", lambda t: t != "[PAD]"))), " ")
    return df.select(*TURN, long("sent_no").alias("sent_no"), "text", long("err").alias("err"), long(F.size("entities")).alias("n"), F.md5(F.array_join(listed, ";")).alias("entities_md5"), labels_.alias("labels"))


def _analysis(spark, d):
    docs = table(spark, d, "conversations").select(*TURN, "text")
    return analysis.analyze(docs, TURN, _vocab(spark, d), taggers.RuleTokenTagger())


def analysis_totals(spark, d):
    """Counts over the phrases of the composed analysis."""
    return stats.category_totals(analysis.phrases(_analysis(spark, d), TURN)).select(long("cat_no").alias("cat_no"), "type_ru", long("n").alias("n"))


def special_tokens_dropped(spark, d):
    df = _encoded(spark, d).select(*BY, F.posexplode("tokens").alias("pos", "token"))
    n = tokens.drop_special(df).groupBy("token").agg(F.count("*").alias("n"))
    return n.select("token", "n")


def unknown_labels(spark, d):
    """Label ids beyond the eleven count as O."""
    ids = ((F.length("unit") * 7 + F.col("unit_no") * 3) % (len(schema.LABELS) + 2)).cast("int")
    df = taggers.named(_units(spark, d).withColumn("label_id", ids), unknown="O")
    return df.groupBy("label").agg(F.count("*").alias("n"))


def offset_repair(spark, d):
    """Units whose places were damaged on purpose: swapped, or set to zero."""
    swapped, zero = F.col("unit_no") % 5 == 0, F.col("unit_no") % 7 == 3
    places = {"start_b": F.when(zero, 0).when(swapped, F.col("end_b")).otherwise(F.col("start_b")), "end_b": F.when(zero, 0).when(swapped, F.col("start_b")).otherwise(F.col("end_b"))}
    df = tokens.repair_offsets(_units(spark, d).withColumns(places), BY, "unit_no")
    return df.select(*TURN, long("sent_no").alias("sent_no"), long("unit_no").alias("unit_no"), "unit", long("start_b").alias("start_b"), long("end_b").alias("end_b"))


def argmax_labels(spark, d):
    """The first values of each embedding stand in for a model's scores of the labels."""
    df = table(spark, d, "embeddings").select("vec_id", taggers.argmax(F.slice("embedding", 1, len(schema.LABELS))).alias("label_id"))
    return df.select("vec_id", long("label_id").alias("label_id"), schema.label_name(F.col("label_id")).alias("label"))


def viterbi_labels(spark, d):
    """The best paths that keep to the label scheme, and the labels without it; five tokens' scores stand in each embedding."""
    n = len(schema.LABELS)
    scores = F.array(*[F.slice("embedding", k * n + 1, n) for k in range(5)])
    df = table(spark, d, "embeddings").select("vec_id", viterbi.best_path(scores, *viterbi.bio_steps()).alias("path"), F.transform(scores, taggers.argmax).alias("free"))
    return df.select("vec_id", F.array_join("path", " ").alias("path"), F.array_join("free", " ").alias("free"))


def analysis_progress(spark, d):
    """Documents that passed a run over their sentences, of all of them."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    follow = progress.Progress(docs, docs.count())
    annotate.sentences(follow.rows, ["doc_id"]).write.format("noop").mode("overwrite").save()
    told = follow.report()
    return table(spark, d, "documents").agg(F.count("*").alias("documents")).select("documents", long(F.lit(told.processed)).alias("processed"), F.lit(told.percent).alias("percent"))


def _labelled_subs(spark, d):
    rule = ((F.length("token") * 7 + F.col("unit_no") * 3 + F.col("piece_no")) % len(schema.LABELS)).cast("int")
    return taggers.named(_subs(spark, d).withColumn("label_id", rule))


def subword_merge(spark, d):
    df = tokens.merge_subwords(_labelled_subs(spark, d), TURN)
    return df.select(*TURN, long("sent_no").alias("sent_no"), "word_no", "word", long("start_b").alias("start_b"), long("end_b").alias("end_b"), "main_label", "has_b")


# --- label schemes


def bio_encode(spark, d):
    df = labels.bio(_words(spark, d).withColumn("tag", F.col("base")), BY)
    return df.select(*TURN, long("sent_no").alias("sent_no"), long("unit_no").alias("unit_no"), "tag", "bio")


def bio_violations(spark, d):
    return labels.violations(_words(spark, d), BY).select(*TURN, long("sent_no").alias("sent_no"), long("unit_no").alias("unit_no"), "label")


def invalid_labels(spark, d):
    odd = _words(spark, d).withColumn("label", F.when(F.col("label_id") == 4, F.concat(F.lit("X-"), "base")).otherwise(F.col("label")))
    return labels.invalid(odd)


def align_subtoken_labels(spark, d):
    word = _words(spark, d).select(*BY, "unit_no", "label")
    df = _subs(spark, d).join(word, [*BY, "unit_no"], "left").withColumn("label", F.coalesce("label", F.lit("O")))
    df = labels.align(df, BY)
    return df.select(*TURN, *[long(c).alias(c) for c in ("sent_no", "unit_no", "piece_no")], "token", long("aligned").alias("aligned"))


def label_counts(spark, d):
    return labels.counts(_words(spark, d))


def base_class_counts(spark, d):
    return labels.class_counts(_words(spark, d)).select("class", "n", long("rank").alias("rank"))


def train_val_split(spark, d):
    return labels.train_val_split(table(spark, d, "labels").select("doc_id"), "doc_id")


# --- metrics


def _pairs(spark, d):
    true = taggers.rule(0)
    df = _units(spark, d).filter("not is_mark").select(true.alias("t"), F.when(F.col("unit_no") % 3 == 0, taggers.rule(2)).otherwise(true).alias("p"))
    return df.select(schema.label_name(F.col("t")).alias("true_label"), schema.label_name(F.col("p")).alias("pred_label")).filter("true_label not like '%PREDICATE'")


def gold_span_align(spark, d):
    sents = _sents(spark, d)
    gold = sents.select(*BY, F.posexplode(F.split("sentence", " ")).alias("pos", "word"))
    rule = ((F.length("word") * 7 + F.col("pos") * 3) % len(schema.LABELS)).cast("int")
    gold = metrics.spans_of_words(gold.withColumn("label", schema.label_name(rule)), BY)
    df = metrics.align_gold(annotate.units(sents).select(*BY, "unit_no", "unit", "start_c"), gold, BY)
    return df.select(*TURN, long("sent_no").alias("sent_no"), long("unit_no").alias("unit_no"), "unit", "true_label")


def _evaluated(spark, d):
    """Gold tags of the words of each sentence; every third conversation lacks its last tag."""
    sents = _sents(spark, d)
    tag = lambda w, i: schema.label_name(((F.length(w) * 7 + i * 3) % len(schema.LABELS)).cast("int"))
    tags = F.transform(F.split("sentence", " "), tag)
    texts = sents.select(*BY, F.col("sentence").alias("text"), F.when(F.col("conv_id") % 3 == 0, F.slice(tags, 1, F.size(tags) - 1)).otherwise(tags).alias("tags"))
    units = annotate.units(sents).select(*BY, F.col("unit_no").alias("pos"), "start_c", F.coalesce(schema.label_name(F.col("pos") % (len(schema.LABELS) + 1)), F.lit("?")).alias("pred_label"))
    return metrics.collect_pairs(units, texts, BY)


def gold_evaluation(spark, d):
    df = _evaluated(spark, d)
    return df.select(*TURN, long("sent_no").alias("sent_no"), long("pos").alias("pos"), "pred_label", "true_label")


def masked_evaluation(spark, d):
    df = taggers.RuleTokenTagger()(_encoded(spark, d))
    df = df.withColumn("true_ids", F.transform("tokens", lambda t, i: ((F.length(t) * 5 + i) % len(schema.LABELS)).cast("int")))
    n = metrics.masked_pairs(df, BY).groupBy("pred_id", "true_id").agg(F.count("*").alias("n"))
    return n.select(long("pred_id").alias("pred_id"), long("true_id").alias("true_id"), "n")


def confusion_matrix(spark, d):
    return metrics.confusion(_pairs(spark, d))


def confusion_normalized(spark, d):
    return metrics.normalized(metrics.confusion(_pairs(spark, d)))


def per_class_prf(spark, d):
    df = metrics.ranked(metrics.per_class(metrics.confusion(_pairs(spark, d))))
    return metrics.rounded(df, "precision", "recall", "f1").withColumn("rank", long("rank"))


def weighted_prf(spark, d):
    return metrics.rounded(metrics.weighted(metrics.per_class(metrics.confusion(_pairs(spark, d)))), "precision", "recall", "f1")


def macro_best_worst(spark, d):
    return metrics.rounded(metrics.macro(metrics.per_class(metrics.confusion(_pairs(spark, d)))), "precision", "recall", "f1", "gap")


# --- sources and sinks: what is written to the shared folder, read back


def _written(spark, df, label: str) -> str:
    path = fresh_path(spark, label)
    df.write.text(path)
    return path


def _page_files(spark, d) -> list[str]:
    """Folders that hold a file for each page: as many as tasks wrote, so that listing them costs little."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("page_id="), "page_id").alias("name"), "html")
    return writers.row_files(pages, fresh_path(spark, "page-files"), "name", "html")


def source_text_files(spark, d):
    df = readers.text_files(spark, _page_files(spark, d))
    return df.select(long(F.regexp_extract("path", r"page_id=([0-9]+)", 1)).alias("page_id"), long("size").alias("size"), "state", F.md5("text").alias("text_md5"))


def source_accepted_files(spark, d):
    df = readers.accepted_files(spark, _page_files(spark, d))
    return df.select(long(F.regexp_extract("path", r"page_id=([0-9]+)", 1)).alias("page_id"), F.md5("text").alias("text_md5"))


def source_whole_texts(spark, d):
    return readers.whole_text(spark, _page_files(spark, d)).select(F.md5("text").alias("text_md5"))


def source_lines(spark, d):
    path = _written(spark, table(spark, d, "conversations").select("text"), "lines")
    return readers.lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


def source_blank_labels(spark, d):
    path = _written(spark, table(spark, d, "conversations").select("text"), "unlabelled")
    df = readers.blank_labels(spark, path)
    return df.groupBy(F.array_join("tokens", "|").alias("tokens"), long(F.size("tags")).alias("tags")).agg(F.count("*").alias("n"))


def _console(spark, d):
    """The lines of each document, as if typed one after another; every 13th by length is a word that ends a session."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.withColumn("text", F.when(F.length("text") % 13 == 5, " Quit ").otherwise(F.col("text")))


def source_typed(spark, d):
    df = readers.typed_lines(_console(spark, d))
    return df.select("doc_id", long("line_no").alias("line_no"), F.md5("clean").alias("clean_md5"), "state")


def source_console_blank(spark, d):
    df = readers.lines_until_blank(_console(spark, d), ["doc_id"], "line_no")
    return df.groupBy("doc_id").agg(F.count("*").alias("n"), long(F.max("line_no")).alias("last"))


def source_console_quit(spark, d):
    df = readers.lines_until_quit(_console(spark, d), ["doc_id"], "line_no")
    return df.groupBy("doc_id").agg(F.count("*").alias("n"), long(F.max("line_no")).alias("last"), F.sum(long(F.length("text"))).alias("chars"))


def source_labelled(spark, d):
    by = [*TURN, "sent_no"]
    one = F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "unit", "label"))), lambda x: F.struct(x["unit"].alias("unit"), x["label"].alias("label")))
    df = taggers.RuleTagger()(_units(spark, d)).groupBy(*by).agg(one.alias("x"))
    tags = F.transform("x", lambda x: x["label"])
    df = df.select(F.transform("x", lambda x: x["unit"]).alias("tokens"), F.when(F.col("turn") % 4 == 0, F.slice(tags, 1, F.size(tags) - 1)).otherwise(tags).alias("tags"))
    path = fresh_path(spark, "labelled")
    writers.dataset_json(df, path)
    return readers.labelled(spark, path).groupBy("text", F.array_join("tags", " ").alias("tags")).agg(F.count("*").alias("n"))


def source_vocabulary(spark, d):
    path = fresh_path(spark, "vocabulary-file")
    writers.vocabulary_text(_vocab(spark, d), path)
    return readers.vocabulary(spark, path)


def source_label_config(spark, d):
    """A configuration of the labels that the conversations' words have, written and read."""
    path = fresh_path(spark, "label-config")
    writers.label_config(_words(spark, d).select("label_id", "label").distinct(), path)
    return readers.label_config(spark, path).select(long("label_id").alias("label_id"), "label", "type_ru")


def sink_results(spark, d):
    path = fresh_path(spark, "results")
    writers.results_json(_sents(spark, d), _ents(spark, d), TURN, path)
    kind = "conv_id long, turn long, input_file string, total_sentences long, total_entities long, results array<struct<sent_no:long,sentence:string,entities:array<struct<text:string,type:string>>>>"
    df = spark.read.schema(kind).json(path).select("*", F.explode("results").alias("r"))
    listed = F.array_join(F.transform("r.entities", lambda e: F.concat_ws(":", e["text"], e["type"])), "|")
    return df.select(*TURN, "input_file", "total_sentences", "total_entities", "r.sent_no", "r.sentence", listed.alias("entities"))


def sink_item_cards(spark, d):
    ents = annotate.with_sentences(_ents(spark, d), _sents(spark, d), TURN)
    items = search.with_order(stats.search_items(ents, TURN))
    return writers.item_rows(items).select(long("original_order").alias("original_order"), F.md5("html").alias("html_md5"))


def sink_listing(spark, d):
    """Sentences of which odd ones' entities are left out, so that many have none."""
    ents = _ents(spark, d).filter("sent_no % 2 = 0")
    return writers.listing(_sents(spark, d), ents, TURN, "No members found").select(*TURN, long("sent_no").alias("sent_no"), "line")


def sink_statistics(spark, d):
    """The numbers of the statistics page, read back out of its cards."""
    folder = fresh_path(spark, "statistics")
    page = writers.statistics_page(_sents(spark, d), _ents(spark, d), folder)
    card = r'<div class="card">([^<:]+): ([0-9]+) \(([0-9.]+) %\), ([^<]*) \(([0-9]+)\)<'
    found = [F.regexp_extract_all("value", F.lit(card), F.lit(k)).alias(n) for k, n in enumerate(("type_ru", "n", "percent", "top_word", "top_count"), 1)]
    totals = F.regexp_extract_all("value", F.lit(r'<div class="card"><b>([0-9]+)</b>'), F.lit(1))
    df = spark.read.text(page, wholetext=True).select(F.explode(F.arrays_zip(*found)).alias("x"), F.array_join(totals, " ").alias("totals"))
    return df.select("totals", "x.type_ru", F.col("x.n").cast("long").alias("n"), F.col("x.percent").cast("double").alias("percent"), "x.top_word", F.col("x.top_count").cast("long").alias("top_count"))


def sink_search_site(spark, d):
    """The lines of all shards of the page that searches any number of items, read back."""
    folder = fresh_path(spark, "site")
    contexts = annotate.contexts(_sents(spark, d), taggers.RuleTagger().in_row, lambda u: ~T.is_mark(u))
    items = stats.word_counts(_ents(spark, d)).select("type_ru", F.col("word").alias("text"), F.col("n").alias("amount"))
    writers.search_site(search.with_order(items), contexts, TURN, folder, lines=1000)
    lines = spark.read.text(f"{folder}/shards", recursiveFileLookup=True)
    kind = F.left("value", F.lit(1))
    return lines.groupBy(kind.alias("kind"), long(F.regexp_extract("value", r"^.\(([0-9]+),", 1)).alias("original_order")).agg(F.count("*").alias("n"), F.md5(F.min("value")).alias("first_md5"), F.md5(F.max("value")).alias("last_md5"))


def sink_report(spark, d):
    """The classes' lines of the text report, read back."""
    path = f"{fresh_path(spark, 'report')}/classification_report.txt"
    metrics.report(metrics.per_class(metrics.confusion(_pairs(spark, d))), 7, path)
    rows = spark.read.text(path).filter(F.col("value").rlike(r" [0-9]+$") & ~F.col("value").startswith("Tokens"))
    part = F.split(F.col("value"), " +")
    return rows.select(part[0].alias("class"), part[1].alias("precision"), part[2].alias("recall"), part[3].alias("f1"), part[4].cast("long").alias("support"))


def lead_bytes(spark, d):
    """What each byte of a name says of the symbol that it begins."""
    df = table(spark, d, "part").select("p_partkey", F.encode(F.concat_ws(" ", "p_name", F.lit("Ёжик—😀")), "UTF-8").alias("b"))
    at = F.transform(F.sequence(F.lit(0), F.length("b") - 1), lambda i: T.lead_bytes(F.col("b"), i).cast("string"))
    return df.select("p_partkey", F.array_join(at, "").alias("widths"))


def _streamed(spark, d):
    """Updates of phrase counts of the conversations, which come as a stream of files."""
    source = table(spark, d, "conversations").select(*TURN, "text")
    inbox, out = fresh_path(spark, "inbox"), fresh_path(spark, "updates")
    source.repartition(3).write.parquet(inbox)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(inbox)
    ents = annotate.phrases(streams.sentences(stream), taggers.RuleTagger().in_row, lambda u: ~T.is_mark(u))
    query = counts.phrase_counts(ents).writeStream.outputMode("update").option("checkpointLocation", fresh_path(spark, "stream-state")).trigger(availableNow=True)
    query.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(out)).start().awaitTermination()
    return spark.read.schema(counts.SCHEMA).parquet(out)


def stream_phrase_counts(spark, d):
    return counts.counted(_streamed(spark, d))


def stream_top_members(spark, d):
    return counts.top_members(_streamed(spark, d)).select(long("cat_no").alias("cat_no"), "type_ru", "top_word", long("top_count").alias("top_count"))


def sink_evaluation(spark, d):
    path = fresh_path(spark, "evaluation")
    cells = metrics.confusion(_pairs(spark, d))
    writers.evaluation(metrics.per_class(cells), cells, path)
    kind = "evaluation_info struct<timestamp:string,date:string>, weighted struct<f1:double,support:long>, macro struct<f1:double,best:string,worst:string>, members_f1 double, confusion array<struct<n:long>>, report string"
    df = spark.read.schema(kind).option("multiLine", True).json(path)
    return df.select(
        F.startswith("evaluation_info.timestamp", F.col("evaluation_info.date")).alias("dated"),
        F.round("weighted.f1", 6).alias("weighted_f1"),
        "weighted.support",
        F.round("macro.f1", 6).alias("macro_f1"),
        "macro.best",
        "macro.worst",
        F.round("members_f1", 6).alias("members_f1"),
        long(F.aggregate("confusion", F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("cells_total"),
        long(F.size(F.split("report", "\n"))).alias("report_lines"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        sentence_word_stats, sanitize_text, preprocess_text, sentences_regex, sentences_scan, sentences_dot_fallback, punkt_neighbours, punkt_types, punkt_collocations, punkt_starters, sentences_punkt, unit_tokens, char_class_profile, cyrillic_lower,
        cyrillic_detect, string_primitives, snippet_truncate, highlight_mark, html_escape, file_sizes, label_decode, unit_offsets, entities_bytes, entities_chars,
        sentence_structure, markup_stream, console_by_type, global_stats, category_totals, sentence_parts, category_share, top_member_per_category, search_items,
        file_totals, search_relevance, search_relevance_typed, search_hit_stats, search_reset, vocabulary, wordpiece_tokens, subtoken_offsets, encode_padded, attention_mask,
        decode_roundtrip, offset_repair, argmax_labels, viterbi_labels, analysis_progress, subword_merge, bio_encode, bio_violations, invalid_labels, align_subtoken_labels, label_counts, base_class_counts, train_val_split,
        search_contexts, search_relevance_again, search_prefix_stored, search_postings, encode_unpadded, encode_char_offsets, sentence_results, analysis_totals, special_tokens_dropped, unknown_labels, gold_evaluation, masked_evaluation,
        source_text_files, source_accepted_files, source_whole_texts, source_lines, source_blank_labels, source_typed, source_console_blank, source_console_quit, source_labelled, source_vocabulary, source_label_config,
        sink_results, sink_item_cards, sink_listing, sink_evaluation, sink_statistics, sink_search_site, sink_report, lead_bytes, stream_phrase_counts, stream_top_members, gold_span_align, confusion_matrix, confusion_normalized, per_class_prf, weighted_prf, macro_best_worst,
    )
    found = {f.__name__: f for f in named}
    found["search_prefix_alpha_asc"] = _prefix("alphabet_asc", NEEDLE)
    found["search_prefix_alpha_desc"] = _prefix("alphabet_desc", NEEDLE)
    found["search_prefix_freq_desc"] = _prefix("frequency_desc", NEEDLE, schema.CATEGORIES[:2])
    found["search_prefix_freq_asc"] = _prefix("frequency_asc", NEEDLE, schema.CATEGORIES[5:])
    found["search_prefix_no_member"] = _prefix("alphabet_asc", NEEDLE, ())
    return found
