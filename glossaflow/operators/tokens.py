"""Vocabulary, WordPiece and encoding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..functions.arrays import running
from ..session import ship, stored
from . import annotate, trie
from .order import numbered

#: A vocabulary above this is not broadcast to every worker, but joined.
MAX_VOCABULARY = 1_000_000
MAX_WORD_BYTES = 100


def vocabulary(units: DataFrame, least: int = 3) -> DataFrame:
    """(token, id): frequent units, all characters and their ## forms by code point, after the special tokens; written once."""
    words = units.select(T.cyrillic_lower(F.col("unit")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = stored(words, "vocabulary-words")  # asked for three times
    chars = words.select(F.explode(F.split("w", "")).alias("token")).filter("token <> ''").distinct()
    tokens = words.filter(F.col("n") >= least).select(F.col("w").alias("token")).unionByName(chars).unionByName(chars.select(F.concat(F.lit("##"), "token").alias("token"))).distinct()
    tokens = tokens.filter(~F.col("token").isin(*[t for _, t in schema.SPECIAL]))
    ranked = numbered(tokens, ["token"], "id", schema.SEP + 1)
    special = units.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.lit(i).cast("long").alias("id")) for i, t in schema.SPECIAL])).alias("x")).select("x.*")
    return stored(special.unionByName(ranked), "vocabulary")


def split_word(word: str, known: set[str]) -> list[str]:
    """Greedy longest match from the left; one [UNK] for a word that is too long or does not come out."""
    if len(word.encode("utf-8", "surrogatepass")) > MAX_WORD_BYTES:
        return ["[UNK]"]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in known:
                out.append(piece)
                at = end
                break
        else:
            return ["[UNK]"]
    return out or ["[UNK]"]


_SPLIT = "struct<pieces:array<string>,ids:array<bigint>>"


def _split(words: pd.Series, ids_of) -> pd.DataFrame:
    """Pieces and ids of each word; ids_of gives a word's known pieces with their ids."""
    pieces = [split_word(w, known) for w, known in ((w, ids_of(i, w)) for i, w in enumerate(words))]
    ids = [[ids_of(i, w).get(p, schema.UNK) for p in ps] for i, (w, ps) in enumerate(zip(words, pieces))]
    return pd.DataFrame({"pieces": pieces, "ids": ids})


def wordpiece(words: DataFrame, vocab: DataFrame, word: str = "word") -> DataFrame:
    """words with pieces and ids (arrays). Call it with distinct words: texts repeat them a lot.

    Of tokens that stand twice in vocab the last id counts. Up to MAX_VOCABULARY tokens
    are a trie in a file that the executors map; more are joined with each word's
    candidate pieces.
    """
    spark = words.sparkSession
    ship(spark)
    if vocab.count() > MAX_VOCABULARY:
        return _joined_pieces(words, vocab.groupBy("token").agg(F.max("id").alias("id")), word)
    name, unknown_id = _published(vocab)
    unknown = ["[UNK]"], [unknown_id]

    def split(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shared = trie.opened(name)
        for batch in batches:
            done = [(len(w.encode("utf-8", "surrogatepass")) <= MAX_WORD_BYTES and w and shared.split(w)) or unknown for w in batch]
            yield pd.DataFrame({"pieces": [p for p, _ in done], "ids": [i for _, i in done]})

    split.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return words.withColumn("_split", F.pandas_udf(split, _SPLIT)(F.col(word))).select(*words.columns, "_split.*")


def _published(vocab: DataFrame) -> tuple[str, int]:
    """The name of a vocabulary's trie for workers, and the id of [UNK]; once for each stored vocabulary."""
    key = (vocab.sparkSession.sparkContext.applicationId, getattr(vocab, "_glossaflow_path", None))
    if key[1] is None or key not in _tries:
        table = vocab.groupBy("token").agg(F.max("id").alias("id")).toArrow()
        known = dict(zip(table.column("token").to_pylist(), table.column("id").to_pylist()))
        _tries[key] = trie.publish(vocab.sparkSession, known.items()), known.get("[UNK]", schema.UNK)
    return _tries[key]


_tries: dict[tuple, tuple[str, int]] = {}


def _joined_pieces(words: DataFrame, ids: DataFrame, word: str) -> DataFrame:
    """As wordpiece(), by a join of each word's candidate pieces with the vocabulary: no task holds more than a word's own pieces."""

    def candidates(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda w: sorted({("##" if i else "") + w[i:j] for i in range(len(w)) for j in range(i + 1, len(w) + 1)}) if len(w.encode("utf-8", "surrogatepass")) <= MAX_WORD_BYTES else [])

    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch, known in batches:
            of = [{} if k is None else {x["token"]: x["id"] for x in k} for k in known]
            yield _split(batch, lambda i, w: of[i])

    candidates.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    split.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    every = words.select(F.col(word).alias("_w")).distinct().withColumn("_piece", F.explode(F.pandas_udf(candidates, "array<string>")("_w")))
    known = every.join(ids.withColumnRenamed("token", "_piece"), "_piece").groupBy("_w").agg(F.collect_set(F.struct(F.col("_piece").alias("token"), "id")).alias("_known"))
    both = words.join(known, F.col(word) == F.col("_w"), "left")
    return both.withColumn("_split", F.pandas_udf(split, _SPLIT)(F.col(word), F.col("_known"))).select(*words.columns, "_split.*")


def subtokens(units: DataFrame, vocab: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each sub-token: (keys, sent_no, unit_no, piece_no, token, id, start_b, end_b, start_c, end_c, err).

    Units are lower-cased (Cyrillic) and split inside their rows, each distinct word of a
    batch once; above MAX_VOCABULARY tokens, by distinct word and joined back. Places in
    bytes and code points follow from the unit's; an [UNK] has none and err 1.
    """
    df = units.withColumn("word", T.cyrillic_lower(F.col("unit")))
    spark = units.sparkSession
    ship(spark)
    if vocab.count() <= MAX_VOCABULARY:
        pieces = F.arrow_udf(_piece_lists(*_published(vocab)), _PIECES).asNondeterministic()(F.array("word"))
        rows = df.withColumn("_p", pieces).select(*keys, "sent_no", "unit_no", "start_b", "start_c", F.posexplode(F.get("_p", F.lit(0))).alias("piece_no", "p"))
        known = F.col("p.b").isNotNull()
        places = [(F.col(f"start_{k[-1]}") + F.col(f"p.{f}")).alias(k) for k, f in (("start_b", "b"), ("end_b", "end_b"), ("start_c", "c"), ("end_c", "end_c"))]
        return rows.select(*keys, "sent_no", "unit_no", "piece_no", "p.token", "p.id", *places, F.when(known, 0).otherwise(1).alias("err"))
    split = wordpiece(df.select("word").distinct(), vocab)

    def placed(pieces):
        plain = F.transform(pieces, lambda t, i: F.when(i > 0, F.substring(t, 3, 1 << 30)).otherwise(t))

        def starts(size):
            return running(F.transform(plain, lambda t: size(t).cast("long")))

        return F.transform(F.arrays_zip(pieces.alias("token"), plain.alias("plain"), F.col("ids").alias("id"), starts(F.octet_length).alias("b"), starts(F.length).alias("c")), one)

    def one(z):
        known = z["token"] != "[UNK]"
        b, c = F.col("start_b") + z["b"], F.col("start_c") + z["c"]
        places = {"start_b": b, "end_b": b + F.octet_length(z["plain"]), "start_c": c, "end_c": c + F.length(z["plain"])}
        return F.struct(z["token"].alias("token"), z["id"].alias("id"), *[F.when(known, v).alias(k) for k, v in places.items()], F.when(known, 0).otherwise(1).alias("err"))

    rows = df.join(split, "word").select(*keys, "sent_no", "unit_no", F.posexplode(placed(F.col("pieces"))).alias("piece_no", "p"))
    return rows.select(*keys, "sent_no", "unit_no", "piece_no", "p.*")


_PIECES = "array<array<struct<token:string,id:bigint,b:bigint,end_b:bigint,c:bigint,end_c:bigint>>>"


def _piece_lists(name: str, unknown: int):
    """An Arrow function: the words of sentences to each word's pieces, with places in the word, null for [UNK]. A batch's distinct words are split once."""
    import numpy as np
    import pyarrow as pa

    def run(words: pa.Array) -> pa.Array:
        shared = trie.opened(name)
        coded = words.flatten().dictionary_encode()
        rows, sizes = [], []
        for w in coded.dictionary.to_pylist():
            found = shared.split(w) if w and len(w.encode("utf-8", "surrogatepass")) <= MAX_WORD_BYTES else None
            sizes.append(len(found[0]) if found else 1)
            if found is None or found[0] == ["[UNK]"]:
                rows.append(("[UNK]", found[1][0] if found else unknown, None, None, None, None))
                continue
            b = c = 0
            for k, (token, i) in enumerate(zip(*found)):
                plain = token[2:] if k else token
                rows.append((token, i, b, b + len(plain.encode("utf-8", "surrogatepass")), c, c + len(plain)))
                b, c = rows[-1][3], rows[-1][5]
        size = np.array(sizes, np.int64)
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        many = size[at] if len(at) else np.zeros(0, np.int64)
        where = pa.array(np.repeat((np.cumsum(size) - size)[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum())) if len(at) else np.zeros(0, np.int64))
        kinds = [pa.string(), *[pa.int64()] * 5]
        columns = [pa.array(list(c), k).take(where) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
        pieces = pa.StructArray.from_arrays(columns, ["token", "id", "b", "end_b", "c", "end_c"])
        inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), pieces)
        lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), inner)

    run.__annotations__ = {"words": pa.Array, "return": pa.Array}
    return run


def encode_sentences(sents: DataFrame, vocab: DataFrame, keys: Sequence[str], max_len: int = 128, pad: bool = True) -> DataFrame:
    """encode() of sentences (keys, sent_no, sentence), inside their rows: no unit leaves its sentence, and nothing is shuffled.

    Only the first max_len - 2 units of a sentence are split, as each gives a token or
    more. Above MAX_VOCABULARY tokens the units go as rows, by subtokens().
    """
    spark = sents.sparkSession
    ship(spark)
    if vocab.count() > MAX_VOCABULARY:
        return encode(subtokens(annotate.units(sents).drop("sentence"), vocab, keys), keys, max_len, pad)
    name, unknown = _published(vocab)
    split = F.arrow_udf(_piece_lists(name, unknown), _PIECES).asNondeterministic()  # worked out once, before any filter on its results
    df = sents.select(*keys, "sent_no", annotate.unit_list(F.col("sentence"), max_len - 2).alias("_u"))
    df = df.withColumn("_p", split(F.transform("_u", lambda u: T.cyrillic_lower(u["unit"]))))

    def token(u):
        return lambda x: F.struct(
            x["token"].alias("token"),
            x["id"].alias("id"),
            F.when(x["b"].isNull(), 1).otherwise(0).alias("err"),
            *[(u[f"start_{k}"] + x[f]).alias(n) for n, k, f in (("start_b", "b", "b"), ("end_b", "b", "end_b"), ("start_c", "c", "c"), ("end_c", "c", "end_c"))],
            F.when(x["token"].startswith("##"), 0).otherwise(1).cast("long").alias("new"),
        )

    rows = F.flatten(F.zip_with("_u", "_p", lambda u, p: F.transform(p, token(u))))
    return _framed(df.select(*keys, "sent_no", F.slice(rows, 1, max_len - 2).alias("s")), [*keys, "sent_no"], max_len, pad)


def encode(subs: DataFrame, keys: Sequence[str], max_len: int = 128, pad: bool = True) -> DataFrame:
    """(keys, sent_no, tokens, input_ids, word_ids, and places of each token, err, attention_mask).

    [CLS], at most max_len - 2 sub-tokens, [SEP], and padding unless pad is false; special
    tokens have places (0, 0) and no word. Sentences are cut before they are collected.
    """
    by = [*keys, "sent_no"]
    at = F.row_number().over(Window.partitionBy(*by).orderBy("unit_no", "piece_no"))
    df = subs.withColumn("_at", at).filter(F.col("_at") <= max_len - 2)
    row = F.struct("_at", "token", "id", "err", "start_b", "end_b", "start_c", "end_c", F.when(F.col("token").startswith("##"), 0).otherwise(1).cast("long").alias("new"))
    return _framed(df.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("s")), by, max_len, pad)


def _framed(df: DataFrame, by: Sequence[str], max_len: int, pad: bool) -> DataFrame:
    """The arrays of encode() from a sentence's tokens s."""

    def framed(middle, first, last, fill):
        whole = F.concat(F.array(first), middle, F.array(last))
        return F.concat(whole, F.array_repeat(fill, F.lit(max_len - 2) - F.size("s"))) if pad else whole

    def ids(x: int):
        return F.lit(x).cast("long")

    words = F.zip_with("s", running(F.transform("s", lambda x: x["new"])), lambda x, n: (n + x["new"] - 1).cast("int"))
    places = {c: framed(F.transform("s", lambda x: F.coalesce(x[c], F.lit(0)).cast("long")), ids(0), ids(0), ids(0)) for c in ("start_b", "end_b", "start_c", "end_c")}
    df = df.select(
        *by,
        framed(F.transform("s", lambda x: x["token"]), F.lit("[CLS]"), F.lit("[SEP]"), F.lit("[PAD]")).alias("tokens"),
        framed(F.transform("s", lambda x: x["id"]), ids(schema.CLS), ids(schema.SEP), ids(schema.PAD)).alias("input_ids"),
        framed(words, F.lit(-1), F.lit(-1), F.lit(-1)).alias("word_ids"),
        *[v.alias(k) for k, v in places.items()],
        F.when(F.size("s") == 0, 2).when(F.exists("s", lambda x: x["err"] == 1), 1).otherwise(0).alias("err"),
    )
    return df.withColumn("attention_mask", F.transform("input_ids", lambda x: F.when(x != schema.PAD, 1).otherwise(0)))


def decode(tokens) -> F.Column:
    """Text of a token array: specials go, ## pieces are glued, all else is set apart by spaces."""
    plain = F.filter(tokens, lambda t: ~t.isin("[CLS]", "[SEP]", "[PAD]"))
    return F.replace(F.array_join(plain, " "), F.lit(" ##"), F.lit(""))


def merge_subwords(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words of labelled sub-tokens: a ## piece goes on with the word before it.

    (keys, sent_no, word_no from 1, word, start_b, end_b, main_label, has_b): the main
    label is the first B-, else the first I-, else the first.
    """
    by = [*keys, "sent_no"]
    order = Window.partitionBy(*by).orderBy("unit_no", "piece_no")
    df = labelled.withColumn("word_no", F.sum(F.when(F.col("token").startswith("##"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.when(F.col("label").startswith("B-"), 0).when(F.col("label").startswith("I-"), 1).otherwise(2)
    text = F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "piece_no", "token"))), lambda x: F.regexp_replace(x["token"], "^##", ""))
    return df.groupBy(*by, "word_no").agg(
        F.array_join(text, "").alias("word"),
        F.min("start_b").alias("start_b"),
        F.max("end_b").alias("end_b"),
        F.min_by("label", F.struct(rank.alias("r"), "unit_no", "piece_no")).alias("main_label"),
        F.bool_or(F.col("label").startswith("B-")).alias("has_b"),
    )


def drop_special(df: DataFrame, unknown: bool = False) -> DataFrame:
    """df without [CLS], [SEP] and [PAD]; with unknown also without [UNK] and tokens of no width at 0."""
    df = df.filter(~F.col("token").isin("[CLS]", "[SEP]", "[PAD]"))
    return df.filter((F.col("token") != "[UNK]") & ~((F.col("start_b") == 0) & (F.col("end_b") == 0))) if unknown else df


def repair_offsets(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Ends before starts are swapped; a token at (0, 0) goes if one before it ends elsewhere."""
    before = F.lag("end_b").over(Window.partitionBy(*keys).orderBy(order))
    lost = (F.col("start_b") == 0) & (F.col("end_b") == 0) & (F.coalesce("_before", F.lit(0)) != 0)
    fixed = df.withColumns({"start_b": F.least("start_b", "end_b"), "end_b": F.greatest("start_b", "end_b")}).withColumn("_before", before)
    return fixed.filter(~lost).drop("_before")
