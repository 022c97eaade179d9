"""Sources: text files, labelled sets, vocabularies, label configurations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import takewhile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..session import DEALT

#: Fixed value: the largest text file that is accepted.
MAX_BYTES = 300 * 1024


def _tasks(files: DataFrame) -> int:
    """Tasks for small files by their bytes: a scan takes a file for 4 MB at least, and would make a task of a few of them."""
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-size // DEALT))


def text_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, size, state, text): whole files; the first failing check names the state.

    'suffix', 'size', 'utf8' (not valid, or with a replacement character) or 'ok';
    text is null unless it is ok. Wrong names and sizes are judged by the listing, and
    their content is never read.
    """
    files = spark.read.format("binaryFile").load(path)
    named = F.lower("path").endswith(".txt")
    small = F.col("length") <= MAX_BYTES
    listed = files.filter(~(named & small)).select("path", F.col("length").alias("size"), F.when(~named, "suffix").otherwise("size").alias("state"), F.lit(None).cast("string").alias("text"))
    s = F.col("content").cast("string")
    ok = F.is_valid_utf8(s) & ~s.contains("\ufffd")
    read = files.filter(named & small).select("path", F.col("length").alias("size"), F.when(ok, "ok").otherwise("utf8").alias("state"), F.when(ok, s).alias("text"))
    return read.coalesce(_tasks(files)).unionByName(listed.coalesce(_tasks(files)))


def accepted_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """text_files that are ok; name and size are filtered at the source, before any content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").load(path)
    s = F.col("content").cast("string")
    return files.filter(F.col("length") <= MAX_BYTES).filter(F.is_valid_utf8(s) & ~s.contains("�")).select("path", s.alias("text")).coalesce(_tasks(files))


def typed_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """df with clean and state of typed texts; blank ones are left out."""
    df = df.filter(F.trim(F.regexp_replace(text, T.SPACE, " ")) != "").withColumn("clean", T.sanitize(F.col(text)))
    return df.withColumn("state", T.validity(F.col("clean"), F.col(text)))


def typed(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(doc_id, text, clean, state) of texts from a keyboard; blank ones are left out."""
    rows = [(i, t) for i, t in enumerate(texts) if t.strip()]
    return typed_lines(spark.createDataFrame(rows, "doc_id long, text string"))


def _until(lines: DataFrame, keys: Sequence[str], at: str, stop: Column) -> DataFrame:
    """The lines of each session before the first that stop holds for; sessions are told by keys, and one session's lines share a task."""
    first = F.min(F.when(stop, F.col(at))).over(Window.partitionBy(*keys))
    df = lines.withColumn("_stop", first)
    return df.filter(F.col("_stop").isNull() | (F.col(at) < F.col("_stop"))).drop("_stop")


def lines_until_blank(lines: DataFrame, keys: Sequence[str], at: str, text: str = "text") -> DataFrame:
    """Lines of many consoles (keys, at, text): those before a session's first empty line."""
    return _until(lines, keys, at, F.col(text) == "")


def lines_until_quit(lines: DataFrame, keys: Sequence[str], at: str, text: str = "text") -> DataFrame:
    """Lines of many consoles, stripped and without blank ones, before a session's first exit, quit or q in any case."""
    bare = F.regexp_replace(text, rf"^{T.SPACE}+|{T.SPACE}+$", "")
    return _until(lines.withColumn(text, bare), keys, at, F.lower(text).isin("exit", "quit", "q")).filter(F.col(text) != "")


def until_blank(texts: Iterable[str]) -> Iterator[str]:
    """Texts of a console, up to the first empty line."""
    return takewhile(lambda t: t != "", texts)


def until_quit(texts: Iterable[str]) -> Iterator[str]:
    """Stripped texts of a console, up to exit, quit or q in any case; blank ones are left out."""
    stripped = (t.strip() for t in texts)
    return (t for t in takewhile(lambda t: t.lower() not in ("exit", "quit", "q"), stripped) if t)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): the stripped, non-blank lines of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("text")).filter("text <> ''")


def whole_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(text): each file as one row; a missing path is an error."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("value").alias("text")).coalesce(_tasks(files))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """(tokens, tags, text) of JSON arrays of samples, a file each; unequal lengths go, and nothing left is an error."""
    df = spark.read.schema(schema.LABELED).option("multiLine", True).json(path)
    df = df.filter(F.size("tokens") == F.size("tags")).withColumn("text", F.array_join("tokens", " "))
    if df.isEmpty():
        raise ValueError("no labelled samples")
    return df


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id): one token a line, blank lines take no id; of equal tokens the last id counts.

    Several files are numbered one after another, by name; each is a row at first, and a
    row for each of them tells where its numbers begin.
    """
    rows = F.filter(F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, r"[\r\n]+$", "")), lambda x: x != "")
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), rows.alias("tokens"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    begins = files.select("file", F.size("tokens").alias("n")).select(F.col("file").alias("at"), F.coalesce(before, F.lit(0)).alias("begin"))
    df = files.join(F.broadcast(begins), F.col("file") == F.col("at")).select("begin", F.posexplode("tokens").alias("id", "token"))
    return df.groupBy("token").agg(F.max(F.col("begin") + F.col("id")).cast("long").alias("id"))


def label_config(spark: SparkSession, path: str) -> DataFrame:
    """(label_id, label, type_ru) of a configuration's id2label; empty if the file is missing or not valid."""
    empty = spark.createDataFrame([], "label_id int, label string, type_ru string")
    try:
        df = spark.read.text(path, wholetext=True).select(F.from_json("value", "id2label map<string,string>").alias("c"))
        df = df.select(F.explode("c.id2label").alias("k", "label")).select(F.col("k").try_cast("int").alias("label_id"), "label").filter("label_id is not null")
        return df.withColumn("type_ru", T.type_name(F.col("label"))) if not df.isEmpty() else empty
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise


def blank_labels(spark: SparkSession, path: str) -> DataFrame:
    """(tokens, tags): a sample with empty tags for each line of more than one character."""
    words = F.split(F.trim("value"), " ")
    return spark.read.text(path).filter(F.length("value") > 0).select(words.alias("tokens"), F.transform(words, lambda _: F.lit("")).alias("tags"))


def asset(path: str | None) -> str:
    """A template, style or script of a page; empty if the file is missing or not readable."""
    try:
        return Path(path).read_text(encoding="utf-8") if path else ""
    except (OSError, UnicodeDecodeError):
        return ""
