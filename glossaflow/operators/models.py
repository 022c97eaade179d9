"""Model folders: weights, vocabulary, labels and metadata, fetched once an executor."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..session import get_text
from ..sources import readers
from . import analysis, taggers

WEIGHTS, VOCABULARY, LABELS, METADATA = "model.onnx", "vocab.txt", "config.json", "metadata.json"


class Folder:
    """A folder with model.onnx, vocab.txt, and config.json or metadata.json (id2label, max_len).

    Any store that Spark reaches. Executors fetch it once (SparkFiles), and their workers
    open the weights by path, so that the runtime may map the file; nothing is broadcast.
    Labels are told apart by name: the model's ids may have any order, and names beyond the
    eleven are unknown, as the taggers treat them. A missing folder, or one without
    weights, vocabulary or labels, is an error.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = self.path.rsplit("/", 1)[1]
        found = {n: get_text(spark, f"{self.path}/{n}") for n in (LABELS, METADATA)}
        if found[LABELS] is None and found[METADATA] is None:
            raise FileNotFoundError(f"{self.path}: neither {LABELS} nor {METADATA}")
        config = {k: v for n in (METADATA, LABELS) if found[n] for k, v in json.loads(found[n]).items()}
        self.max_len = int(config.get("max_len", 128))
        self.labels = {int(k): str(v) for k, v in config["id2label"].items()}
        self.vocabulary = readers.vocabulary(spark, f"{self.path}/{VOCABULARY}")
        spark.sparkContext.addFile(self.path, recursive=True)

    def tagger(self, batch: int = 8) -> _FolderTagger:
        return _FolderTagger(self, batch)


class _FolderTagger(taggers.OnnxTagger):
    """The model of a folder; label_ids are those of the eleven labels, -1 for others."""

    def __init__(self, folder: Folder, batch: int):
        super().__init__(b"", batch)
        self.folder = folder

    def source(self, spark: SparkSession):
        name = self.folder.name
        return lambda: f"{SparkFiles.get(name)}/{WEIGHTS}"

    def __call__(self, encoded: DataFrame) -> DataFrame:
        known = {x[1]: x[0] for x in schema.LABELS}
        size = max(self.folder.labels, default=-1) + 1
        ids = F.array(*[F.lit(known.get(self.folder.labels.get(i, ""), -1)) for i in range(size)])
        df = super().__call__(encoded)
        return df.withColumn("label_ids", F.transform("label_ids", lambda i: F.coalesce(F.get(ids, i), F.lit(-1))))


def analyze(docs: DataFrame, keys: Sequence[str], folder: Folder, **more) -> DataFrame:
    """analysis.analyze() with a folder's vocabulary, model and length."""
    return analysis.analyze(docs, keys, folder.vocabulary, folder.tagger(), max_len=folder.max_len, **more)
