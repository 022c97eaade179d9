"""Stages that give units their labels; the model itself is replaceable."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T


class Tagger(Protocol):
    def __call__(self, units: DataFrame) -> DataFrame:
        """units with label_id, label and base."""


def named(df: DataFrame, unknown: str | None = None) -> DataFrame:
    """df with label and base of label_id; unknown ids are left out, or get a label."""
    label = schema.label_name(F.col("label_id"))
    df = df.withColumn("label", F.coalesce(label, F.lit(unknown)) if unknown else label)
    return (df if unknown else df.filter("label is not null")).withColumn("base", T.base_label(F.col("label")))


def rule(shift: int = 0) -> Column:
    """Arithmetic on a unit's length and place: a stand-in for a model, without any linguistic claim."""
    return ((F.length("unit") * 7 + F.col("unit_no") * 3 + shift) % len(schema.LABELS)).cast("int")


class RuleTagger:
    def __init__(self, shift: int = 0):
        self.shift = shift

    def __call__(self, units: DataFrame) -> DataFrame:
        return named(units.withColumn("label_id", rule(self.shift)))

    def in_row(self, units: Column) -> Column:
        """The same over the array of a sentence's units: each with label and base."""

        def one(x: Column, i: Column) -> Column:
            at = ((F.length(x["unit"]) * 7 + i * 3 + self.shift) % len(schema.LABELS)).cast("int")
            return x.withField("label", schema.label_name(at)).withField("base", schema.label_base(at))

        return F.transform(units, one)


class GoldTagger:
    """Labels from a table of (keys, unit_no, label); units without one are O, and of several the first by name counts."""

    def __init__(self, gold: DataFrame, keys: list[str]):
        self.gold, self.keys = gold, keys

    def __call__(self, units: DataFrame) -> DataFrame:
        gold = self.gold.groupBy(*self.keys, "unit_no").agg(F.min("label").alias("_gold"))
        df = units.join(gold, [*self.keys, "unit_no"], "left").withColumn("label_id", schema.label_id(F.coalesce("_gold", F.lit("O")))).drop("_gold")
        return named(df)


def argmax(scores: Column) -> Column:
    """Index of the largest score; the first one of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


class RuleTokenTagger:
    """Arithmetic on a token's length and place: a stand-in for a model over encoded sentences. Adds label_ids."""

    def __call__(self, encoded: DataFrame) -> DataFrame:
        return encoded.withColumn("label_ids", F.transform("tokens", lambda t, i: ((F.length(t) * 7 + i * 3) % len(schema.LABELS)).cast("int")))


class OnnxTagger:
    """Runs a token classification model over (input_ids, attention_mask) arrays, in batches.

    The session is made once a Python worker; rows whose labels are needed carry the
    arrays that :func:`.tokens.encode` makes. Adds logits (array of arrays) and
    label_ids, the place of each largest one. A model that doesn't load, or hasn't two
    inputs and one output, gives null logits, and what was wrong in model_error.
    """

    def __init__(self, model: bytes, batch: int = 8):
        self.model, self.batch = model, batch

    def source(self, spark):
        """What a worker calls for the weights, as bytes or as a path."""
        shared = spark.sparkContext.broadcast(self.model)
        return lambda: shared.value

    def __call__(self, encoded: DataFrame) -> DataFrame:
        from ..session import ship

        ship(encoded.sparkSession)
        weights, size = self.source(encoded.sparkSession), self.batch

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import onnxruntime
            import pandas as pd

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            error, session, names = None, None, []
            try:
                session = onnxruntime.InferenceSession(weights(), options)
                names = [i.name for i in session.get_inputs()]
                if (len(names), len(session.get_outputs())) != (2, 1):
                    error = f"{len(names)} inputs and {len(session.get_outputs())} outputs"
            except Exception as e:  # noqa: BLE001  the runtime has many kinds
                error = f"{type(e).__name__}: {e}"
            for ids, mask in batches:
                made = [None] * len(ids)
                for at in range(0, len(ids), size) if error is None else ():
                    x = np.stack(ids.iloc[at : at + size]).astype(np.int64)
                    m = np.stack(mask.iloc[at : at + size]).astype(np.float32)
                    made[at : at + size] = session.run(None, dict(zip(names, (x, m))))[0].tolist()
                yield pd.DataFrame({"logits": made, "error": [error] * len(made)})

        import pandas as pd

        run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
        kind = "struct<logits:array<array<float>>,error:string>"
        df = encoded.withColumn("_model", F.pandas_udf(run, kind)("input_ids", "attention_mask"))
        df = df.select(*encoded.columns, F.col("_model.logits").alias("logits"), F.col("_model.error").alias("model_error"))
        return df.withColumn("label_ids", F.transform("logits", argmax))
