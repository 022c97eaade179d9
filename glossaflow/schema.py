"""Types and the label taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id, label, base, Russian name, short role.
LABELS = (
    (0, "O", "O", "другое", "др."),
    (1, "B-ADVERBIAL", "ADVERBIAL", "обстоятельство", "обст."),
    (2, "I-ADVERBIAL", "ADVERBIAL", "обстоятельство", "обст."),
    (3, "B-SUBJECT", "SUBJECT", "подлежащее", "подл."),
    (4, "I-SUBJECT", "SUBJECT", "подлежащее", "подл."),
    (5, "B-PREDICATE", "PREDICATE", "сказуемое", "сказ."),
    (6, "I-PREDICATE", "PREDICATE", "сказуемое", "сказ."),
    (7, "B-DEFINITION", "DEFINITION", "определение", "опр."),
    (8, "I-DEFINITION", "DEFINITION", "определение", "опр."),
    (9, "B-ADDITION", "ADDITION", "дополнение", "доп."),
    (10, "I-ADDITION", "ADDITION", "дополнение", "доп."),
)
#: Order of the categories on screen, and of the classes in metrics.
CATEGORIES = ("подлежащее", "сказуемое", "дополнение", "определение", "обстоятельство", "другое")
CLASSES = ("O", "ADVERBIAL", "SUBJECT", "PREDICATE", "DEFINITION", "ADDITION")
#: Order of the categories in a sentence's structure.
STRUCTURE = ("SUBJECT", "PREDICATE", "ADVERBIAL", "ADDITION", "DEFINITION")
#: Messages of the saved page's search.
SAID = {"exact": " точных совпадений", "partial": " частичных совпадений", "type_only": " по типу", "none": "❌ Ничего не найдено", "found": "✅ Найдено: "}
CLS, SEP, PAD, UNK = 101, 102, 0, 100
SPECIAL = ((PAD, "[PAD]"), (UNK, "[UNK]"), (CLS, "[CLS]"), (SEP, "[SEP]"))

SENTENCE_RESULT = (
    "doc_id long, sent_no int, text string, entities array<struct<text:string,type:string,type_ru:string,start:int,end:int>>, "
    "tokens array<string>, token_labels array<int>, err smallint"
)
LABELED = "tokens array<string>, tags array<string>"


def labels(spark: SparkSession) -> DataFrame:
    """The eleven labels; small by nature, so joins may broadcast it."""
    return spark.createDataFrame(LABELS, "label_id int, label string, base string, type_ru string, role string")


def label_name(label_id: Column) -> Column:
    """Label of an id, null when unknown; an array lookup in place of a join."""
    names = F.array(*[F.lit(x[1]) for x in LABELS])
    return F.when(label_id.between(0, len(LABELS) - 1), F.get(names, label_id.cast("int")))


def label_id(label: Column) -> Column:
    """Id of a label; unknown ones count as O."""
    out = F.lit(0)
    for i, name, *_ in LABELS[1:]:
        out = F.when(label == name, i).otherwise(out)
    return out


def label_base(label_id: Column) -> Column:
    """Base of an id, null when unknown."""
    bases = F.array(*[F.lit(x[2]) for x in LABELS])
    return F.when(label_id.between(0, len(LABELS) - 1), F.get(bases, label_id.cast("int")))
