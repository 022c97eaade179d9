"""The best path through label scores: Viterbi as a max-plus fold over a row's own array, in built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from ..functions.arrays import let

#: What a forbidden step adds: finite, so that a sentence of forbidden steps only still has a path.
FORBIDDEN = -10_000.0


def bio_steps(labels: Sequence[str] = tuple(x[1] for x in schema.LABELS)) -> tuple[list[list[float]], list[float]]:
    """(steps, first): what a step from one label to another, and a first label, adds: I- follows B- or I- of its base only."""

    def step(before: str | None, label: str) -> float:
        return FORBIDDEN if label.startswith("I-") and (before is None or before[2:] != label[2:] or before[:2] not in ("B-", "I-")) else 0.0

    return [[step(a, b) for b in labels] for a in labels], [step(None, b) for b in labels]


def best_path(scores: Column, steps: Sequence[Sequence[float]], first: Sequence[float] | None = None, last: Sequence[float] | None = None) -> Column:
    """The labels, as an array of ints, of the highest sum of scores and steps.

    scores: an array of one array of doubles for each token. steps[i][j] is added from
    label i to j, first and last at the ends. Of equal paths the one of smaller labels,
    seen from the end, counts. An empty array has an empty path, and null has null.
    """
    n = len(steps)

    def numbers(values: Sequence[float]) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    def plus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    into = F.array(*[numbers([steps[i][j] for i in range(n)]) for j in range(n)])  # by the label that is entered

    def enter(now: Column) -> Column:
        """For each label the best sum on the way into it and where that comes from."""
        return F.transform(into, lambda t: let(plus(now, t), lambda v: let(F.array_max(v), lambda m: F.struct(m.alias("m"), (F.array_position(v, m) - 1).cast("int").alias("i")))))

    def onward(state: Column, token: Column) -> Column:
        return let(
            enter(state["now"]),
            lambda way: F.struct(plus(F.transform(way, lambda w: w["m"]), token).alias("now"), F.concat(state["back"], F.array(F.transform(way, lambda w: w["i"]))).alias("back")),
        )

    def walked(state: Column) -> Column:
        total = plus(state["now"], numbers(last)) if last else state["now"]
        end = (F.array_position(total, F.array_max(total)) - 1).cast("int")
        return F.aggregate(F.reverse(state["back"]), F.array(end), lambda path, back: F.concat(F.array(F.get(back, F.get(path, F.lit(0)))), path))

    doubles = F.transform(scores, lambda t: t.cast("array<double>"))
    head = F.get(doubles, F.lit(0))
    begin = F.struct((plus(head, numbers(first)) if first else head).alias("now"), F.array().cast("array<array<int>>").alias("back"))
    found = F.aggregate(F.slice(doubles, 2, F.greatest(F.size(doubles) - 1, F.lit(0))), begin, onward, walked)
    return F.when(F.size(scores) == 0, F.array().cast("array<int>")).when(scores.isNotNull(), found)


class PathTagger:
    """After a model's logits: label_ids of the best path that keeps to the label scheme, over the tokens that the mask names."""

    def __init__(self, steps: Sequence[Sequence[float]] | None = None, first: Sequence[float] | None = None, last: Sequence[float] | None = None):
        scheme, begin = bio_steps()
        self.steps, self.first, self.last = steps or scheme, first or begin, last

    def __call__(self, scored):
        """scored has logits and attention_mask; padded tokens get label 0."""
        n = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
        path = best_path(F.slice("logits", F.lit(1), n), self.steps, self.first, self.last)
        return scored.withColumn("label_ids", F.concat(path, F.array_repeat(F.lit(0), F.size("logits") - n)))
