"""Labels, targets, weights, codecs and row rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.constants import ALIGNMENT_CONFIDENCE, CLASS_HUMAN, CLASS_TARGETS, CLASSES, DURATION_WEIGHTS, OTHER_CONFIDENCE, PHONES, THRESHOLDS


def class_of_human_score(s: Column) -> Column:
    """FN-10."""
    return F.when(s >= 1.5, CLASSES[2]).when(s >= 0.5, CLASSES[1]).otherwise(CLASSES[0])


def class_of_target(t: Column, version: str = "v1") -> Column:
    """FN-11: by the thresholds of a report version."""
    accented, correct = THRESHOLDS[version]
    return F.when(t >= correct, CLASSES[2]).when(t >= accented, CLASSES[1]).otherwise(CLASSES[0])


def predicted_class(match: Column, presence: Column) -> Column:
    """FN-12: a phone that is likely absent is missed, whatever its match score."""
    return F.when(presence < 0.5, CLASSES[0]).otherwise(class_of_target(match, "v1"))


def regression_target(s: Column) -> Column:
    """FN-13: whole human scores have targets of their own, the others lie on a line."""
    whole = F.rint(s)
    exact = F.element_at(F.array(*[F.lit(x) for x in CLASS_TARGETS]), (F.greatest(F.lit(0.0), F.least(F.lit(2.0), whole)) + 1).cast("int"))
    line = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 15.0 + s / 2.0 * 77.0))
    return F.when((F.abs(s - whole) < 1e-6) & whole.between(0, 2), exact).otherwise(line)


def alignment_confidence(source: Column) -> Column:
    """FN-18."""
    out = F.lit(OTHER_CONFIDENCE)
    for name, x in ALIGNMENT_CONFIDENCE.items():
        out = F.when(source == name, F.lit(x)).otherwise(out)
    return out


def duration_weight(phone: Column) -> Column:
    """FN-19."""
    out = F.lit(1.0)
    for weight, phones in DURATION_WEIGHTS.items():
        out = F.when(phone.isin(*phones), F.lit(weight)).otherwise(out)
    return out


def phoneme_id(phone: Column) -> Column:
    """FN-20: 0 is padding, 1 unknown, then the phones in order."""
    at = F.array_position(F.array(*[F.lit(p) for p in PHONES]), phone)
    return F.when(at > 0, at + 1).otherwise(F.lit(1)).cast("int")


def class_index(name: Column) -> Column:
    """FN-21: an unknown name is an error."""
    at = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), name)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown pronunciation class: "), F.coalesce(name, F.lit("null")))).cast("int"))


def class_name(index: Column) -> Column:
    """FN-21: an index outside 0..2 is an error."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    return F.when(index.between(0, 2), F.element_at(names, index + 1)).otherwise(F.raise_error(F.concat(F.lit("unknown class index: "), F.coalesce(index.cast("string"), F.lit("null")))))


def expected_value(probs: Column, weights: tuple[float, ...] = CLASS_TARGETS) -> Column:
    """FN-22: the dot product with class values; another width is an error."""
    dot = F.aggregate(F.zip_with(probs, F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(probs) == len(weights), dot).otherwise(F.raise_error(F.lit("class probabilities have another width")).cast("double"))


def expected_human_score(probs: Column) -> Column:
    return expected_value(probs, CLASS_HUMAN)


def sigmoid(x: Column) -> Column:
    """FN-23."""
    return 1.0 / (1.0 + F.exp(-x))


def softmax(a: Column) -> Column:
    """FN-23: shifted by the maximum."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax(a: Column) -> Column:
    """FN-23: the first index of the maximum, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def violated(rules: dict[str, Column]) -> Column:
    """FN-26: the names of the rules that a row breaks, in order; a null condition counts as broken."""
    marks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return F.filter(marks, lambda x: x.isNotNull())


def first_reason(rules: dict[str, Column]) -> Column:
    """FLT-05: the first rule, in order, that rejects a row; null passes. A null condition doesn't reject."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
