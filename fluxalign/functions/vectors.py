"""Functions on arrays of doubles: logits, embeddings and norms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASS_NAMES = ["negative", "neutral", "positive"]
TINY = 1e-12


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    """Shifted by the largest value, so that no exponential overflows."""
    shifted = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(F.array(shifted), lambda e: F.transform(e, lambda x: x / total(e)))[0]


def argmax(a: Column) -> Column:
    """Zero-based place of the largest value, the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def margin(p: Column) -> Column:
    s = F.array_sort(p)
    return F.element_at(s, -1) - F.element_at(s, -2)


def l2(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def ratio(x: Column, y: Column) -> Column:
    return x / F.greatest(y, F.lit(TINY))


def sigmoid(g: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-g))


def class_name(target: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CLASS_NAMES)), target + 1)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def known(x: Column) -> Column:
    """The value where it is finite, else null: missing values are null throughout."""
    return F.when(finite(x), x)
