"""Vector and token arithmetic as array expressions: quantising, norms, sampling, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def quantise(v: Column) -> tuple[Column, Column]:
    """Scale max/127 and 8-bit values rounded half away from zero; a zero group stays zero."""
    scale = F.array_max(F.transform(v, F.abs)) / 127
    q = F.transform(v, lambda x: F.when(scale == 0, 0).otherwise(F.signum(x) * F.floor(F.abs(x) / scale + 0.5)).cast("int"))
    return scale, q


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def rmsnorm(v: Column, eps: float = 1e-5) -> Column:
    scale = F.sqrt(total(F.transform(v, lambda x: x * x)) / F.size(v) + eps)
    return F.transform(v, lambda x: x / scale)


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def loss_mask(ids: Column, opening: int, closing: int) -> Column:
    """1 for targets outside `opening .. closing` spans, 0 inside, delimiters included.

    A window that closes a span it did not open begins inside one.
    """
    first_open, first_close = F.array_position(ids, opening), F.array_position(ids, closing)
    inside = ((first_close > 0) & ((first_open == 0) | (first_open > first_close))).cast("int")
    start = F.struct(inside.alias("on"), F.array().cast("array<int>").alias("m"))

    def step(acc, x):
        opens, closes = x == opening, x == closing
        masked = (acc["on"] == 1) | opens | closes
        after = F.when(opens, 1).when(closes, 0).otherwise(acc["on"])
        return F.struct(after.alias("on"), F.concat(acc["m"], F.array(F.when(masked, 0).otherwise(1))).alias("m"))

    return F.aggregate(ids, start, step)["m"]
