"""Colour arithmetic for tree drawings: six hex digits, mixing and opacity."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(colour: Column | str, i: int) -> Column:
    return F.conv(F.substring(colour, 2 * i + 1, 2), 16, 10).cast("int")


def channels(colour: Column | str) -> Column:
    return F.array(*[channel(colour, i) for i in range(3)])


def to_hex(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), "")


def mix(a: Column | str, b: Column | str) -> Column:
    """The floor of the mean of each channel."""
    return to_hex(F.zip_with(channels(a), channels(b), lambda x, y: F.floor((x + y) / 2)))


def opaque(colour: Column | str, q: Column) -> Column:
    """The colour at opacity q (0 to 1) on white."""
    return to_hex(F.transform(channels(colour), lambda v: F.floor(F.lit(255) - q * (F.lit(255) - v))))


def opacity(score: Column, least: Column, most: Column, log: bool = False) -> Column:
    """Linear: share of the greatest score. Log: where ln score lies between the least score over 0 and the greatest; 1 if these are equal."""
    if not log:
        return score / most
    return F.when(least == most, F.lit(1.0)).otherwise(F.ln(score / least) / F.ln(most / least))


def blend(parts: Column) -> Column:
    """parts: array<struct<colour,q>> in sample order; white takes each colour at its opacity in turn."""
    return F.aggregate(parts, F.lit("FFFFFF"), lambda acc, p: mix(acc, opaque(p["colour"], p["q"])))


def random_colours(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("0123456789ABCDEF") for _ in range(6)) for _ in range(n)]
