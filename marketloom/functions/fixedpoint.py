"""Rounding to decimal digits, comparison within them, scaled integers, and the median of three."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DIGITS = 18


def power10(digits: int) -> float:
    if not 0 <= digits <= MAX_DIGITS:
        raise ValueError(f"digits must be within 0 and {MAX_DIGITS}")
    return float(10**digits)


def normalize(value: Column, digits: int) -> Column:
    """Half away from zero, by way of the scaled number."""
    p = power10(digits)
    return F.round(value * p) / p


def tolerance(digits: int) -> Column:
    """One unit of the last digit."""
    return F.lit(1.0 / power10(digits))


def compare(a: Column, b: Column, digits: int) -> Column:
    return F.abs(a - b) <= tolerance(digits)


def count_digits(text: Column) -> Column:
    """Characters after the decimal point, 0 without one."""
    at = F.instr(text, ".")
    return F.when(at > 0, F.length(text) - at).otherwise(0)


def to_fixed(value: Column, digits: int) -> Column:
    return F.round(value * power10(digits)).cast("long")


def from_fixed(value: Column, digits: int) -> Column:
    return value / power10(digits)


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
