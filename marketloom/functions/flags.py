"""Bit masks on LONG columns, enumerations by name, and small text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.types import ENUMS, LENIENT


def _mask(flag: int | Column) -> Column:
    return F.lit(flag).cast("long") if isinstance(flag, int) else flag


def has(flags: Column, flag: int | Column) -> Column:
    return flags.bitwiseAND(_mask(flag)) != 0


def put(flags: Column, flag: int | Column) -> Column:
    return flags.bitwiseOR(_mask(flag))


def clear(flags: Column, flag: int | Column) -> Column:
    return flags.bitwiseAND(F.bitwise_not(_mask(flag)))


def put_if(flags: Column, flag: int, condition: Column) -> Column:
    return F.when(condition, put(flags, flag)).otherwise(flags)


def enum_name(number: Column, enum: str) -> Column:
    """The member's name; an error for a number outside the enumeration."""
    names = F.array(*(F.lit(x) for x in ENUMS[enum]))
    n = number.cast("int")
    return F.when((n >= 0) & (n < len(ENUMS[enum])), F.get(names, n)).otherwise(F.raise_error(F.concat(F.lit(f"no {enum} "), n.cast("string"))))


def enum_number(name: Column, enum: str) -> Column:
    """The member's number; an unknown name is member 0 in lenient enumerations, else an error."""
    names = F.array(*(F.lit(x) for x in ENUMS[enum]))
    at = F.array_position(names, name).cast("int")
    other = F.lit(0) if enum in LENIENT else F.raise_error(F.concat(F.lit(f"invalid {enum}: "), name)).cast("int")
    return F.when(at > 0, at - 1).otherwise(other)


def hex_byte(number: Column) -> Column:
    """Two lower-case digits after 0x."""
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(number.cast("long")), 2, "0")))
