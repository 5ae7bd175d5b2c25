"""Typing of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, DoubleType, IntegerType, LongType, StringType, TimestampNTZType

#: Characters that padding is made of in fixed-width sources.
BLANKS = " \t\r\n\x00"
#: Tokens that count as absent in profiling.
NULL_TOKENS = ("", "NA", "N/A", "NULL", "NONE", "NAN", ".")


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def declared_type(letter: str, width: int = 0, decimals: int = 0) -> DataType:
    """The type that a container's letter, width and decimals declare."""
    letter = (letter or "C").upper()
    if letter in "NF":
        if decimals > 0:
            return DecimalType(min(38, max(width, decimals + 1)), decimals)
        return IntegerType() if width <= 9 else LongType() if width <= 18 else DoubleType()
    fixed = {"D": DateType(), "L": BooleanType(), "I": IntegerType(), "+": IntegerType(), "B": DoubleType(), "Y": DecimalType(19, 4), "T": TimestampNTZType(), "@": TimestampNTZType()}
    return fixed.get(letter, StringType())


def number(c: Column, target: DataType | str, decimals: int = 0) -> Column:
    """Number from text: comma is a point; without a point the last `decimals` digits are decimals; anything else is NULL."""
    text = F.replace(stripped(c), F.lit(","), F.lit("."))
    ok = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), text)
    if decimals:
        # The point goes into the text, so that a value is parsed once.
        pointed = F.regexp_replace(F.regexp_replace(ok, r"^([+-]?)(\d+)$", "$1" + "0" * decimals + "$2"), rf"^([+-]?\d+)(\d{{{decimals}}})$", "$1.$2")
        ok = F.when(F.contains(ok, F.lit(".")), ok).otherwise(pointed).try_cast(f"decimal(38,{decimals})")
    if isinstance(target, IntegerType | LongType) or target in ("int", "bigint"):
        ok = F.bround(ok.try_cast("decimal(38,6)"), 0)
    return ok.try_cast(target)


def boolean(c: Column) -> Column:
    """T, Y, 1, TRUE, S are true; F, N, 0, FALSE false; else NULL."""
    v = F.upper(stripped(c))
    return F.when(v.isin("T", "Y", "1", "TRUE", "S"), True).when(v.isin("F", "N", "0", "FALSE"), False)


def date8(c: Column, order: str = "YMD", sentinels: tuple[str, ...] = ("00000000", "99999999")) -> Column:
    """Date from eight digits, year first or last; sentinels and impossible dates are NULL."""
    v = stripped(c)
    ok = F.when(v.rlike(r"^\d{8}$") & ~v.isin(*sentinels), v) if sentinels else F.when(v.rlike(r"^\d{8}$"), v)
    y, m, d = ((1, 4), (5, 2), (7, 2)) if order.upper() in ("YMD", "YYYYMMDD") else ((5, 4), (3, 2), (1, 2))
    part = lambda p: F.substring(ok, *p)
    return F.concat(part(y), F.lit("-"), part(m), F.lit("-"), part(d)).try_cast("date")


def competence(c: Column) -> Column:
    """YYYYMM as an integer, of 1900 to 2200 and month 1 to 12, else NULL."""
    v = stripped(c.cast("string"))
    n = F.when(v.rlike(r"^\d{6}$"), v.try_cast("int"))
    return F.when((F.floor(n / 100).between(1900, 2200)) & (n % 100).between(1, 12), n)


def competence_month(c: Column) -> Column:
    """Month of a competence; 0 is NULL."""
    return F.nullif(c % 100, F.lit(0))


def integer(c: Column) -> Column:
    """Whole numbers in plain digits, else NULL."""
    v = stripped(c.cast("string"))
    return F.when(v.rlike(r"^-?\d+$"), v).try_cast("bigint")


def without_sentinels(c: Column, sentinels: list[str] | tuple[str, ...]) -> Column:
    """NULL where the trimmed value is one of the field's own sentinels."""
    if not sentinels:
        return c
    return F.when(~F.coalesce(stripped(c.cast("string")).isin(*sentinels), F.lit(False)), c)


def absent(c: Column) -> Column:
    """Whether a value counts as absent in profiling."""
    return F.coalesce(F.upper(stripped(c.cast("string"))).isin(*NULL_TOKENS), F.lit(True))


def as_text(c: Column, kind: DataType) -> Column:
    """A value as text: booleans as true/false, nested values as JSON."""
    if kind.typeName() in ("struct", "array", "map", "variant"):
        return F.to_json(c)
    return c.cast("string")
