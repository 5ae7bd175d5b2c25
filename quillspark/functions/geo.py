"""Municipality codes (P10-P13) and the states they lie in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import stripped

#: The official two-digit state codes and their abbreviations.
STATES = {
    "11": "RO", "12": "AC", "13": "AM", "14": "RR", "15": "PA", "16": "AP", "17": "TO",
    "21": "MA", "22": "PI", "23": "CE", "24": "RN", "25": "PB", "26": "PE", "27": "AL", "28": "SE", "29": "BA",
    "31": "MG", "32": "ES", "33": "RJ", "35": "SP",
    "41": "PR", "42": "SC", "43": "RS",
    "50": "MS", "51": "MT", "52": "GO", "53": "DF",
}


def check_digit(six: Column) -> Column:
    """Check digit of six digits: weights 1,2,1,2,1,2, products of two digits count as their digit sum, modulo 10 (P10)."""
    total = F.lit(0)
    for i in range(6):
        digit = F.substring(six, i + 1, 1).try_cast("int")
        if i % 2:
            digit = F.when(digit * 2 > 9, digit * 2 - 9).otherwise(digit * 2)
        total = total + digit
    return F.when(six.rlike(r"^\d{6}$"), ((10 - total % 10) % 10).cast("int"))


def valid_seven(seven: Column) -> Column:
    """Whether seven digits end in their check digit."""
    return F.coalesce(seven.rlike(r"^\d{7}$") & (check_digit(F.substring(seven, 1, 6)) == F.substring(seven, 7, 1).try_cast("int")), F.lit(False))


def seven_digits(c: Column, known: Column | None = None) -> Column:
    """A six-digit code with its check digit: from the table where it is there (`known`, e.g. of a left join), else computed. Seven digits pass, all else is NULL."""
    v = stripped(c.cast("string"))
    made = F.concat(v, check_digit(v).cast("string"))
    return F.when(v.rlike(r"^\d{7}$"), v).when(v.rlike(r"^\d{6}$"), F.coalesce(known, made) if known is not None else made)


def state(c: Column) -> Column:
    """State abbreviation from the first two digits; unknown is NULL."""
    table = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return F.try_element_at(table, F.substring(stripped(c.cast("string")), 1, 2))
