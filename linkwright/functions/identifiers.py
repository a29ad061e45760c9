"""Barcodes and stock-keeping units as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A barcode that a spreadsheet has turned to scientific notation is no barcode.
SPREADSHEET = r"^\s*[0-9]+([.,][0-9]+)?[eE][+-]?[0-9]+\s*$"


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), "[^0-9]", "")


def gs1_valid(digits: Column) -> Column:
    """Whether the last digit is the modulo-10 check of the others, which weigh 3 and 1 from the right."""
    weights = F.array(*(F.lit(3 if i % 2 == 0 else 1) for i in range(14)))
    # A fold over digits, not a sum of fourteen terms: as such a sum the stage's code grows beyond what the JVM compiles.
    weighed = F.zip_with(F.split(F.lpad(digits, 14, "0"), ""), weights, lambda d, w: d.try_cast("int") * w)
    return F.aggregate(weighed, F.lit(0), lambda total, d: total + d) % 10 == 0


def checked(digits: Column, lengths: tuple[int, ...]) -> Column:
    return F.when(F.length(digits).isin(*lengths) & gs1_valid(digits), digits)


def ean(value: Column) -> Column:
    """EAN-8 or EAN-13, a 12-digit code padded by a zero; null if it is neither or its check fails."""
    digits = only_digits(value)
    return checked(F.when(F.length(digits) == 12, F.concat(F.lit("0"), digits)).otherwise(digits), (8, 13))


def gtin(value: Column) -> Column:
    """GTIN of 8, 12, 13 or 14 digits as it stands; null if its check fails."""
    return checked(only_digits(value), (8, 12, 13, 14))


def barcode(value: Column) -> Column:
    """Null for a barcode lost to scientific notation."""
    return F.when(~value.rlike(SPREADSHEET), value)


def sku(value: Column) -> Column:
    """Upper case without white space; null is empty."""
    return F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", ""))
