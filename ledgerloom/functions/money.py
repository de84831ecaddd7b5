"""Amounts: locale-aware parsing, rounding and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import strip


def parse_decimal(value: Column) -> Column:
    """A decimal(18,6) from a plain or German number, with or without a currency mark; null if it is neither.

    1.234 is a thousand and more, 1234.56 is plain; 1234,56 and 1,234.56 are neither.
    """
    return parse_bare(strip(F.replace(F.replace(strip(value), F.lit("€"), F.lit("")), F.lit("EUR"), F.lit(""))))


def parse_bare(bare: Column) -> Column:
    """The same where neither a mark nor white space stands beside the number."""
    german = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(bare.rlike(P.GERMAN_NUMBER), strip(german)).otherwise(bare).try_cast("decimal(18,6)")


def cents(value: Column) -> Column:
    """Rounded to cents, halves to even."""
    return F.bround(value, 2).cast("decimal(18,2)")


def inferred_rate(net: Column, vat: Column) -> Column:
    """The VAT rate in percent that net and VAT imply, to one decimal; null where either is missing or zero."""
    usable = net.isNotNull() & vat.isNotNull() & (net != 0) & (vat != 0)
    return F.when(usable, F.bround(vat.cast("decimal(18,2)") * 100 / net.cast("decimal(18,2)"), 1).cast("decimal(9,4)"))


def fixed(value: Column, places: int = 2) -> Column:
    """Text with a fixed number of decimals and no grouping."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))
