"""Check digits of VAT IDs and IBANs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vat_id_valid(value: Column) -> Column:
    """German VAT ID: ISO 7064 MOD 11-10 over eight digits and a check digit."""

    def digit(i: Column) -> Column:
        return F.substring(value, i + 2, F.lit(1)).cast("int")

    def step(product: Column, i: Column) -> Column:
        total = (digit(i) + product) % 10
        return (2 * F.when(total == 0, F.lit(10)).otherwise(total)) % 11

    rest = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(10), step)
    return F.when(value.rlike("^DE[0-9]{9}$"), (11 - rest) % 10 == digit(F.lit(9))).otherwise(F.lit(False))


def iban_valid(value: Column) -> Column:
    """ISO 7064 MOD 97-10, digit by digit, so that no length overflows."""
    iban = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        char = F.substring(turned, i, F.lit(1))
        return F.when(char.rlike("[0-9]"), rest * 10 + char.try_cast("int")).otherwise(rest * 100 + F.ascii(char) - 55) % 97

    total = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)
    return F.when(iban.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$"), total == 1).otherwise(F.lit(False))
