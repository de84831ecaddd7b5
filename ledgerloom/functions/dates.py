"""Dates as invoices write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip


def normalize_date(value: Column) -> Column:
    """yyyy-MM-dd from d.m.yyyy, yyyy-m-d or d.m.yy; null for other shapes and days that don't exist.

    Two-digit years from 69 on are of the 1900s.
    """
    return let(strip(value), normalize_bare)


def normalize_bare(raw: Column) -> Column:
    """The same where no white space stands beside the date."""

    def made(pattern: str, mark: str, order: tuple[int, int, int]) -> Column:
        piece = [F.substring_index(raw, mark, 1), F.substring_index(F.substring_index(raw, mark, 2), mark, -1), F.substring_index(raw, mark, -1)]
        y, m, d = (piece[i] for i in order)
        full = F.when(F.length(y) == 2, F.concat(F.when(y < "69", F.lit("20")).otherwise(F.lit("19")), y)).otherwise(y)
        parts = F.concat_ws("-", full, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        return F.when(raw.rlike(pattern), parts.try_cast("date").cast("string"))

    return F.coalesce(
        made(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", ".", (2, 1, 0)),
        made(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "-", (0, 1, 2)),
        made(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2}$", ".", (2, 1, 0)),
    )
