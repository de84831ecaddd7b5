"""The items of an invoice's table as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..functions.text import found, let

#: What stands between the line that opens the table of items and the one that closes it, or the end.
TABLE = (
    r"(?iudUm)^\h*(?:Pos\.?\h+)?(?:Bezeichnung|Artikel|Beschreibung)\h+Menge\h+(?:Preis\h+)?Betrag\h*$\n?"
    r"((?s:.*?))(?:^\h*(?:Netto(?:summe|betrag)?|Zwischensumme)\b|\z)"
)
#: An item ends with its quantity and amount; its text may go on over several lines before that.
ITEM = r"(?iusU)\s*(.+?)\s+(\d+)\s+(\d[\d.,]*)\h*(?:€|EUR)\h*(?:\n|$)"


def _pieces(text: Column) -> Column:
    """array<string>: quantity, amount and text of each item between the table's header and the net amount, parted by blanks; empty without a table.

    One pass finds the table and one its items. An item's text begins where the item before it ends, so nothing stands between two,
    and \\r, which the table doesn't hold any more, ends each.
    """
    even = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    marked = F.split(F.regexp_replace(F.regexp_extract(even, TABLE, 1), ITEM, "$2 $3 $1\r"), "\r")
    return let(marked, lambda m: F.slice(m, F.lit(1), F.size(m) - 1))


def _item(piece: Column, i: Column) -> list[Column]:
    """n, text, quantity and amount of the piece at place ``i``."""
    part = F.split(piece, " ", 3)
    return [
        (i + 1).cast("int").alias("n"), found(F.regexp_replace(F.get(part, F.lit(2)), r"(?U)\s+", " ")).alias("text"), F.get(part, F.lit(0)).try_cast("long").alias("quantity"),
        money.cents(money.parse_bare(F.get(part, F.lit(1)))).alias("amount"),
    ]


def items(text: Column) -> Column:
    """array<struct<n, text, quantity, amount>> of the items between the table's header and the net amount, in order; empty without a table.

    A text broken over lines is put together with single spaces. An amount that is no number is null.
    """
    rows = F.transform(_pieces(text), lambda x, i: F.struct(*_item(x, i)))
    return F.coalesce(rows, F.array().cast("array<struct<n:int,text:string,quantity:bigint,amount:decimal(18,2)>>"))


def invoice_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each item of each text, beside the other columns of ``df``; texts without items give none."""
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.select(*others, F.posexplode(_pieces(F.col(text))).alias("_i", "_piece")).select(*others, *_item(F.col("_piece"), F.col("_i")))
