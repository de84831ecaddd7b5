"""Eleven fields from the text of an invoice, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money
from ..functions import patterns as P
from ..functions.text import any_of, first_match, folded, found, is_odd, let, lines, match_of, present, strip, strip_marks
from ..schemas import FIELDS

_OTHER = r"(?iusU)" + P.OTHER_LABEL


def _left_column(line: Column) -> Column:
    """A line up to the label of another field."""
    return let(line, lambda x: F.when(x.rlike(_OTHER), strip_marks(F.regexp_replace(x, _OTHER + ".*$", ""))).otherwise(strip(x)))


def _name_part(line: Column) -> Column:
    """A line without a street or a postal code and city, and what follows; both have digits."""
    return strip_marks(F.when(line.rlike(r"(?U)\d"), F.regexp_replace(F.regexp_replace(line, P.STREET, ""), P.POSTAL_CITY, "")).otherwise(line))


def _entities(line: Column) -> Column:
    return F.when(line.rlike(P.LEGAL_FORM), F.regexp_extract_all(line, F.lit(P.ENTITY), F.lit(0)))


def _first_of(array: Column, make, kind: str = "string") -> Column:
    """The first value that isn't null of ``make``(element, place); what follows it isn't tried."""
    none = F.struct(F.lit(None).cast(kind).alias("value"), F.lit(0).alias("i"))
    return F.aggregate(array, none, lambda seen, x: F.struct(F.coalesce(seen["value"], make(x, seen["i"])).alias("value"), (seen["i"] + 1).alias("i")))["value"]


def _first_index(array: Column, test) -> Column:
    """Zero-based place of the first element for which ``test`` holds; null if there is none."""
    return _first_of(array, lambda x, i: F.when(test(x), i), "int")


def _labelled_recipient(line: Column, i: Column) -> Column:
    rest = strip_marks(F.regexp_replace(line, P.RECIPIENT_LABEL, ""), " :\t")
    below = [found(_left_column(F.get("_bare", i + k))) for k in (1, 2)]
    return F.when(line.rlike(P.RECIPIENT_LABEL), F.coalesce(found(_left_column(rest)), *below))


def _recipient_by_label(bare: Column) -> Column:
    """The recipient behind the first label or right below it, which _labelled holds; line by line only where nothing stands there."""
    parts = F.split(F.col("_labelled"), "\n")
    near = _first_of(parts, lambda x, i: found(_left_column(F.when(i == 0, strip_marks(x, " :\t")).otherwise(x))))
    return F.when(F.col("_labelled") != "", F.coalesce(near, _first_of(bare, _labelled_recipient)))


def _named_recipient(vendor: Column, header: Column):
    """The recipient that an unlabelled line names, given the vendor and the place of a header of both parties."""
    known = vendor.isNotNull() & (vendor != "")

    def besides_vendor(candidate: Column) -> Column:
        rest = strip_marks(F.substring(candidate, F.instr(candidate, vendor) + F.length(vendor), F.length(candidate)))
        return (
            F.when(known & F.contains(candidate, vendor), let(rest, lambda r: F.when((r != "") & r.rlike(P.LEGAL_FORM), r)))
            .when(known & F.contains(vendor, candidate), F.lit(None))
            .otherwise(candidate)
        )

    def legal(line: Column) -> Column:
        return F.when(line.rlike(P.LEGAL_FORM), let(_left_column(line), lambda c: F.when((c != "") & c.rlike(P.LEGAL_FORM), besides_vendor(c))))

    def make(line: Column, i: Column) -> Column:
        below = header.isNotNull() & (i > header)
        both = F.when(below & line.rlike(P.LEGAL_FORM), let(_entities(line), lambda e: F.when(F.size(e) >= 2, strip(F.element_at(e, -1)))))
        return F.coalesce(both, F.when(header.isNull() | below, legal(line)))

    return make


def _with_letterhead(df: DataFrame) -> DataFrame:
    """``df`` with _letterhead, where _vendor is null: the first line with a legal form above any label, joined to a short line right above it."""
    bare = F.col("_bare")
    # address parts are cut from the end of a line, so only lines with a legal form anywhere can have one before it
    step = df.withColumn("_form", F.when(F.col("_legal") & F.col("_vendor").isNull(), _first_index(bare, lambda x: x.rlike(P.LEGAL_FORM) & _name_part(x).rlike(P.LEGAL_FORM))))
    labels = F.exists(F.slice(bare, F.lit(1), F.col("_form") + 1), lambda x: x.rlike(P.RECIPIENT_LABEL) | x.rlike(_OTHER))
    step = step.withColumn("_at", F.when(F.col("_form").isNotNull() & ~labels, F.col("_form")))
    step = step.withColumn("_own", _name_part(F.get("_bare", F.col("_at")))).withColumn("_above", F.when(F.col("_at") > 0, _name_part(F.get("_bare", F.col("_at") - 1))))
    short = (F.col("_above") != "") & (F.size(F.split("_above", r"(?U)\s+")) <= 3)
    joined = F.when(short, strip(F.concat("_above", F.lit(" "), "_own"))).otherwise(F.col("_own"))
    return step.withColumn("_letterhead", F.when(F.col("_at").isNotNull(), joined)).drop("_form", "_at", "_own", "_above")


def _plausible_vendor(line: Column) -> Column:
    """Whether a stripped line could be a vendor's name at all."""
    single = ~line.rlike(r"(?U)\s")
    shout = (line == F.upper(line)) & (line != F.lower(line))
    title = F.lower(line).isin("rechnung", "invoice") | line.rlike(P.INVOICE_TITLE)
    return (line != "") & ~((F.length(line) < 8) & single) & ~title & ~(shout & single & ~line.rlike(P.LEGAL_FORM))


def _description(text: Column, low: Column, bare: Column) -> Column:
    labelled = [let(strip(match_of(text, low, p)), lambda c: F.when((c != "") & ~c.rlike(P.TABLE_HEADER), c)) for p in P.DESCRIPTION]

    def item(line: Column, i: Column) -> Column:
        ends = F.endswith(line, F.lit("€")) | (F.lower(F.right(line, F.lit(3))) == "eur")
        return F.when(ends, found(strip_marks(F.regexp_extract(line, P.LINE_ITEM, 1), " -·\t")))

    return F.coalesce(*labelled, F.when(F.contains(low, F.lit("eur")) | F.contains(low, F.lit("€")), _first_of(bare, item)))


def _header_date(ls: Column, header: Column) -> Column:
    """The first date above a header of both parties on a line that isn't about another date."""

    def make(line: Column, i: Column) -> Column:
        usable = (header.isNull() | (i < header)) & ~line.rlike(P.OTHER_DATE) & line.rlike(P.BARE_DATE)
        return F.when(usable, F.regexp_extract(line, P.BARE_DATE, 1))

    return _first_of(ls, make)


def extract_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the eleven fields; the first pattern or line that gives a value decides.

    What only lines with a legal form or a date can give isn't looked for, line by line, in a text without one. What several
    expressions use is a column of its own, so that no pattern is run twice.
    """
    t = F.col(text)
    step = df.withColumn("_odd", is_odd(t)).withColumns({"_low": folded(t, F.col("_odd")), "_lines": lines(F.coalesce(t, F.lit("")), F.col("_odd"))})
    step = step.withColumn("_bare", F.when(F.col("_odd"), F.transform("_lines", strip)).otherwise(F.col("_lines")))
    bare, low, header = F.col("_bare"), F.col("_low"), F.col("_header")
    page = F.when(F.col("_odd"), F.array_join("_bare", "\n")).otherwise(t)
    step = step.withColumns({"_legal": F.coalesce(low.rlike(P.LOW_LEGAL_FORM), F.lit(False)), "_labelled": F.regexp_extract(page, P.LABELLED_RECIPIENT, 1)})
    step = step.withColumn("_header", F.when(any_of([F.contains(low, F.lit(w)) for w in P.PARTIES]) & low.rlike(P.PARTIES_HEADER), _first_index(F.col("_lines"), lambda x: folded(x, F.col("_odd")).rlike(P.PARTIES_HEADER))))
    row = F.filter(F.transform(F.slice(bare, header + 2, F.lit(3)), _entities), lambda e: F.size(e) >= 2)
    both = F.when(header.isNotNull(), strip(F.get(F.get(row, F.lit(0)), F.lit(0))))
    step = _with_letterhead(step.withColumn("_vendor", F.coalesce(found(first_match(t, low, P.VENDOR)), found(both))))
    step = step.withColumn("vendor_name", F.coalesce("_vendor", present(F.col("_letterhead")), _first_of(bare, lambda x, i: F.when(_plausible_vendor(x), x))))
    recipient = F.coalesce(_recipient_by_label(bare), F.when(F.col("_legal"), _first_of(bare, _named_recipient(F.col("vendor_name"), header))))
    step = step.withColumns(
        {
            "invoice_recipient": recipient,
            "invoice_number": first_match(t, low, P.INVOICE_NUMBER),
            "_dated": F.coalesce(found(first_match(t, low, P.INVOICE_DATE)), F.when(t.rlike(P.DATE), _header_date(F.col("_lines"), header))),
            "_served": first_match(t, low, P.SERVICE_DATE),
            "_currency": first_match(t, low, P.CURRENCY),
            "_net": first_match(t, low, P.NET), "_vat": first_match(t, low, P.VAT_AMOUNT), "_gross": first_match(t, low, P.GROSS), "_rate": first_match(t, low, P.VAT_RATE),
            "description": _description(t, low, bare),
        }
    )
    amounts = {name: money.cents(money.parse_bare(F.col(c))) for name, c in (("net_amount", "_net"), ("vat_amount", "_vat"), ("gross_amount", "_gross"))}
    # the groups of patterns of amounts and dates hold digits and marks alone
    step = step.withColumns(amounts).withColumns(
        {
            "invoice_date": dates.normalize_bare(F.col("_dated")),
            "service_date": dates.normalize_bare(F.col("_served")),
            "currency": F.when(F.col("_currency") == "€", F.lit("EUR")).otherwise(F.col("_currency")),
            "vat_rate": F.coalesce(money.parse_bare(F.col("_rate")).cast("decimal(9,4)"), money.inferred_rate(F.col("net_amount"), F.col("vat_amount"))),
        }
    )
    return step.select(*[F.col(c) for c in df.columns if c not in FIELDS], *FIELDS)


def coerce_json(answer: Column) -> Column:
    """The eleven fields from a model's JSON answer, with or without a code fence; null if it isn't an object.

    Amounts that aren't numbers, dates that aren't of ISO shape and blank strings become null.
    """
    bare = strip(F.regexp_replace(strip(answer), P.CODE_FENCE, ""))

    def value(got: Column, name: str) -> Column:
        own = strip(got[name])
        if name in ("net_amount", "vat_amount", "gross_amount"):
            own = money.parse_decimal(got[name]).cast("decimal(18,2)")
        elif name == "vat_rate":
            own = money.parse_decimal(got[name]).cast("decimal(9,4)")
        elif name.endswith("_date"):
            own = F.when(own.rlike(P.ISO_DATE), own)
        else:
            own = present(own)
        return own.alias(name)

    got = let(bare, lambda b: F.when(b.rlike(r"(?s)^\{.*\}$"), F.from_json(b, "map<string,string>")))
    return let(got, lambda g: F.when(g.isNotNull(), F.struct(*[value(g, n) for n in FIELDS])))


def model_answers(ask: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A function of a text column: what ``ask``, called in tasks with each text, answers; null where it fails."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else ask(text)
        except Exception:  # a model that can't be reached leaves the text to the patterns
            return None

    @F.pandas_udf("string")
    def answers(texts: pd.Series) -> pd.Series:
        return texts.map(one).astype(object)

    return answers.asNondeterministic()


def prefer_answers(df: DataFrame, answer: str) -> DataFrame:
    """``df`` (the eleven fields) with all fields from the struct column ``answer`` where it isn't null."""
    return df.withColumns({f: F.when(F.col(answer).isNotNull(), F.col(f"{answer}.{f}")).otherwise(F.col(f)) for f in FIELDS})
