"""Invoice texts from facts: the inverse of extraction, as column expressions.

``facts`` makes the facts of one invoice from each order, its lines and its customer;
``rendered`` writes each on a page in one of nine layouts of the renderer's own. What
extraction then reads can be held against the facts over tables of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.master import CLIENTS, CREDITORS

LAYOUTS = 9
CLIENT = CLIENTS[0][1]
MONEY = "decimal(18,2)"

#: Vendors' names by turns: creditors, in other spellings where a label stands before them, one that a keyword knows, one of the customer's own.
SPELLED = (CREDITORS[0][1], "ImmoFix", "JURISMUSTER BERATUNG GMBH", "Office-Muster Handels", "Treppenhausreinigung Nord KG")
FORMAL = (*(c[1] for c in CREDITORS), "Sauberfee Reinigung KG")
SUBJECTS = ("Stromlieferung Haus B", "Wartung der Aufzüge", "Prüfung der Verträge", "Papier und Toner", "Sonstiges")


def german(amount: Column) -> Column:
    """Dots between thousands and a comma before cents."""
    return F.translate(F.format_number(amount.cast(MONEY), 2), ",.", ".,")


def facts(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """k, layout and the facts of an invoice for each order that has lines: parties, number, dates, amounts, subject and items (text, quantity, amount).

    Every fifteenth item's text is long enough to be broken over two lines. Some orders lack a number or a service date, are
    addressed to another company, or have a VAT amount or total that is off.
    """
    price = (lineitem["l_extendedprice"].cast(MONEY) * (1 - lineitem["l_discount"].cast("decimal(4,2)"))).cast(MONEY)
    line = F.struct(lineitem["l_linenumber"].cast("int").alias("n"), lineitem["l_partkey"].alias("part"), lineitem["l_quantity"].cast("long").alias("quantity"), price.alias("amount"))
    lines = lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(line).alias("lines"))

    def item(x: Column) -> Column:
        long = x["part"] % 15 == 0
        text = F.concat(F.lit("Artikel A"), x["part"].cast("string"), F.when(long, F.lit(" in der verstärkten Ausführung")).otherwise(F.lit("")), F.lit(" Standard"))
        return F.struct(x["n"], text.alias("text"), x["quantity"], x["amount"], long.alias("long"))

    def added(total: Column, x: Column) -> Column:
        return F.coalesce((total + x["amount"]).cast("decimal(28,2)"), total, x["amount"])

    k, turn = F.col("k"), F.floor(F.col("k") / LAYOUTS)
    own = F.concat(F.lit("Handelshaus "), F.col("o_custkey").cast("string"), F.lit(" AG"))

    def of(names: tuple[str, ...], more: Column | None = None) -> Column:
        every = [F.lit(n) for n in names] + ([] if more is None else [more])
        return F.get(F.array(*every), (turn % len(every)).cast("int"))

    base = orders.select(F.col("o_orderkey").alias("k"), "o_custkey", F.to_date("o_orderdate").alias("invoice_day")).join(lines, "k").withColumn("layout", F.pmod(k, F.lit(LAYOUTS)).cast("int"))
    # made only now, so that the shuffle and the join carry numbers
    base = base.withColumns({"items": F.sort_array(F.transform("lines", item)), "net": F.aggregate("lines", F.lit(None).cast("decimal(28,2)"), added).cast(MONEY)})
    rate = F.when(k % 7 == 0, F.lit(7)).otherwise(F.lit(19)).cast("decimal(9,4)")
    vat = (F.round(F.col("net") * rate / 100, 2) + F.when(k % 19 == 0, 1).otherwise(0)).cast(MONEY)
    return base.select(
        "k", "layout", "items", "invoice_day", F.when((k % 11 != 0) | ~F.col("layout").isin(0, 1, 2, 3), F.date_sub("invoice_day", (k % 30).cast("int"))).alias("service_day"),
        F.when(F.col("layout") < 4, of(SPELLED, own)).when(F.col("layout") < 8, of(FORMAL, own)).otherwise(F.concat(F.lit("Malerbetrieb "), F.col("o_custkey").cast("string"))).alias("vendor"),
        F.when(k % 13 == 0, F.concat(F.lit("Verwaltung "), F.col("o_custkey").cast("string"), F.lit(" GmbH"))).otherwise(F.lit(CLIENT)).alias("recipient"),
        F.when((k % 17 != 0) | (F.col("layout") > 3), F.concat(F.lit("R7/"), k.cast("string"))).alias("number"), of(SUBJECTS).alias("subject"),
        "net", rate.alias("rate"), vat.alias("vat"), (F.col("net") + vat + F.when(k % 10 == 0, 25).otherwise(0)).cast(MONEY).alias("gross"),
    )


def _day(day: str, shape: str = "dd.MM.yyyy") -> Column:
    return F.date_format(day, shape)


def _line(*parts: Column | str) -> Column:
    """A line of the page; it is left out where a part of it is null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _items(with_quantity: bool = True) -> Column:
    """A line for each item; a long text goes on in a second one."""

    def one(x: Column) -> Column:
        end = F.concat(F.lit(" "), x["quantity"].cast("string"), F.lit(" "), german(x["amount"])) if with_quantity else F.concat(F.lit(" "), german(x["amount"]))
        return F.concat(F.when(x["long"], F.replace(x["text"], F.lit("verstärkten "), F.lit("verstärkten\n"))).otherwise(x["text"]), end, F.lit(" EUR"))

    return F.array_join(F.transform("items", one), "\n")


def _percent(places: int = 0) -> Column:
    return F.translate(F.format_number(F.col("rate"), places), ".", ",")


TABLE = "Bezeichnung Menge Betrag"


def rendered(df: DataFrame) -> DataFrame:
    """invoice_id and text of each row of ``facts``."""
    vendor, recipient, number, subject = (F.col(c) for c in ("vendor", "recipient", "number", "subject"))
    net, vat, gross = (german(F.col(c)) for c in ("net", "vat", "gross"))
    first_word, other_words = F.substring_index(vendor, " ", 1), F.expr("substring(vendor, length(substring_index(vendor, ' ', 1)) + 2)")
    pages: list[list[Column]] = [
        [  # a label before each field, days without leading zeros, a period of service
            _line("Lieferant: ", vendor), _line("Rechnung an: ", recipient), _line("Rechnungs-Nr.: ", number), _line("Rechnungsdatum: ", _day("invoice_day", "d.M.yyyy")),
            _line("Leistungszeitraum: ", _day("service_day"), " bis ", _day("invoice_day")), _line("Betreff: ", subject), _line("Netto: ", net, " EUR"), _line("USt.-Satz: ", _percent(), " %"), _line("USt.-Betrag: ", vat, " EUR"), _line("Bruttobetrag: ", gross, " EUR"),
        ],
        [  # other labels, ISO dates
            _line("Verkäufer: ", vendor), _line("Empfänger: ", recipient), _line("Invoice Number: ", number), _line("Rechnungsdatum: ", _day("invoice_day", "yyyy-MM-dd")), _line("Leistungsdatum: ", _day("service_day", "yyyy-MM-dd")),
            _line("Beschreibung: ", subject), _line("Nettosumme: ", net, " EUR"), _line("MwSt.-Satz: ", _percent(1), " %"), _line("MwSt.-Betrag: ", vat, " EUR"), _line("Gesamt: ", gross, " EUR"),
        ],
        [  # amounts in plain notation
            _line("Rechnungssteller: ", vendor), _line("Bill To: ", recipient), _line("Rechnungsnummer: ", number), _line("Rechnungsdatum: ", _day("invoice_day")), _line("Leistungsdatum: ", _day("service_day")), _line("Beschreibung: ", subject),
            _line("Nettobetrag: ", F.col("net").cast("string"), " EUR"), _line("Steuersatz: ", _percent(), " %"), _line("Umsatzsteuer: ", F.col("vat").cast("string"), " EUR"), _line("Endbetrag: ", F.col("gross").cast("string"), " EUR"),
        ],
        [  # years of two digits, no rate: amounts imply it
            _line("Von: ", vendor), _line("An: ", recipient), _line("Rechnungsnummer: ", number), _line("Rechnungsdatum: ", _day("invoice_day", "dd.MM.yy")), _line("Leistungsdatum: ", _day("service_day", "dd.MM.yy")), _line("Beschreibung: ", subject),
            _line("Nettobetrag: ", net, " EUR"), _line("MwSt.-Betrag: ", vat, " EUR"), _line("Gesamtbetrag: ", gross, " EUR"),
        ],
        [  # a letterhead, items without a quantity, no label for either party or the day of service
            vendor, _line("Lindenweg 3, 99999 Neustadt"), F.lit(""), recipient, _line("Gartenallee 12a"), _line("99998 Altstadt"), _line("Kundenkonto: 7741"), _line("Rechnung: ", number), _line("Datum: ", _day("invoice_day")),
            _line("Zahlbar bis: ", F.date_format(F.date_add("invoice_day", 14), "dd.MM.yyyy")), F.lit(""), _items(False), _line("Zwischensumme ", net, " EUR"), _line("zzgl. ", _percent(), " % Umsatzsteuer ", vat, " EUR"), _line("Rechnungsbetrag ", gross, " EUR"),
        ],
        [  # both parties in one line below a header for both
            _line("Rechnung ", number), _line("LOGO"), _line("Datum ", _day("invoice_day")), _line("Von An"), _line(vendor, " ", recipient), _line("Am Bach 4 Gartenallee 12a"), _line("Leistungsdatum ", _day("service_day")),
            _line(TABLE), _items(), _line("Netto ", net, " EUR"), _line(_percent(), " % USt. ", vat, " EUR"), _line("Gesamt ", gross, " EUR"),
        ],
        [  # a vendor's name over two lines, each with a part of its address behind it
            _line(first_word, " Uferstraße 9"), _line(other_words, " 88888 Seehafen"), _line("Rechnungsnummer: ", number), _line("Rechnungsdatum: ", _day("invoice_day")), _line("Leistungsdatum: ", _day("service_day")),
            _line("Leistungsempfänger:"), recipient, _line("Leistungsbeschreibung: ", subject), _line(TABLE), _items(), _line("Nettobetrag: ", net, " EUR"), _line("USt.-Satz: ", _percent(1), " %"), _line("USt.-Betrag: ", vat, " EUR"), _line("Gesamtbetrag: ", gross, " EUR"),
        ],
        [  # two columns: labels of another field in the same line
            _line("GRÜNER"), vendor, _line("Solarring 77 · 77777 Sonnfeld"), _line("Rechnungsempfänger Rechnungs-Nr. ", number), _line(recipient, " Ausgestellt am ", _day("invoice_day")), _line("Gartenallee 12a Fällig am ", F.date_format(F.date_add("invoice_day", 14), "dd.MM.yyyy")),
            _line("Leistungszeitraum Ablesung"), _line(_day("service_day"), " - ", _day("invoice_day"), " ", _day("invoice_day")), _line("Datum ", _day("invoice_day")), _line(TABLE), _items(), _line("Nettobetrag ", net, " EUR"), _line("Umsatzsteuer ", _percent(), " % ", vat, " EUR"), _line("Rechnungsbetrag ", gross, " EUR"),
        ],
        [  # a title and a shouted brand before a vendor without a legal form
            _line("RECHNUNG"), _line("MEISTER"), vendor, _line("Bill To: ", recipient), _line("Invoice Number: ", number), _line("Rechnungsdatum: ", _day("invoice_day")), _line("Leistungsdatum: ", _day("service_day")), _line("Beschreibung: ", subject),
            _line(TABLE), _items(), _line("Netto: ", net, " EUR"), _line("MwSt.-Satz: ", _percent(), " %"), _line("MwSt.-Betrag: ", vat, " EUR"), _line("Gesamt: ", gross, " EUR"),
        ],
    ]
    page = F.lit(None).cast("string")
    for i, each in reversed(list(enumerate(pages))):
        page = F.when(F.col("layout") == i, F.concat_ws("\n", *each)).otherwise(page)
    return df.select(F.col("k").cast("string").alias("invoice_id"), page.alias("text"))
