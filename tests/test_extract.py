from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators.extract import coerce_json, extract_fields
from ledgerloom.schemas import FIELDS

def fields(spark, *texts):
    return extract_fields(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()


def test_compound_date_labels_are_no_service_date(spark):
    (r,) = fields(spark, "Firma Beispiel GmbH\nRechnungsdatum: 15.03.2026\nAbrechnungsdatum: 01.03.2026\n")
    assert r.service_date is None and r.invoice_date == "2026-03-15"


def test_nothing_to_find(spark):
    for r in fields(spark, None, "", " \n ", "x"):
        assert all(r[f] is None for f in FIELDS), r


def test_amount_that_does_not_parse_is_not_tried_again(spark):
    (r,) = fields(spark, "Nettobetrag: 1234,56 EUR\nZwischensumme: 10,00 EUR")
    assert r.net_amount is None


def test_rate_is_inferred_from_amounts_but_not_from_zero(spark):
    a, b = fields(spark, "Netto: 200,00 EUR\nUSt.-Betrag: 14,00 EUR x\n", "Netto: 200,00 EUR\nUSt.-Betrag: 0,00 EUR x\n")
    assert a.vat_rate == Decimal("7.0000") and b.vat_rate is None


def test_a_rate_behind_the_tax_is_read_not_inferred(spark):
    """VAT that is off by one implies 19.1 of a small net amount."""
    got = fields(spark, "Nettobetrag 1.879,46 EUR\nUmsatzsteuer 19 % 358,10 EUR\n", "Netto 100,00 EUR\nMwSt. 7,0% 8,00 EUR\n", "Netto 100,00 EUR\nUSt.-Betrag: 8,00 EUR\n")
    assert [str(r.vat_rate) for r in got] == ["19.0000", "7.0000", "8.0000"]


def test_currency_keeps_odd_case_and_needs_word_bounds_at_the_euro_sign(spark):
    a, b, c = fields(spark, "100 eur", "100 €", "100€5")
    assert (a.currency, b.currency, c.currency) == ("eur", None, "EUR")


def test_label_starting_a_longer_word_is_taken(spark):
    (r,) = fields(spark, "Anzahl der Teile\nBeispiel GmbH")
    assert r.invoice_recipient == "zahl der Teile"


def test_columns_with_names_of_fields_are_replaced(spark):
    df = spark.createDataFrame([("a", "Netto: 5 EUR", "old")], "doc string, text string, net_amount string")
    assert extract_fields(df).first().net_amount == Decimal("5.00")


def test_json_answers(spark):
    raws = ['{"net_amount": "1.000,00", "vendor_name": " A ", "invoice_date": "2026-02-30", "vat_rate": 19}', '```json\n{"vendor_name": "B"}\n```', "nope", "[1]", None, '{"net_amount": "x"}']
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, x string").orderBy("i").select(coerce_json(F.col("x"))).collect()]
    assert (got[0].net_amount, got[0].vendor_name, got[0].invoice_date, got[0].vat_rate) == (Decimal("1000.00"), "A", "2026-02-30", Decimal("19"))
    assert got[1].vendor_name == "B" and got[2:5] == [None, None, None] and got[5].net_amount is None


def test_five_digits_before_a_legal_form_belong_to_the_name(spark):
    rest = "Leistungsempfänger:\nMusterhaus GmbH\n"
    got = fields(spark, "Handelshaus Uferstraße 9\n10097 AG 88888 Seehafen\n" + rest, "GRÜNER\nHandelshaus 10109 AG\nSolarring 77 · 77777 Sonnfeld\n" + rest, "BERATUNG GMBH 66119 Agstadt\n" + rest)
    assert [r.vendor_name for r in got] == ["Handelshaus 10097 AG", "GRÜNER Handelshaus 10109 AG", "BERATUNG GMBH"]


def test_answers_name_customers_of_five_digits(spark, tmp_path):
    """Larger tables have customers of five digits; the smallest don't."""
    import duckdb

    from parity import DATA, rows

    from ledgerloom.plans.oracle import SQL
    from ledgerloom.plans.queries import QUERIES

    con = duckdb.connect()
    for name, what in (("orders", "* REPLACE (o_custkey + 10000 AS o_custkey)"), ("lineitem", "*")):
        con.execute(f"COPY (SELECT {what} FROM read_parquet('{DATA}/{name}.parquet')) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    for query in ("rendered_fields", "rendered_answers"):
        assert rows(QUERIES[query](spark, str(tmp_path)).toPandas()) == rows(con.execute(SQL[query]).df())


def test_no_pattern_of_a_field_stands_twice_in_the_plan(spark):
    from ledgerloom.functions import patterns as P

    plan = extract_fields(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().optimizedPlan().toString()
    for p in (P.INVOICE_DATE[0], *P.NET[:1], *P.GROSS[:1], P.DESCRIPTION[0], P.SERVICE_DATE[0], P.VAT_RATE[0]):
        assert plan.count(P.FLAGS + p + ",") == 1, p


def test_folded_text_shows_letters_as_patterns_that_ignore_case_do(spark):
    """Long s, Kelvin sign and both odd i count as s, k and i; places stay those of the text."""
    texts = [
        "\u0130\u0130\u0130 😀\nRechnungsnummer: AB-1\nNETTOBETRAG: 5,00 eur", "Zwi\u017fchen\u017fumme 10,00\nUm\u017fatz\u017fteuer 1,90 EUR", "VER\u212aÄUFER: Ä GmbH\r\n Be\u017fchre\u0131bung: Öl \n\xa0An:\xa0 X AG",
        "Endbetrag 3,00 Gesamt 4,00", "xGesamt 4,00 Brutto-Betrag 2,00", "19,5 10 %\tUSt 7 % MwSt.: 8,00", "abcDatum 1.2.2020 Datum: 3.4.2021 Datum 5.6.22",
    ]
    a, b, c, d, e, f, g = fields(spark, *texts)
    assert (a.invoice_number, a.net_amount, a.currency) == ("AB-1", Decimal("5.00"), "eur") and (b.net_amount, b.vat_amount) == (Decimal("10.00"), Decimal("1.90"))
    assert (c.vendor_name, c.description, c.invoice_recipient) == ("Ä GmbH", "Öl", "X AG") and (d.gross_amount, e.gross_amount) == (Decimal("3.00"), None)
    assert f.vat_rate == Decimal("10.0000") and g.invoice_date == "2021-04-03"


def test_amounts_and_dates_are_read_from_folded_text(spark):
    from ledgerloom.functions import patterns as P

    plan = extract_fields(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert all(P.FLAGS + p in plan and p == p.lower().replace("[^\\s]", "[^\\S]") for p in P.FOLDED) and "(?iudUm)N" not in plan


def test_space_of_unicode_is_stripped(spark):
    from ledgerloom.functions.text import strip, strip_marks

    raw = " \xa0\r\n a　b\x1f \t "
    (r,) = spark.createDataFrame([(raw, " ,-\ta-b;: ")], "x string, y string").select(strip(F.col("x")), strip_marks(F.col("y"))).collect()
    assert tuple(r) == ("a　b\x1f", "a-b")


def test_dates_are_read_without_formatters(spark):
    from ledgerloom.functions import dates

    df = spark.createDataFrame([(1, "\xa01.2.2020\n"), (2, "31.4.2020"), (3, "2020-1-5"), (4, "1.1.69"), (5, None), (6, "29.2.1900")], "i int, x string").withColumn("d", dates.normalize_date(F.col("x")))
    assert [r.d for r in df.orderBy("i").collect()] == ["2020-02-01", None, "2020-01-05", "1969-01-01", None, None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "gettimestamp" not in plan
