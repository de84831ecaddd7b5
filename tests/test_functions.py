from datetime import datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import checksum, dates, money, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1.234", "1234"), ("1234.56", "1234.56"), ("1234,56", None), ("1,234.56", None), ("1e3", "1000"), (" 1.190,00 EUR", "1190"), ("5€", "5"), ("", None), ("x", None), ("-12,5", "-12.5")],
)
def test_parse_decimal(spark, raw, want):
    got = one(spark, raw, money.parse_decimal)
    assert got == (None if want is None else Decimal(want))


@pytest.mark.parametrize(("value", "want"), [("0.125", "0.12"), ("0.135", "0.14"), ("-0.001", "-0.00"), ("1234567.5", "1234567.50")])
def test_fixed_rounds_halves_to_even_without_grouping(spark, value, want):
    assert one(spark, Decimal(value), money.fixed, "decimal(18,6)") == want


def test_inferred_rate_needs_both_amounts(spark):
    rows = spark.createDataFrame([(Decimal("100"), Decimal("19")), (Decimal("0"), Decimal("1")), (Decimal("100"), Decimal("0")), (None, Decimal("1"))], "net decimal(18,2), vat decimal(18,2)")
    assert [r[0] for r in rows.select(money.inferred_rate(F.col("net"), F.col("vat"))).collect()] == [Decimal("19.0000"), None, None, None]


def test_dates_against_strptime(spark):
    def brute(raw):
        for shape in ("%d.%m.%Y", "%Y-%m-%d", "%d.%m.%y"):
            try:
                return datetime.strptime(raw.strip(), shape).date().isoformat()
            except ValueError:
                pass
        return None

    raws = ["15.03.2026", "5.3.2026", "2026-03-15", "2026-3-5", "31.02.2026", "01.01.68", "01.01.69", " 1.1.26 ", "x", "", "29.02.2023", "29.02.2024", "15.03.202"]
    got = spark.createDataFrame([(r,) for r in raws], "x string").select("x", dates.normalize_date(F.col("x")).alias("d")).collect()
    assert {r.x: r.d for r in got} == {r: brute(r) for r in raws}


def _vat_ok(digits: str) -> bool:
    p = 10
    for d in digits[:8]:
        p = 2 * ((int(d) + p) % 10 or 10) % 11
    return (11 - p) % 10 == int(digits[8])


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("0123456789", min_size=9, max_size=9), min_size=30, max_size=60))
def test_vat_checksum_against_loop(spark, many):
    got = spark.createDataFrame([(f"DE{d}",) for d in many], "x string").select("x", checksum.vat_id_valid(F.col("x")).alias("ok")).collect()
    assert all(r.ok == _vat_ok(r.x[2:]) for r in got)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.from_regex(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", fullmatch=True), min_size=20, max_size=40))
def test_iban_checksum_against_big_integers(spark, many):
    def brute(x):
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    good = []
    for x in many:  # with check digits that hold
        rest = int("".join(str(int(c, 36)) for c in x[4:] + x[:2] + "00")) % 97
        good.append(f"{x[:2]}{98 - rest:02d}{x[4:]}")
    got = spark.createDataFrame([(x,) for x in many + good], "x string").select("x", checksum.iban_valid(F.col("x")).alias("ok")).collect()
    assert all(r.ok == brute(r.x) for r in got) and sum(r.ok for r in got) >= len(good)


def test_quality_score(spark):
    score = lambda x: one(spark, x, text.quality_score)
    assert score(None) == score("") == score(" \n\t") == -1.0
    assert score("Rechnung Nr. 5, Betrag 100,00 EUR netto") > score("~~^^ \x7f ^^~~")
    assert one(spark, "äöü 日本 €·", text.printable_ratio) == 1.0


def test_lines_like_splitlines(spark):
    for raw in ("", "a", "a\nb\n", "a\r\nb\rc", "\n\n", "x\x0by\x85z "):
        got = one(spark, raw, text.lines)
        assert got == raw.splitlines(), raw
