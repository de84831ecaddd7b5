"""Double-entry booking lines and their balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BOOKING_LINE
from ..sources.master import PAYABLES, Master
from .matching import account_name, vat_account

TOLERANCE = 0.02


def proposal(account: Column, net: Column, vat: Column, rate: Column, gross: Column, master: Master | None = None) -> Column:
    """Three lines: expense and input VAT in debit, payables in credit; none without an account."""
    master = master or Master()

    def line(side: str, code: Column, amount: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), code.alias("account"), account_name(master, code).alias("name"), amount.cast("decimal(18,2)").alias("amount"))

    lines = F.array(line("DEBIT", account, net), line("DEBIT", vat_account(rate), vat), line("CREDIT", F.lit(PAYABLES), gross))
    return F.when(account.isNull(), F.array()).otherwise(lines).cast(f"array<{BOOKING_LINE}>")


def with_proposal(df: DataFrame, master: Master | None = None) -> DataFrame:
    """``df`` as the rules leave it, with booking_proposal: empty if blocked or if an account or amount is missing."""
    account = F.col("suggested_expense_account.account")
    inputs = [F.col(c) for c in ("net_amount", "vat_amount", "vat_rate", "gross_amount")]
    open_ = ~F.col("blocked") & account.isNotNull()
    for c in inputs:
        open_ = open_ & c.isNotNull()
    lines = proposal(account, F.col("net_amount"), F.col("vat_amount"), F.col("vat_rate"), F.col("gross_amount"), master)
    return df.withColumn("booking_proposal", F.when(open_, lines).otherwise(F.array().cast(f"array<{BOOKING_LINE}>")))


def booking_lines(df: DataFrame, key: str = "invoice_id") -> DataFrame:
    """The lines of all proposals as rows."""
    return df.select(key, F.inline("booking_proposal"))


def balanced(lines: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether debit and credit differ by at most the tolerance; no lines are balanced."""
    zero = F.lit(0).cast("decimal(38,2)")

    def total(side: str) -> Column:
        return F.aggregate(F.filter(lines, lambda x: x["side"] == side), zero, lambda a, x: (a + x["amount"]).cast("decimal(38,2)"))

    return F.abs(total("DEBIT") - total("CREDIT")) <= F.lit(tolerance).cast("decimal(18,6)")


def balance_check(lines: DataFrame, key: str = "invoice_id", tolerance: float = TOLERANCE) -> DataFrame:
    """key, debit, credit and balanced of booking lines given as rows."""
    sums = lines.groupBy(key).agg(*[F.sum(F.when(F.col("side") == s, F.col("amount")).otherwise(F.lit(0).cast("decimal(18,2)"))).alias(s.lower()) for s in ("DEBIT", "CREDIT")])
    return sums.withColumn("balanced", F.abs(F.col("debit") - F.col("credit")) <= F.lit(tolerance).cast("decimal(18,6)"))


def trial_balance(lines: DataFrame) -> DataFrame:
    """account, name, debit, credit and number of lines over all booking lines."""
    sums = [F.sum(F.when(F.col("side") == s, F.col("amount")).otherwise(F.lit(0).cast("decimal(18,2)"))).alias(s.lower()) for s in ("DEBIT", "CREDIT")]
    return lines.groupBy("account", "name").agg(*sums, F.count("*").alias("n_lines"))
