"""The registry of validation rules and what follows from them.

A rule is data: its name, severity, the status when it doesn't pass, and builders
of columns for the test, the two messages and the signed difference. Tests are columns
of their own, of which the traffic light is a fold; validations, an array of structs in the
order of the registry, add the messages, which cost nothing where nobody selects them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import fixed
from ..sources.master import Master
from . import matching

TOLERANCE = 0.02

# Fields that must be filled, and the texts of messages.
MANDATORY = ("invoice_number", "invoice_date", "net_amount", "vat_amount", "gross_amount", "currency")
HAPPY = "All formal, arithmetic, and master data validations passed successfully. Booking proposal generated automatically."
UNHAPPY = "One or more RED/YELLOW conditions were raised; happy-path automation is not authorized."
OVERRIDE = "Per Rule R0, critical failure overrides other indicators. Automatic ledger processing is blocked."
NO_BALANCE = "Cannot evaluate arithmetic balance: net, VAT, or gross amount is missing."
NO_VAT = "Cannot evaluate VAT plausibility: net amount, VAT rate, or VAT amount is missing."
NO_SERVICE_DATE = "No service date (Leistungsdatum) could be identified. Clerk review required per § 14 Abs. 4 Nr. 6 UStG."
NO_ACCOUNT = "Expense account could not be derived unambiguously. Clerk must confirm account assignment."


@dataclass(frozen=True)
class Context:
    """What rules see besides the extracted fields: master data, tolerance, and the columns of match and suggestion."""

    master: Master
    tolerance: float
    matched: Column
    suggested: Column


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    otherwise: str
    passes: Callable[[Context], Column]
    good: Callable[[Context], Column]
    bad: Callable[[Context], Column]
    delta: Callable[[Context], Column] | None = None


def _said(*parts: Column | str) -> Column:
    """Text from literals and columns; a null column reads None."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def _two(c: Column | str) -> Column:
    return fixed(F.col(c) if isinstance(c, str) else c)


def _all_there(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


AMOUNTS = ("net_amount", "vat_amount", "gross_amount")


def missing(names: tuple[str, ...] = MANDATORY) -> Column:
    """The names of fields that are null or empty, in order."""
    found = F.array(*[F.when(F.col(n).isNull() | (F.col(n).cast("string") == ""), F.lit(n)) for n in names])
    return F.filter(found, lambda x: x.isNotNull())


def balance_delta() -> Column:
    return F.col("net_amount") + F.col("vat_amount") - F.col("gross_amount")


def expected_vat() -> Column:
    return F.round(F.col("net_amount") * F.col("vat_rate") / 100, 2)


def vat_delta() -> Column:
    return F.when(_all_there(*AMOUNTS, "vat_rate"), expected_vat() - F.col("vat_amount"))


def _within(delta: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(delta) <= F.lit(tolerance).cast("decimal(18,6)"), F.lit(False))


def _limit(c: Context) -> Column:
    return fixed(F.lit(c.tolerance).cast("decimal(18,6)"))


REGISTRY = (
    Rule(
        "R1_Rechnungsempfänger", "RED", "FAIL",
        lambda c: matching.client_matches(F.col("invoice_recipient"), F.lit(c.master.client_name)),
        lambda c: _said("Recipient corresponds to target SPV: ", F.lit(c.master.client_name), "."),
        lambda c: _said("Extracted recipient ('", F.col("invoice_recipient"), "') does not match client master record ('", F.lit(c.master.client_name), "')."),
    ),
    Rule(
        "R2_Pflichtfelder", "RED", "FAIL",
        lambda c: F.size(missing()) == 0,
        lambda c: F.lit("All mandatory invoice fields are populated."),
        lambda c: _said("Missing mandatory field(s): ", F.array_join(missing(), ", "), "."),
    ),
    Rule(
        "R3_Betragsprüfung", "RED", "FAIL",
        lambda c: _within(balance_delta(), c.tolerance),
        lambda c: _said("Net (", _two("net_amount"), ") + VAT (", _two("vat_amount"), ") equals Gross (", _two("gross_amount"), "). Discrepancy: ", _two(F.abs(balance_delta())), " EUR."),
        lambda c: F.when(~_all_there(*AMOUNTS), F.lit(NO_BALANCE)).otherwise(
            _said("Arithmetic balance check failed: Net (", _two("net_amount"), ") + VAT (", _two("vat_amount"), ") = ", _two(F.col("net_amount") + F.col("vat_amount")), ", but Gross is ", _two("gross_amount"),
                  ". Delta of ", _two(F.abs(balance_delta())), " EUR exceeds tolerance of ", _limit(c), " EUR.")),
        lambda c: balance_delta(),
    ),
    Rule(
        "R4_USt_Plausibilität", "RED", "FAIL",
        lambda c: _within(vat_delta(), c.tolerance),
        lambda c: _said("VAT amount (", _two("vat_amount"), ") is consistent with ", fixed(F.col("vat_rate"), 1), "% applied to net (", _two("net_amount"), ")."),
        lambda c: F.when(~_all_there(*AMOUNTS, "vat_rate"), F.lit(NO_VAT)).otherwise(
            _said("VAT plausibility failed: expected ", _two(expected_vat()), " from ", fixed(F.col("vat_rate"), 1), "% of ", _two("net_amount"), ", but got ", _two("vat_amount"),
                  ". Delta ", _two(F.abs(vat_delta())), " EUR exceeds tolerance of ", _limit(c), " EUR.")),
        lambda c: vat_delta(),
    ),
    Rule(
        "R5_Leistungsdatum", "YELLOW", "WARN",
        lambda c: F.coalesce(F.col("service_date") != "", F.lit(False)),
        lambda c: _said("Service date identified: ", F.col("service_date"), "."),
        lambda c: F.lit(NO_SERVICE_DATE),
    ),
    Rule(
        "R6_Kreditorenstamm", "YELLOW", "WARN",
        lambda c: c.matched.isNotNull(),
        lambda c: _said("Vendor matched known creditor master data ID: ", c.matched["creditor_id"], "."),
        lambda c: _said("Vendor '", F.col("vendor_name"), "' not found in creditor master data. Onboarding workflow recommended."),
    ),
    Rule(
        "R7_Kontierung", "YELLOW", "WARN",
        lambda c: c.suggested["account"].isNotNull(),
        lambda c: _said("Plausible expense account derived from ", c.suggested["source"], ": ", c.suggested["account"], "."),
        lambda c: F.lit(NO_ACCOUNT),
    ),
)


def validation(name: str, severity: str, status: Column, details: Column, delta: Column | None = None) -> Column:
    d = (F.lit(None) if delta is None else delta).cast("decimal(18,4)")
    return F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), status.alias("status"), details.alias("details"), d.alias("delta"))


def light(validations: Column) -> Column:
    """RED if a RED check fails, else YELLOW if a YELLOW one warns or fails, else GREEN."""
    red = F.exists(validations, lambda v: (v["severity"] == "RED") & (v["status"] == "FAIL"))
    yellow = F.exists(validations, lambda v: (v["severity"] == "YELLOW") & v["status"].isin("WARN", "FAIL"))
    return F.when(red, F.lit("RED")).when(yellow, F.lit("YELLOW")).otherwise(F.lit("GREEN"))


def light_of(passed: list[Column], rules: tuple[Rule, ...] = REGISTRY) -> Column:
    """The same from the rules' tests alone."""

    def failing(severity: str, statuses: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [~p for p, r in zip(passed, rules, strict=True) if r.severity == severity and r.otherwise in statuses], F.lit(False))

    return F.when(failing("RED", ("FAIL",)), F.lit("RED")).when(failing("YELLOW", ("WARN", "FAIL")), F.lit("YELLOW")).otherwise(F.lit("GREEN"))


def reasons(passed: list[Column], context: Context, overall: Column, rules: tuple[Rule, ...] = REGISTRY) -> Column:
    """What led to the light, in the order of rules; messages are only made for rules that aren't passed."""

    def told(rule: Rule) -> Column:
        prefix = "Critical Rule Violation (" if rule.severity == "RED" else "Review Required ("
        return F.concat(F.lit(f"{prefix}{rule.name.split('_')[0]}): "), rule.bad(context))

    raising = [(p, r) for p, r in zip(passed, rules, strict=True) if (r.severity, r.otherwise) in (("RED", "FAIL"), ("YELLOW", "WARN"))]
    list_ = F.filter(F.array(*[F.when(~p, told(r)) for p, r in raising]), lambda x: x.isNotNull())
    return F.when(overall == "GREEN", F.array(F.lit(HAPPY))).when(overall == "RED", F.array_append(list_, F.lit(OVERRIDE))).otherwise(list_)


def evaluate(df: DataFrame, master: Master | None = None, tolerance: float = TOLERANCE, strip_forms: bool = False) -> DataFrame:
    """``df`` (the eleven fields) with validations, traffic_light, decision_reasons, blocked, suggestion and suggested_expense_account."""
    master = master or Master()
    step = df.withColumn("_matched", matching.creditor(master, F.col("vendor_name"), strip_forms=strip_forms))
    step = step.withColumn("suggestion", matching.suggestion(master, F.col("vendor_name"), F.col("description"), F.col("_matched")))
    context = Context(master, tolerance, F.col("_matched"), F.col("suggestion"))

    tests = [f"_passes{i}" for i in range(len(REGISTRY))]
    step = step.withColumns({t: F.coalesce(r.passes(context), F.lit(False)) for t, r in zip(tests, REGISTRY, strict=True)})

    def made(rule: Rule, good: Column) -> Column:
        status = F.when(good, F.lit("PASS")).otherwise(F.lit(rule.otherwise))
        return validation(rule.name, rule.severity, status, F.when(good, rule.good(context)).otherwise(rule.bad(context)), rule.delta and rule.delta(context))

    passed = [F.col(t) for t in tests]
    step = step.withColumn("traffic_light", light_of(passed))
    happy = F.col("traffic_light") == "GREEN"
    last = validation("R8_Happy_Path", "GREEN", F.when(happy, F.lit("PASS")).otherwise(F.lit("FAIL")), F.when(happy, F.lit(HAPPY)).otherwise(F.lit(UNHAPPY)))
    step = step.withColumn("validations", F.array(*[made(r, p) for p, r in zip(passed, REGISTRY, strict=True)], last))
    found = F.when(F.col("suggestion.account").isNotNull(), F.struct(F.col("suggestion.account").alias("account"), F.col("suggestion.name").alias("name")))
    return step.withColumns({"decision_reasons": reasons(passed, context, F.col("traffic_light")), "blocked": F.col("traffic_light") == "RED", "suggested_expense_account": found}).drop("_matched", *tests)
