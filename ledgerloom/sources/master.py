"""Master data: accounts, client, creditors, keyword rules.

Each list is read up to ``LIMIT`` rows, in its order, so what is put into plans as
literals stays of that size. Order carries meaning and is explicit: ``rank``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

LIMIT = 100
RECORD_LIMIT = 1000

# The chart of accounts, creditors, keyword rules and accounts of the booking conventions.
ACCOUNTS = [
    ("1571", "Abziehbare Vorsteuer 7%", "Vorsteuer"),
    ("1576", "Abziehbare Vorsteuer 19%", "Vorsteuer"),
    ("1600", "Verbindlichkeiten aus Lieferungen und Leistungen", "Kreditoren-Sammelkonto"),
    ("4240", "Energie / Nebenkosten", "Aufwand"),
    ("4250", "Reinigung", "Aufwand"),
    ("4260", "Instandhaltung / Reparaturen", "Aufwand"),
    ("4930", "Bürobedarf / Verwaltung", "Aufwand"),
    ("4950", "Rechts- und Beratungskosten", "Aufwand"),
]
CREDITORS = [
    ("K10001", "Beispiel Energie Saar GmbH", "Energieversorgung", "DE111111117", "4240", 19.0, "DE79100100100012345678"),
    ("K10002", "ImmoFix Musterservice GmbH", "Objektservice / Reparatur", "DE222222220", "4260", 19.0, "DE33100100100023456789"),
    ("K10003", "JurisMuster Beratung GmbH", "Rechts- und Beratung", "DE333333339", "4950", 19.0, "DE63100100100034567890"),
    ("K10004", "OfficeMuster Handels GmbH", "Bürobedarf", "DE444444443", "4930", 19.0, "DE98100100100045678901"),
]
KEYWORDS = [
    ("4240", ["strom", "electricity", "gas", "wasser", "water", "fernwärme", "district heating", "energie"]),
    ("4250", ["reinigung", "cleaning", "fensterreinigung", "window washing"]),
    ("4260", ["instandhaltung", "reparatur", "maintenance", "repair", "wartung", "technischer service"]),
    ("4930", ["bürobedarf", "office supplies", "papier", "paper", "stationary", "büromaterial"]),
    ("4950", ["rechtsberatung", "legal counsel", "steuerberatung", "tax advisory", "gutachten", "expert opinion", "beratung"]),
]
VAT_ACCOUNTS = [(19, "1576"), (7, "1571")]
PAYABLES = "1600"

#: The tenant on whose behalf invoices are booked; every installation loads its own.
CLIENTS = [("M0001", "Musterhaus Immobilien SPV 01 GmbH", "Gartenallee 12a", "99998", "Altstadt", "Deutschland", "DE123456788", "EUR", "calendar year")]

SCHEMAS = {
    "accounts": "rank int, account string, name string, category string",
    "clients": "rank int, client_id string, company_name string, street string, postal_code string, city string, country string, vat_id string, currency string, fiscal_year string",
    "creditors": "rank int, creditor_id string, name string, service_category string, vat_id string, default_expense_account string, default_vat_rate double, iban string",
    "keyword_rules": "rule_rank int, kw_rank int, account string, keyword string",
}


def frames(spark: SparkSession) -> dict[str, DataFrame]:
    """The built-in master data as data frames."""
    rows = {
        "accounts": [(i, *a) for i, a in enumerate(ACCOUNTS)],
        "clients": [(i, *c) for i, c in enumerate(CLIENTS)],
        "creditors": [(i, *c) for i, c in enumerate(CREDITORS)],
        "keyword_rules": [(i, j, account, word) for i, (account, words) in enumerate(KEYWORDS) for j, word in enumerate(words)],
    }
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}


def seed(spark: SparkSession, path: str) -> dict[str, int]:
    """Writes the built-in master data; running it again changes nothing. Returns rows by table."""
    made = frames(spark)
    for name, df in made.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: df.count() for name, df in made.items()}


def upsert(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``existing`` with rows of ``changes`` in place of those with their key."""
    return existing.join(changes.select(key), key, "left_anti").unionByName(changes)


@dataclass(frozen=True)
class Master:
    """Master data as small lists, in order; at most ``LIMIT`` rows each."""

    accounts: list[tuple[str, str]] = field(default_factory=lambda: [(a, n) for a, n, _ in ACCOUNTS])
    client_name: str = CLIENTS[0][1]
    creditors: list[tuple[str, str, str | None, str, str | None]] = field(default_factory=lambda: [(i, n, v, a, b) for i, n, _, v, a, _, b in CREDITORS])
    keywords: list[tuple[str, str]] = field(default_factory=lambda: [(a, w) for a, words in KEYWORDS for w in words])


def load(spark: SparkSession, path: str | None = None, fallback: bool = True) -> Master:
    """Master data of a folder; where it is missing or a list is empty, the built-in one, or an error without ``fallback``.

    Only the first client counts.
    """
    built = Master()
    if path is None:
        return built

    def read(name: str, *order: str) -> list:
        try:
            rows = spark.read.parquet(f"{path}/{name}").orderBy(*order).limit(LIMIT).collect()
        except Exception:
            if not fallback:
                raise
            return []
        return rows

    accounts, clients, creditors = read("accounts", "rank"), read("clients", "rank"), read("creditors", "rank")
    keywords = read("keyword_rules", "rule_rank", "kw_rank")
    return Master(
        [(r["account"], r["name"]) for r in accounts] or built.accounts,
        clients[0]["company_name"] if clients else built.client_name,
        [(r["creditor_id"], r["name"], r["vat_id"], r["default_expense_account"], r["iban"]) for r in creditors] or built.creditors,
        [(r["account"], r["keyword"]) for r in keywords] or built.keywords,
    )
