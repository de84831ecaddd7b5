"""DuckDB twins of the registered queries, on the same tables.

What the twins expect stands here; of the engine they take the literal inputs of queries alone.
"""

from __future__ import annotations

from . import oracle_invoices
from .fixtures import CANDIDATES, DATES, IBANS, JSON_ANSWERS, NUMBERS, RECORDS, SENSITIVE, VAT_IDS, VENDORS

# Chart of accounts, client, creditors, keywords and messages of the booking conventions.
_ACCOUNTS = [
    ("1571", "Abziehbare Vorsteuer 7%", "Vorsteuer"),
    ("1576", "Abziehbare Vorsteuer 19%", "Vorsteuer"),
    ("1600", "Verbindlichkeiten aus Lieferungen und Leistungen", "Kreditoren-Sammelkonto"),
    ("4240", "Energie / Nebenkosten", "Aufwand"),
    ("4250", "Reinigung", "Aufwand"),
    ("4260", "Instandhaltung / Reparaturen", "Aufwand"),
    ("4930", "Bürobedarf / Verwaltung", "Aufwand"),
    ("4950", "Rechts- und Beratungskosten", "Aufwand"),
]
_CLIENT = "Musterhaus Immobilien SPV 01 GmbH"
_CREDITOR_ROWS = [
    ("K10001", "Beispiel Energie Saar GmbH", "4240", "DE111111117", "DE79100100100012345678"),
    ("K10002", "ImmoFix Musterservice GmbH", "4260", "DE222222220", "DE33100100100023456789"),
    ("K10003", "JurisMuster Beratung GmbH", "4950", "DE333333339", "DE63100100100034567890"),
    ("K10004", "OfficeMuster Handels GmbH", "4930", "DE444444443", "DE98100100100045678901"),
]
_HAPPY = "All formal, arithmetic, and master data validations passed successfully. Booking proposal generated automatically."
_OVERRIDE = "Per Rule R0, critical failure overrides other indicators. Automatic ledger processing is blocked."
_NO_BALANCE = "Cannot evaluate arithmetic balance: net, VAT, or gross amount is missing."
_NO_VAT = "Cannot evaluate VAT plausibility: net amount, VAT rate, or VAT amount is missing."
_NO_SERVICE_DATE = "No service date (Leistungsdatum) could be identified. Clerk review required per § 14 Abs. 4 Nr. 6 UStG."
_NO_ACCOUNT = "Expense account could not be derived unambiguously. Clerk must confirm account assignment."
_HINTS = "rechnung|nummer|datum|betrag|eur|ust|mwst|netto|brutto|iban|gmbh|steuer|leistung|empf[aä]nger|w[aä]hrung|kunden"

# What a reader takes from the eight layouts: fields, then the decision.
_FIELDS = [
    ("1", _CLIENT, "Beispiel Energie Saar GmbH", "SW/2025-774", "2025-11-03", "2025-10-01", "EUR", "412.50", "19", "78.38", "490.88", "Wärmelieferung Haus B, Oktober"),
    ("2", _CLIENT, "ImmoFix Musterservice GmbH", "R25-0099", "2025-11-07", "2025-11-06", "EUR", "88.00", "19", "16.72", "104.72", "Türschließer eingestellt"),
    ("3", _CLIENT, "ImmoFix Musterservice GmbH", "R25-0100", "2025-11-09", "2025-11-08", "EUR", "200.00", "19", "38.00", "250.00", "Dachrinne gereinigt"),
    ("4", _CLIENT, "OfficeMuster Handels GmbH", "OFF-5", "2025-11-21", None, "EUR", "60.00", "7", "4.20", "64.20", "Fachbuch Mietrecht"),
    ("5", _CLIENT, "ImmoFix Musterservice GmbH", "A7/311", "2025-12-19", "2025-12-19", "EUR", "250.00", "19", "47.50", "297.50", None),
    ("6", _CLIENT, "Sauberfee Treppenglanz GmbH", "2025-W-17", "2025-12-14", "2025-12-13", "EUR", "240.00", "19", "45.60", "285.60", "Fensterreinigung Treppenhaus"),
    ("7", _CLIENT, "JURISMUSTER BERATUNG GMBH", "K-2025/58", "2025-12-01", "2025-11-28", "EUR", "1250.00", "19", "237.50", "1487.50", "Gutachten zur Nebenkostenabrechnung"),
    ("8", _CLIENT, "GRÜNER Beispiel Energie Saar GmbH", "GS-40210", "2025-12-05", "2025-12-05", "EUR", "90.00", "19", "17.10", "107.10", None),
]
_PASS = "PASS,PASS,PASS,PASS,PASS,PASS,PASS,PASS"
_SUM_OFF = "Critical Rule Violation (R3): Arithmetic balance check failed: Net (200.00) + VAT (38.00) = 238.00, but Gross is 250.00. Delta of 12.00 EUR exceeds tolerance of 0.02 EUR."
_NO_CREDITOR = "Review Required (R6): Vendor 'Sauberfee Treppenglanz GmbH' not found in creditor master data. Onboarding workflow recommended."
_DECIDED = [
    ("1", "GREEN", "4240", _PASS, "DEBIT 4240 412.50; DEBIT 1576 78.38; CREDIT 1600 490.88", _HAPPY),
    ("2", "GREEN", "4260", _PASS, "DEBIT 4260 88.00; DEBIT 1576 16.72; CREDIT 1600 104.72", _HAPPY),
    ("3", "RED", "4260", "PASS,PASS,FAIL,PASS,PASS,PASS,PASS,FAIL", "", f"{_SUM_OFF} | {_OVERRIDE}"),
    ("4", "YELLOW", "4930", "PASS,PASS,PASS,PASS,WARN,PASS,PASS,FAIL", "DEBIT 4930 60.00; DEBIT 1571 4.20; CREDIT 1600 64.20", f"Review Required (R5): {_NO_SERVICE_DATE}"),
    ("5", "GREEN", "4260", _PASS, "DEBIT 4260 250.00; DEBIT 1576 47.50; CREDIT 1600 297.50", _HAPPY),
    ("6", "YELLOW", "4250", "PASS,PASS,PASS,PASS,PASS,WARN,PASS,FAIL", "DEBIT 4250 240.00; DEBIT 1576 45.60; CREDIT 1600 285.60", _NO_CREDITOR),
    ("7", "GREEN", "4950", _PASS, "DEBIT 4950 1250.00; DEBIT 1576 237.50; CREDIT 1600 1487.50", _HAPPY),
    ("8", "GREEN", "4240", _PASS, "DEBIT 4240 90.00; DEBIT 1576 17.10; CREDIT 1600 107.10", _HAPPY),
]


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _values(rows: list, *names: str) -> str:
    cells = ", ".join("(" + ", ".join(str(c) if isinstance(c, int) else _text(c) for c in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(VALUES {cells}) AS v({', '.join(names)})"


_NAMES = "(VALUES " + ", ".join(f"({_text(a)}, {_text(n)})" for a, n, _ in _ACCOUNTS) + ") AS n(account, name)"


def _orders(perturbed: bool = True) -> str:
    gross = "net_amount + vat_amount + CASE WHEN o_orderkey % 10 = 0 THEN 25 ELSE 0 END" if perturbed else "o_totalprice::DECIMAL(18,2)"
    return f"""lines AS (
  SELECT l_orderkey, (l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(18,4) AS net, l_tax::DECIMAL(4,2) AS tax FROM lineitem),
sums AS (
  SELECT l_orderkey, sum(net)::DECIMAL(18,2) AS net_amount, sum((net * tax)::DECIMAL(18,6))::DECIMAL(18,2) AS vat_amount FROM lines GROUP BY 1),
facts AS (
  SELECT o_orderkey, o_orderpriority, net_amount, vat_amount, ({gross})::DECIMAL(18,2) AS gross_amount,
         CASE WHEN o_orderkey % 7 = 0 THEN 7 ELSE 19 END AS rate
  FROM orders JOIN sums ON o_orderkey = l_orderkey)"""


_OK = "abs(net_amount + vat_amount - gross_amount) <= 0.02"
_BOOKED = f"""{_orders()},
proposals AS (
  SELECT *, ['4240', '4250', '4260', '4930', '9999'][o_orderkey % 5 + 1] AS expense, CASE rate WHEN 7 THEN '1571' ELSE '1576' END AS tax_account FROM facts WHERE {_OK}),
plain AS (
  SELECT o_orderkey, 'DEBIT' AS side, expense AS account, net_amount AS amount FROM proposals
  UNION ALL SELECT o_orderkey, 'DEBIT', tax_account, vat_amount FROM proposals
  UNION ALL SELECT o_orderkey, 'CREDIT', '1600', gross_amount FROM proposals),
booked AS (SELECT p.*, coalesce(n.name, p.account) AS name FROM plain p LEFT JOIN {_NAMES} ON p.account = n.account)"""


def _light_summary(light: str, perturbed: bool) -> str:
    return f"""WITH {_orders(perturbed)}
SELECT light, count(*) AS n, sum(net_amount)::DOUBLE AS net, sum(gross_amount)::DOUBLE AS gross
FROM (SELECT *, {light} AS light FROM facts) GROUP BY light"""


_KEYWORDS = [(i, a, w) for i, (a, w) in enumerate(oracle_invoices.KEYWORDS)]
_RULES = list(dict.fromkeys(a for a, _ in oracle_invoices.KEYWORDS))
_CREDITORS = [(i, c[0], c[1]) for i, c in enumerate(_CREDITOR_ROWS)]
_LOOSE = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
_GERMAN = r"'^\s*-?\d{1,3}(?:\.\d{3})*(?:,\d+)?\s*$'"
_PARSED = f"""try_cast(CASE WHEN regexp_matches(s, {_GERMAN}) THEN replace(replace(s, '.', ''), ',', '.') ELSE s END AS DECIMAL(18,6))"""
_BARE = "trim(replace(replace(trim(x), '€', ''), 'EUR', ''))"


def _score(t: str) -> str:
    return f"""CASE WHEN {t} IS NULL OR trim({t}, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN -1.0 ELSE
  (len(regexp_extract_all({t}, '(?i){_HINTS}')) * 10
   + length(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\s.,\\-:/%€·]', '', 'g'))::DOUBLE / length({t}) * 5
   + least(length({t}), 2000) * 0.001::DOUBLE) END"""


_CHECK_VAT = """regexp_full_match(x, 'DE[0-9]{9}') AND (11 - list_reduce(list_prepend(10, list_transform(string_split(substr(x, 3, 8), ''), lambda d: try_cast(d AS INTEGER))),
  lambda p, d: (2 * CASE WHEN (d + p) % 10 = 0 THEN 10 ELSE (d + p) % 10 END) % 11)) % 10 = try_cast(substr(x, 11, 1) AS INTEGER)"""
_CHECK_IBAN = """regexp_full_match(i, '[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}') AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(i, 5) || substr(i, 1, 4), ''),
  lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN try_cast(c AS BIGINT) ELSE ascii(c) - 55 END)),
  lambda a, d: (CASE WHEN d < 10 THEN a * 10 + d ELSE a * 100 + d END) % 97) = 1"""

_REASONS = f"""
WITH raw AS (SELECT * FROM {_values(RECORDS, 'invoice_id', 'recipient', 'vendor', 'number', 'idate', 'sdate', 'currency', 'net', 'rate', 'vat', 'gross', 'what')}),
r AS (SELECT * REPLACE (net::DECIMAL(18,2) AS net, rate::DECIMAL(9,4) AS rate, vat::DECIMAL(18,2) AS vat, gross::DECIMAL(18,2) AS gross) FROM raw),
c AS (SELECT * FROM {_values(_CREDITORS, 'rank', 'id', 'name')}),
k AS (SELECT * FROM {_values(_KEYWORDS, 'rank', 'account', 'keyword')}),
words AS (SELECT DISTINCT invoice_id FROM r, k WHERE contains(lower(coalesce(vendor, '') || ' ' || coalesce(what, '')), keyword)),
known AS (SELECT DISTINCT invoice_id FROM r JOIN c ON lower(trim(vendor)) = lower(name)),
f AS (
  SELECT r.*, round(net * rate / 100, 2)::DECIMAL(18,2) AS expected, known.invoice_id IS NOT NULL AS creditor, words.invoice_id IS NOT NULL AS word,
    coalesce(contains(lower(recipient), lower({_text(_CLIENT)})), false) AS ok1,
    concat_ws(', ', CASE WHEN number IS NULL THEN 'invoice_number' END, CASE WHEN idate IS NULL THEN 'invoice_date' END, CASE WHEN net IS NULL THEN 'net_amount' END,
      CASE WHEN vat IS NULL THEN 'vat_amount' END, CASE WHEN gross IS NULL THEN 'gross_amount' END, CASE WHEN currency IS NULL THEN 'currency' END) AS lacks
  FROM r LEFT JOIN words USING (invoice_id) LEFT JOIN known USING (invoice_id)),
g AS (
  SELECT invoice_id, list_filter([
    CASE WHEN NOT ok1 THEN 'Critical Rule Violation (R1): Extracted recipient (''' || coalesce(recipient, 'None') || ''') does not match client master record (''' || {_text(_CLIENT)} || ''').' END,
    CASE WHEN lacks <> '' THEN 'Critical Rule Violation (R2): Missing mandatory field(s): ' || lacks || '.' END,
    CASE WHEN net + vat + gross IS NULL THEN 'Critical Rule Violation (R3): ' || {_text(_NO_BALANCE)}
      WHEN abs(net + vat - gross) > 0.02 THEN 'Critical Rule Violation (R3): Arithmetic balance check failed: Net (' || net || ') + VAT (' || vat || ') = ' || (net + vat) || ', but Gross is ' || gross
        || '. Delta of ' || abs(net + vat - gross) || ' EUR exceeds tolerance of 0.02 EUR.' END,
    CASE WHEN net + vat + gross + rate IS NULL THEN 'Critical Rule Violation (R4): ' || {_text(_NO_VAT)}
      WHEN abs(expected - vat) > 0.02 THEN 'Critical Rule Violation (R4): VAT plausibility failed: expected ' || expected || ' from ' || printf('%.1f', rate::DOUBLE) || '% of ' || net || ', but got ' || vat
        || '. Delta ' || abs(expected - vat) || ' EUR exceeds tolerance of 0.02 EUR.' END,
    CASE WHEN sdate IS NULL THEN 'Review Required (R5): ' || {_text(_NO_SERVICE_DATE)} END,
    CASE WHEN NOT creditor THEN 'Review Required (R6): Vendor ''' || coalesce(vendor, 'None') || ''' not found in creditor master data. Onboarding workflow recommended.' END,
    CASE WHEN NOT creditor AND NOT word THEN 'Review Required (R7): ' || {_text(_NO_ACCOUNT)} END], lambda x: x IS NOT NULL) AS told FROM f),
l AS (SELECT *, CASE WHEN len(list_filter(told, lambda x: x LIKE 'Critical%')) > 0 THEN 'RED' WHEN len(told) > 0 THEN 'YELLOW' ELSE 'GREEN' END AS traffic_light FROM g)
SELECT invoice_id, traffic_light, traffic_light = 'RED' AS blocked,
  CASE traffic_light WHEN 'GREEN' THEN {_text(_HAPPY)} WHEN 'RED' THEN array_to_string(told, ' | ') || ' | ' || {_text(_OVERRIDE)} ELSE array_to_string(told, ' | ') END AS reasons FROM l"""

def _order_fields() -> str:
    """CTEs up to i: orders as invoices."""
    return f"""WITH {_orders()},
base AS (
  SELECT o_orderkey AS k, net_amount AS net, rate, (round(net_amount * rate * 0.01, 2) + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END)::DECIMAL(18,2) AS vat,
    CASE WHEN o_orderkey % 13 = 0 THEN 'Andere Firma GmbH' ELSE 'z. Hd. {_CLIENT}' END AS recipient,
    [' beispiel ENERGIE saar gmbh', 'ImmoFix', 'JurisMuster Beratung GmbH', 'Office-Muster Handels', 'Stadtwerke Nord AG', 'Unbekannt OHG'][o_orderkey % 6 + 1] AS vendor,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey::VARCHAR END AS number, strftime(d.o_orderdate, '%Y-%m-%d') AS idate, 'EUR' AS currency, CASE WHEN o_orderpriority NOT LIKE '4%' THEN strftime(d.o_orderdate, '%Y-%m-%d') END AS sdate,
    ['Strom und Gas', 'Reparatur Heizung', NULL, 'Papier', 'Sonstiges'][o_orderkey % 5 + 1] AS what
  FROM facts JOIN (SELECT o_orderkey, o_orderdate FROM orders) d USING (o_orderkey)),
i AS (SELECT *, (net + vat + CASE WHEN k % 10 = 0 THEN 25 ELSE 0 END)::DECIMAL(18,2) AS gross FROM base)"""


_PATCHED = """j AS (
  SELECT * REPLACE ((net + vat)::DECIMAL(18,2) AS gross, '2026-01-02' AS sdate, CASE WHEN k % 8 = 0 THEN NULL ELSE 'Wartung' END AS what) FROM i WHERE k % 4 = 0)"""


def _masked(source: str, key: str) -> str:
    """CTEs up to m4 (key, t, n1 to n4) that mask the texts t of a source, kind after kind."""
    vat = """regexp_full_match(x, 'DE[0-9]{9}') AND (11 - list_reduce(list_prepend(10, list_transform(string_split(substr(x, 3, 8), ''), lambda d: try_cast(d AS INTEGER))),
      lambda a, d: (2 * CASE WHEN (d + a) % 10 = 0 THEN 10 ELSE (d + a) % 10 END) % 11)) % 10 = try_cast(substr(x, 11, 1) AS INTEGER)"""
    iban = """list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(x, 5) || substr(x, 1, 4), ''),
      lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN try_cast(c AS BIGINT) ELSE ascii(c) - 55 END)), lambda a, d: (CASE WHEN d < 10 THEN a * 10 + d ELSE a * 100 + d END) % 97) = 1"""
    kinds = [
        ("VAT_ID", r"\bDE[0-9]{9}\b", vat), ("IBAN", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b", iban),
        ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "true"), ("PHONE", r"\b(?:\+49|0)[\d\s/()-]{6,}\d\b", "true"),
    ]
    out, held = [], [key]
    for k, (kind, pattern, check) in enumerate(kinds, 1):
        before = source if k == 1 else f"m{k - 1}"
        kept = ", ".join(held)
        out.append(f"""s{k} AS (SELECT {kept}, string_split_regex(t, '{pattern}') AS parts, regexp_extract_all(t, '{pattern}') AS hits FROM {before}),
o{k} AS (SELECT *, list_transform(hits, lambda x: {check}) AS ok FROM s{k}),
m{k} AS (
  SELECT {kept}, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || CASE WHEN i > len(hits) THEN '' WHEN ok[i] THEN '<{kind}_' || len(list_filter(ok[1:i], lambda b: b)) || '>' ELSE hits[i] END), '') AS t,
    len(list_filter(ok, lambda b: b)) AS n{k} FROM o{k})""")
        held.append(f"n{k}")
    return ",\n".join(out)


_COUNTS = "coalesce(n1, 0) AS vat_id, coalesce(n2, 0) AS iban, coalesce(n3, 0) AS email, coalesce(n4, 0) AS phone"

SQL = {
    "rule_reasons": _REASONS,
    "invoice_light_summary": _light_summary(f"CASE WHEN {_OK} THEN 'GREEN' ELSE 'RED' END", False),
    "invoice_light_perturbed": f"""{_order_fields()}, {oracle_invoices.judged("i")}
SELECT light, count(*) AS n, sum(CASE WHEN open THEN 3 ELSE 0 END)::BIGINT AS n_lines, sum(net)::DOUBLE AS net, sum(gross)::DOUBLE AS gross FROM p GROUP BY light""",
    "invoice_decisions": f"""{_order_fields()}, {oracle_invoices.judged("i")}
SELECT k::VARCHAR AS invoice_id, statuses, vat_delta::DOUBLE AS vat_delta, light AS traffic_light, light = 'RED' AS blocked, len(reasons)::BIGINT AS n_reasons, array_to_string(reasons, ' | ') AS reasons,
  p.account, n.name, CASE WHEN r6 THEN 'creditor_master' WHEN r7 THEN 'keyword_heuristic' ELSE 'unresolved' END AS source, CASE WHEN r6 THEN 'high' WHEN r7 THEN 'medium' ELSE 'low' END AS confidence,
  creditor AS creditor_id, word AS keyword, {oracle_invoices.LINES}
FROM p LEFT JOIN {_NAMES} ON p.account = n.account""",
    "audit_log_events": f"""{_order_fields()}, {_PATCHED}, {oracle_invoices.judged("j")}
SELECT k::VARCHAR AS invoice_id, 'upload' AS action, k::VARCHAR AS filename, NULL AS light, NULL AS description FROM i
UNION ALL SELECT k::VARCHAR, 'revalidate', NULL, light, what FROM p""",
    "extract_fields_fixtures": "SELECT * REPLACE (net_amount::DOUBLE AS net_amount, vat_rate::DOUBLE AS vat_rate, vat_amount::DOUBLE AS vat_amount, gross_amount::DOUBLE AS gross_amount) FROM "
    + _values(_FIELDS, "doc", "invoice_recipient", "vendor_name", "invoice_number", "invoice_date", "service_date", "currency", "net_amount", "vat_rate", "vat_amount", "gross_amount", "description"),
    "process_fixtures": "SELECT invoice_id, vendor_name, traffic_light, traffic_light = 'RED' AS blocked, account, statuses, lines, reasons FROM "
    + _values([(d[0], f[2], *d[1:]) for d, f in zip(_DECIDED, _FIELDS, strict=True)], "invoice_id", "vendor_name", "traffic_light", "account", "statuses", "lines", "reasons"),
    "booking_lines": f"WITH {_BOOKED} SELECT o_orderkey, side, account, name, amount::DOUBLE AS amount FROM booked",
    "trial_balance": f"""WITH {_BOOKED}
SELECT account, name, count(*) AS n_lines, sum(CASE WHEN side = 'DEBIT' THEN amount ELSE 0 END)::DOUBLE AS debit, sum(CASE WHEN side = 'CREDIT' THEN amount ELSE 0 END)::DOUBLE AS credit
FROM booked GROUP BY account, name""",
    "balance_check": f"""WITH {_BOOKED}, totals AS (
  SELECT o_orderkey, sum(CASE WHEN side = 'DEBIT' THEN amount ELSE 0 END) AS d, sum(CASE WHEN side = 'CREDIT' THEN amount ELSE 0 END) AS c FROM booked GROUP BY 1)
SELECT o_orderkey, abs(d - c) <= 0.02 AS balanced, d::DOUBLE AS debit, c::DOUBLE AS credit FROM totals""",
    "mandatory_fields": """
WITH f AS (
  SELECT CASE WHEN o_orderkey % 3 <> 0 THEN 'x' END AS a, CASE WHEN o_orderkey % 5 = 0 OR o_orderdate IS NULL THEN '' ELSE 'x' END AS b, o_totalprice AS c,
         CASE WHEN o_orderkey % 11 <> 0 THEN 0.0 END AS d, o_totalprice AS e, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'EUR' END AS g
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT missing, count(*) AS n FROM (
  SELECT concat_ws(', ', CASE WHEN a IS NULL THEN 'invoice_number' END, CASE WHEN b = '' THEN 'invoice_date' END, CASE WHEN c IS NULL THEN 'net_amount' END,
    CASE WHEN d IS NULL THEN 'vat_amount' END, CASE WHEN e IS NULL THEN 'gross_amount' END, CASE WHEN g IS NULL THEN 'currency' END) AS missing FROM f) GROUP BY missing""",
    "vat_account_nearest": """
SELECT rate::DOUBLE AS rate, CASE WHEN abs(rate - 19) <= abs(rate - 7) THEN '1576' ELSE '1571' END AS account, count(*) AS n
FROM (SELECT l_linenumber * 3 + round(l_tax * 100) AS rate FROM lineitem) GROUP BY 1, 2""",
    "creditor_exact": """
WITH c AS (SELECT s_suppkey AS rank, 'K' || s_suppkey AS id, lower(trim(s_name)) AS name, 'DE' || lpad(s_suppkey::VARCHAR, 9, '0') AS vat, 'DE79' || s_suppkey AS iban FROM supplier WHERE s_suppkey % 2 = 0),
v AS (SELECT s_suppkey AS key, lower(trim(s_name)) AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'DE' || lpad((s_suppkey + 1)::VARCHAR, 9, '0') END AS vat, CASE WHEN s_suppkey % 5 = 0 THEN 'DE79' || (s_suppkey - 1) END AS iban FROM supplier),
hits AS (SELECT key, c.rank, c.id FROM v JOIN c ON v.name = c.name UNION ALL SELECT key, c.rank, c.id FROM v JOIN c ON v.vat = c.vat UNION ALL SELECT key, c.rank, c.id FROM v JOIN c ON v.iban = c.iban)
SELECT v.key, h.id AS creditor_id FROM v LEFT JOIN (SELECT key, arg_min(id, rank) AS id FROM hits GROUP BY key) h ON v.key = h.key""",
    "creditor_fuzzy": f"""
WITH v AS (SELECT * FROM {_values(VENDORS, 'vendor')}),
c AS (SELECT * FROM {_values(_CREDITORS, 'rank', 'id', 'name')}),
hits AS (
  SELECT vendor, rank, id, 0 AS pass FROM v JOIN c ON lower(trim(vendor)) = lower(trim(name)) AND vendor <> ''
  UNION ALL SELECT vendor, rank, id, 1 FROM v JOIN c ON length({_LOOSE.format('vendor')}) >= 6
    AND (contains({_LOOSE.format('vendor')}, {_LOOSE.format('name')}) OR contains({_LOOSE.format('name')}, {_LOOSE.format('vendor')})))
SELECT v.vendor, h.id AS creditor_id FROM v LEFT JOIN (SELECT vendor, arg_min(id, pass * 1000 + rank) AS id FROM hits GROUP BY vendor) h ON v.vendor = h.vendor""",
    "keyword_account": f"""
WITH k AS (SELECT * FROM {_values(_KEYWORDS, 'rank', 'account', 'keyword')}),
best AS (SELECT doc_id, min(rank) AS rank FROM documents, k WHERE contains(lower(text), keyword) GROUP BY doc_id)
SELECT coalesce(account, 'none') AS account, coalesce(keyword, 'none') AS keyword, count(*) AS n
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id LEFT JOIN k ON b.rank = k.rank GROUP BY 1, 2""",
    "parse_german_decimal": f"SELECT x, {_PARSED}::DOUBLE AS value FROM (SELECT x, {_BARE} AS s FROM {_values(NUMBERS, 'x')})",
    "normalize_dates": f"""
SELECT x, strftime(coalesce(
    CASE WHEN regexp_full_match(s, '[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{4}}') THEN try_strptime(s, '%d.%m.%Y') END,
    CASE WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN try_strptime(s, '%Y-%m-%d') END,
    CASE WHEN regexp_full_match(s, '[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{2}}') THEN try_strptime(
      regexp_extract(s, '^(.*\\.)', 1) || CASE WHEN right(s, 2) < '69' THEN '20' ELSE '19' END || right(s, 2), '%d.%m.%Y') END), '%Y-%m-%d') AS value
FROM (SELECT x, trim(x) AS s FROM {_values(DATES, 'x')})""",
    "vat_checksum": f"SELECT x, {_CHECK_VAT} AS valid FROM {_values(VAT_IDS, 'x')}",
    "iban_checksum": f"SELECT x, {_CHECK_IBAN} AS valid FROM (SELECT x, upper(replace(x, ' ', '')) AS i FROM {_values(IBANS, 'x')})",
    "text_quality_score": f"SELECT doc_id, round({_score('text')}, 6) AS score FROM documents",
    "best_engine": f"""
WITH c AS (
  SELECT doc_id AS doc, 0 AS rank, 'pdfplumber' AS engine, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'aeinr', '^~^~^') ELSE text END AS t FROM documents
  UNION ALL SELECT doc_id, 1, 'pymupdf', CASE WHEN doc_id % 2 = 0 THEN NULL ELSE text END FROM documents
  UNION ALL SELECT doc_id, 2, 'ocr', substr(text, 1, 100) FROM documents),
s AS (SELECT *, {_score('t')} AS score FROM c)
SELECT doc, engine, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, rank) AS k FROM s) WHERE k = 1""",
    "best_engine_fixture": f"""
SELECT doc, engine FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY {_score('t')} DESC, rank) AS k FROM {_values(CANDIDATES, 'doc', 'rank', 'engine', 't')}) WHERE k = 1""",
    "pii_email_mask": f"""
WITH src AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'DE' || lpad(doc_id::VARCHAR, 9, '0') || ' DE999999995 DE4450010517' || lpad(lpad(doc_id::VARCHAR, 9, '0'), 10, '0') || ' DE79100100100012345678 tel 0681/' || lpad(doc_id::VARCHAR, 9, '0') || ' ' ELSE '' END || text AS t
  FROM documents), {_masked("src", "doc_id")}
SELECT doc_id, {_COUNTS}, sha256(t) AS masked_sha256 FROM m4""",
    "pii_counts": f"WITH src AS (SELECT x, x AS t FROM {_values(SENSITIVE, 'x')}), {_masked('src', 'x')} SELECT x, t AS masked, {_COUNTS} FROM m4",
    "pii_roundtrip": "SELECT count(text) AS n, count(text) AS n_same FROM documents",
    "revalidate_overlay": f"""{_order_fields()}, {_PATCHED}, {oracle_invoices.judged("j")}
SELECT k::VARCHAR AS invoice_id, 'revalidated' AS outcome, gross::DOUBLE AS gross, sdate AS service_date, what AS description, light AS traffic_light, CASE WHEN open THEN 3 ELSE 0 END::BIGINT AS n_lines FROM p
UNION ALL SELECT k::VARCHAR, 'quarantined', NULL, NULL, NULL, NULL, NULL FROM i WHERE k % 12 = 0""",
    "invoice_labels": """
SELECT o_orderkey, 'Rechnung-' || CASE WHEN n < 100000 THEN lpad(n::VARCHAR, 5, '0') ELSE n::VARCHAR END AS label
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 50 <> 0 THEN coalesce(o_orderdate, TIMESTAMP '1970-01-01') ELSE TIMESTAMP '1970-01-01' END, o_orderkey) AS n FROM orders)""",
    "audit_event_windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "audit_event_sessions": """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS n_sessions, max(n) AS most FROM c GROUP BY 1""",
    "llm_json_coerce": f"""
WITH b AS (SELECT x, trim(regexp_replace(trim(x), '^```(?:json)?|```$', '', 'g'), ' ' || chr(10)) AS j FROM {_values(JSON_ANSWERS, 'x')}),
o AS (SELECT x, CASE WHEN json_valid(j) AND j LIKE '{{%' THEN j END AS j FROM b),
f AS (SELECT x, j IS NOT NULL AS parsed, nullif(trim(j ->> '$.vendor_name'), '') AS vendor_name, trim(j ->> '$.invoice_date') AS d, trim(j ->> '$.net_amount') AS s FROM o)
SELECT x, parsed, vendor_name, CASE WHEN regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN d END AS invoice_date, {_PARSED}::DOUBLE AS net_amount FROM f""",
    "master_data": "SELECT * FROM "
    + _values(
        [("accounts", i, *a) for i, a in enumerate(_ACCOUNTS)] + [("clients", 0, "M0001", _CLIENT, "EUR")] + [("creditors", i, c[0], c[1], " ".join(c[2:])) for i, c in enumerate(_CREDITOR_ROWS)]
        + [("keyword_rules", 100 * _RULES.index(a) + [w for b, w in oracle_invoices.KEYWORDS if b == a].index(word), a, word, "") for a, word in oracle_invoices.KEYWORDS],
        "list", "rank", "code", "name", "detail",
    ),
    "master_counts": "SELECT * FROM (VALUES ('accounts', 8::BIGINT), ('clients', 1), ('creditors', 4), ('keyword_rules', 31)) AS v(list, n)",
    "record_export": """
SELECT id AS invoice_id, coalesce(number, id) || '.json' AS file,
  '{' || chr(10) || '  "invoice_id" : "' || id || '",' || chr(10) || '  "extracted" : {' || chr(10) || '    "number" : ' || coalesce('"' || number || '"', 'null') || ',' || chr(10) || '    "customer" : ' || o_custkey || chr(10) || '  },' || chr(10)
  || '  "status" : "' || o_orderstatus || '"' || chr(10) || '}' AS json
FROM (SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 4 <> 0 THEN 'N-' || o_orderkey END AS number, o_orderstatus, o_custkey FROM orders)""",
    "surface_rollup": """
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "surface_as_of": """
SELECT l.event_id, (SELECT arg_max(r.event_id, (r.ts, r.event_id)) FROM events r WHERE r.event_type = 'view' AND r.user_id IS NOT DISTINCT FROM l.user_id AND r.ts <= l.ts) AS as_of_id
FROM events l WHERE l.event_type = 'purchase'""",
    "surface_joins": """
SELECT 'semi' AS op, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
UNION ALL SELECT 'full', count(*) FROM customer JOIN supplier ON c_nationkey = s_nationkey""",
    "surface_cube": """
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "surface_windows": """
SELECT o_orderkey, row_number() OVER w AS n, lag(o_orderkey) OVER w AS before, (sum(o_totalprice::DECIMAL(18,2)) OVER (w ROWS UNBOUNDED PRECEDING))::DOUBLE AS so_far
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "surface_interval": """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS n_before FROM events""",
    "surface_percentiles": """
SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag""",
    "surface_set_ops": """
SELECT 'intersect' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""",
}
SQL |= oracle_invoices.SQL
SQL |= {
    "session_records": """
WITH r AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 40 <> 0 THEN coalesce(epoch_us(o_orderdate), 0) ELSE 0 END AS moment, CASE WHEN o_orderkey % 5 <> 0 THEN 'Haus ' || o_custkey END AS vendor,
    CASE o_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'Wartung' END AS what, o_totalprice AS total FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
SELECT k::VARCHAR AS invoice_id, row_number() OVER (ORDER BY moment, k::VARCHAR) AS n, CASE WHEN coalesce(trim(what), '') = '' AND vendor IS NOT NULL THEN vendor || ' Rechnung' ELSE what END AS description,
  CASE WHEN k % 7 <> 0 AND k % 11 <> 0 THEN total END AS amount FROM r""",
    "master_upserts": """
WITH a AS (
  SELECT 'K' || s_suppkey AS invoice_id, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS name FROM supplier
  UNION ALL SELECT 'K' || s_suppkey || '-neu', s_name FROM supplier WHERE s_suppkey % 10 = 0)
SELECT *, false AS found FROM a UNION ALL SELECT *, true FROM a WHERE invoice_id = 'K3'""",
    "account_statements": f"""WITH {_BOOKED}, s AS (
  SELECT account, b.o_orderkey, o_orderdate, CASE WHEN side = 'DEBIT' THEN amount ELSE -amount END AS signed FROM booked b JOIN orders o ON b.o_orderkey = o.o_orderkey)
SELECT account, o_orderkey, signed::DOUBLE AS signed, (sum(signed) OVER (PARTITION BY account ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))::DOUBLE AS balance FROM s""",
    "events_in_intervals": """
WITH s AS (SELECT o_orderkey, 1704067200000000 + o_orderkey * 7919 % 2592000 * 1000000 AS a, CASE WHEN o_orderkey % 500 = 0 THEN 28800 ELSE (o_orderkey % 13 + 1) * 20 END * 1000000 AS d FROM orders)
SELECT o_orderkey, event_id FROM events JOIN s ON epoch_us(ts) >= a AND epoch_us(ts) <= a + d""",
    "events_matched": """
SELECT p.user_id, p.event_id, c.event_id AS corrected_by FROM events p
LEFT JOIN events c ON c.event_type = 'error' AND p.user_id = c.user_id AND c.ts >= p.ts AND c.ts <= p.ts + INTERVAL 1 HOUR WHERE p.event_type = 'purchase'""",
    "sketch_estimates": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near, true AS n_same FROM events GROUP BY event_type",
    "events_upserted": "SELECT user_id, arg_max(event_id, (ts, event_id % 3, event_id)) AS event_id FROM events GROUP BY user_id",
    "audit_once": "SELECT o_orderkey::VARCHAR AS invoice_id, 'upload' AS action, CASE WHEN o_orderkey % 3 = 2 THEN 2 ELSE 1 END::BIGINT AS n FROM orders",
}
