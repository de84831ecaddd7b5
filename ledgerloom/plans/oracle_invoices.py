"""DuckDB twins about rendered invoices: facts stated from orders, lines and customers, and decisions from facts by matching names."""

from __future__ import annotations

# Creditors, keyword rules, account names, client and messages of the booking conventions.
CREDITORS = [
    ("K10001", "Beispiel Energie Saar GmbH", "4240"),
    ("K10002", "ImmoFix Musterservice GmbH", "4260"),
    ("K10003", "JurisMuster Beratung GmbH", "4950"),
    ("K10004", "OfficeMuster Handels GmbH", "4930"),
]
KEYWORDS = [
    ("4240", "strom"), ("4240", "electricity"), ("4240", "gas"), ("4240", "wasser"), ("4240", "water"), ("4240", "fernwärme"), ("4240", "district heating"), ("4240", "energie"),
    ("4250", "reinigung"), ("4250", "cleaning"), ("4250", "fensterreinigung"), ("4250", "window washing"),
    ("4260", "instandhaltung"), ("4260", "reparatur"), ("4260", "maintenance"), ("4260", "repair"), ("4260", "wartung"), ("4260", "technischer service"),
    ("4930", "bürobedarf"), ("4930", "office supplies"), ("4930", "papier"), ("4930", "paper"), ("4930", "stationary"), ("4930", "büromaterial"),
    ("4950", "rechtsberatung"), ("4950", "legal counsel"), ("4950", "steuerberatung"), ("4950", "tax advisory"), ("4950", "gutachten"), ("4950", "expert opinion"), ("4950", "beratung"),
]
ACCOUNTS = [
    ("1571", "Abziehbare Vorsteuer 7%"), ("1576", "Abziehbare Vorsteuer 19%"), ("1600", "Verbindlichkeiten aus Lieferungen und Leistungen"), ("4240", "Energie / Nebenkosten"),
    ("4250", "Reinigung"), ("4260", "Instandhaltung / Reparaturen"), ("4930", "Bürobedarf / Verwaltung"), ("4950", "Rechts- und Beratungskosten"),
]
CLIENT = "Musterhaus Immobilien SPV 01 GmbH"
HAPPY = "All formal, arithmetic, and master data validations passed successfully. Booking proposal generated automatically."
OVERRIDE = "Per Rule R0, critical failure overrides other indicators. Automatic ledger processing is blocked."
NO_BALANCE = "Cannot evaluate arithmetic balance: net, VAT, or gross amount is missing."
NO_VAT = "Cannot evaluate VAT plausibility: net amount, VAT rate, or VAT amount is missing."
NO_SERVICE_DATE = "No service date (Leistungsdatum) could be identified. Clerk review required per § 14 Abs. 4 Nr. 6 UStG."
NO_ACCOUNT = "Expense account could not be derived unambiguously. Clerk must confirm account assignment."
DIRECT = "Direct through-the-wall processing. No manual interaction required."
HALTED = "Workflow halted automatically. Human intervention mandatory to review invoice."


def rows(values: list[tuple], *names: str) -> str:
    """Tuples as a table; the first column is their rank."""
    cells = ", ".join(f"({i}, " + ", ".join("'" + v + "'" for v in r) + ")" for i, r in enumerate(values))
    return f"(VALUES {cells}) AS v(rank, {', '.join(names)})"


LOOSE = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"

#: CTEs up to fact: what stands on each order's invoice, and up to i: what a reader takes from it.
FACTS = f"""line AS (
  SELECT l_orderkey AS k, l_linenumber AS n, 'Artikel A' || l_partkey || CASE WHEN l_partkey % 15 = 0 THEN ' in der verstärkten Ausführung' ELSE '' END || ' Standard' AS text,
    l_quantity::BIGINT AS quantity, (l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(18,2) AS amount, l_partkey % 15 = 0 AS long FROM lineitem),
item AS (SELECT k, text, quantity, amount, long, row_number() OVER (PARTITION BY k ORDER BY n, text, quantity, amount) AS n FROM line),
sums AS (SELECT k, sum(amount)::DECIMAL(18,2) AS net, max(long) FILTER (n = 1) AS first_long FROM item GROUP BY k),
start AS (
  SELECT k, net, first_long, o_custkey AS c, o_orderdate::DATE AS day, k % 9 AS layout, k // 9 AS turn, CASE WHEN k % 7 = 0 THEN 7 ELSE 19 END::DECIMAL(9,4) AS rate FROM orders JOIN sums ON o_orderkey = k),
fact AS (
  SELECT *, (round(net * rate * 0.01, 2) + CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END)::DECIMAL(18,2) AS vat,
    CASE WHEN layout < 4 THEN ['Beispiel Energie Saar GmbH', 'ImmoFix', 'JURISMUSTER BERATUNG GMBH', 'Office-Muster Handels', 'Treppenhausreinigung Nord KG', 'Handelshaus ' || c || ' AG'][turn % 6 + 1]
      WHEN layout < 8 THEN ['Beispiel Energie Saar GmbH', 'ImmoFix Musterservice GmbH', 'JurisMuster Beratung GmbH', 'OfficeMuster Handels GmbH', 'Sauberfee Reinigung KG', 'Handelshaus ' || c || ' AG'][turn % 6 + 1]
      ELSE 'Malerbetrieb ' || c END AS printed,
    ['Stromlieferung Haus B', 'Wartung der Aufzüge', 'Prüfung der Verträge', 'Papier und Toner', 'Sonstiges'][turn % 5 + 1] AS subject FROM start),
read AS (
  SELECT k, layout, CASE WHEN k % 13 = 0 THEN 'Verwaltung ' || c || ' GmbH' ELSE '{CLIENT}' END AS recipient, CASE WHEN layout = 7 THEN 'GRÜNER ' || printed ELSE printed END AS vendor,
    CASE WHEN k % 17 <> 0 OR layout > 3 THEN 'R7/' || k END AS number, strftime(day, '%Y-%m-%d') AS idate,
    CASE WHEN layout IN (4, 7) THEN strftime(day, '%Y-%m-%d') WHEN layout > 3 OR k % 11 <> 0 THEN strftime(day - (k % 30)::INTEGER, '%Y-%m-%d') END AS sdate, 'EUR' AS currency,
    net, CASE WHEN layout = 3 THEN round_even(vat * 100.0 / net, 1)::DECIMAL(9,4) ELSE rate END AS rate, vat, (net + vat + CASE WHEN k % 10 = 0 THEN 25 ELSE 0 END)::DECIMAL(18,2) AS gross,
    CASE WHEN layout IN (0, 1, 2, 3, 6, 8) THEN subject WHEN layout IN (5, 7) THEN CASE WHEN first_long THEN 'Ausführung Standard' ELSE 'Artikel A' || (SELECT any_value(regexp_extract(text, 'A([0-9]+)', 1)) FROM item WHERE item.k = fact.k AND item.n = 1) || ' Standard' END END AS what
  FROM fact)"""


def judged(source: str) -> str:
    """CTEs up to p: what matching, rules and ledger say of a source's rows (k, recipient, vendor, number, idate, sdate, currency, net, rate, vat, gross, what)."""
    own, theirs = LOOSE.format("vendor"), LOOSE.format("name")
    return f"""cr AS (SELECT * FROM {rows(CREDITORS, 'id', 'name', 'account')}),
kw AS (SELECT * FROM {rows(KEYWORDS, 'account', 'word')}),
named AS (SELECT DISTINCT vendor FROM {source} WHERE vendor <> ''),
near AS (
  SELECT vendor, rank, id, account, 0 AS pass FROM named JOIN cr ON lower(trim(vendor)) = lower(name)
  UNION ALL SELECT vendor, rank, id, account, 1 FROM named JOIN cr ON length({own}) >= 6 AND (contains({own}, {theirs}) OR contains({theirs}, {own}))),
known AS (SELECT vendor AS kv, arg_min(id, pass * 1000 + rank) AS creditor, arg_min(account, pass * 1000 + rank) AS own_account FROM near GROUP BY vendor),
said AS (SELECT DISTINCT coalesce(vendor, '') || ' ' || coalesce(what, '') AS hay FROM {source}),
hit AS (SELECT hay, arg_min(account, rank) AS hit_account, arg_min(word, rank) AS hit_word FROM said, kw WHERE contains(lower(hay), word) GROUP BY hay),
joined AS (
  SELECT s.*, creditor, CASE WHEN creditor IS NULL THEN hit_word END AS word, coalesce(own_account, hit_account) AS account, round(net * rate * 0.01, 2)::DECIMAL(18,2) AS expected,
    coalesce(contains(lower(recipient), lower('{CLIENT}')), false) AS r1,
    concat_ws(', ', CASE WHEN coalesce(number, '') = '' THEN 'invoice_number' END, CASE WHEN coalesce(idate, '') = '' THEN 'invoice_date' END, CASE WHEN net IS NULL THEN 'net_amount' END,
      CASE WHEN vat IS NULL THEN 'vat_amount' END, CASE WHEN gross IS NULL THEN 'gross_amount' END, CASE WHEN coalesce(currency, '') = '' THEN 'currency' END) AS lacks
  FROM {source} s LEFT JOIN known ON vendor = kv LEFT JOIN hit ON coalesce(vendor, '') || ' ' || coalesce(what, '') = hay),
ruled AS (
  SELECT *, lacks = '' AS r2, coalesce(abs(net + vat - gross) <= 0.02, false) AS r3, (expected - vat)::DECIMAL(18,2) AS vat_delta, coalesce(abs(expected - vat) <= 0.02, false) AS r4,
    coalesce(sdate, '') <> '' AS r5, creditor IS NOT NULL AS r6, account IS NOT NULL AS r7 FROM joined),
lit AS (
  SELECT *, CASE WHEN NOT (r1 AND r2 AND r3 AND r4) THEN 'RED' WHEN NOT (r5 AND r6 AND r7) THEN 'YELLOW' ELSE 'GREEN' END AS light,
    CASE WHEN abs(rate - 19) <= abs(rate - 7) THEN '1576' ELSE '1571' END AS tax_account,
    list_filter([
      CASE WHEN NOT r1 THEN 'Critical Rule Violation (R1): Extracted recipient (''' || coalesce(recipient, 'None') || ''') does not match client master record (''{CLIENT}'').' END,
      CASE WHEN NOT r2 THEN 'Critical Rule Violation (R2): Missing mandatory field(s): ' || lacks || '.' END,
      CASE WHEN r3 THEN NULL WHEN net + vat + gross IS NULL THEN 'Critical Rule Violation (R3): {NO_BALANCE}'
        ELSE 'Critical Rule Violation (R3): Arithmetic balance check failed: Net (' || net || ') + VAT (' || vat || ') = ' || (net + vat)::DECIMAL(18,2) || ', but Gross is ' || gross
          || '. Delta of ' || abs(net + vat - gross)::DECIMAL(18,2) || ' EUR exceeds tolerance of 0.02 EUR.' END,
      CASE WHEN r4 THEN NULL WHEN net + vat + gross + rate IS NULL THEN 'Critical Rule Violation (R4): {NO_VAT}'
        ELSE 'Critical Rule Violation (R4): VAT plausibility failed: expected ' || expected || ' from ' || printf('%.1f', rate::DOUBLE) || '% of ' || net || ', but got ' || vat
          || '. Delta ' || abs(expected - vat)::DECIMAL(18,2) || ' EUR exceeds tolerance of 0.02 EUR.' END,
      CASE WHEN NOT r5 THEN 'Review Required (R5): {NO_SERVICE_DATE}' END,
      CASE WHEN NOT r6 THEN 'Review Required (R6): Vendor ''' || coalesce(vendor, 'None') || ''' not found in creditor master data. Onboarding workflow recommended.' END,
      CASE WHEN NOT r7 THEN 'Review Required (R7): {NO_ACCOUNT}' END], lambda x: x IS NOT NULL) AS told FROM ruled),
p AS (
  SELECT *, light <> 'RED' AND account IS NOT NULL AND net + vat + gross + rate IS NOT NULL AS open,
    CASE light WHEN 'GREEN' THEN ['{HAPPY}'] WHEN 'RED' THEN list_append(told, '{OVERRIDE}') ELSE told END AS reasons,
    concat_ws(',', {", ".join(f"CASE WHEN r{n} THEN 'PASS' ELSE '{'FAIL' if n < 5 else 'WARN'}' END" for n in range(1, 8))}, CASE WHEN light = 'GREEN' THEN 'PASS' ELSE 'FAIL' END) AS statuses FROM lit)"""


LINES = "CASE WHEN open THEN 'DEBIT ' || p.account || ' ' || net || '; DEBIT ' || tax_account || ' ' || vat || '; CREDIT 1600 ' || gross ELSE '' END AS lines"

SQL = {
    "rendered_fields": f"""WITH {FACTS}
SELECT k::VARCHAR AS invoice_id, recipient AS invoice_recipient, vendor AS vendor_name, number AS invoice_number, idate AS invoice_date, sdate AS service_date, currency,
  net::DOUBLE AS net_amount, rate::DOUBLE AS vat_rate, vat::DOUBLE AS vat_amount, gross::DOUBLE AS gross_amount, what AS description FROM read""",
    "rendered_decisions": f"""WITH {FACTS}, {judged("read")}
SELECT k::VARCHAR AS invoice_id, statuses, light AS traffic_light, light = 'RED' AS blocked, array_to_string(reasons, ' | ') AS reasons, p.account, {LINES},
  CASE light WHEN 'RED' THEN '{HALTED}' ELSE '{DIRECT}' END AS notes, 'extractor(text)+fields(regex)+rules' AS method FROM p""",
    "rendered_items": f"""WITH {FACTS}
SELECT k::VARCHAR AS invoice_id, n::INTEGER AS n, text, quantity, amount::DOUBLE AS amount FROM item JOIN read USING (k) WHERE layout > 4""",
    "rendered_answers": f"""WITH {FACTS}
SELECT k::VARCHAR AS invoice_id, k % 23 <> 0 AS parsed, * FROM (
  SELECT k, CASE WHEN k % 23 <> 0 AND k % 5 <> 0 THEN vendor END AS vendor_name, CASE WHEN k % 23 <> 0 AND k % 3 <> 0 THEN idate END AS invoice_date,
    CASE WHEN k % 23 <> 0 AND k % 4 <> 0 THEN net::DOUBLE END AS net_amount, CASE WHEN k % 23 <> 0 THEN gross::DOUBLE END AS gross_amount, CASE WHEN k % 23 <> 0 THEN what END AS description FROM read)""".replace("AS parsed, *", "AS parsed, * EXCLUDE (k)"),
    "creditor_loose": f"""
WITH v AS (
  SELECT c_custkey AS key, 'Supplier#' || lpad((c_custkey % 1200)::VARCHAR, 9, '0') AS base FROM customer),
w AS (
  SELECT key, [upper(base) || ' GmbH & Co', substr(base, 3), 'Haus ' || reverse(base), substr(base, 1, 14), 'Supp', 'An ' || replace(base, '#', '-')][key % 6 + 1] AS vendor FROM v),
o AS (SELECT key, {LOOSE.format("vendor")} AS own FROM w),
t AS (SELECT s_suppkey AS rank, {LOOSE.format("s_name")} AS their FROM supplier),
d AS (SELECT own, min(rank) AS rank FROM (SELECT DISTINCT own FROM o WHERE length(own) >= 6) JOIN t ON contains(own, their) OR contains(their, own) GROUP BY own)
SELECT key, 'K' || rank AS creditor_id FROM o LEFT JOIN d USING (own)""",
    "keyword_book": """
WITH w AS (SELECT string_split(lower(text), ' ') AS w FROM benchmark),
g AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS keyword FROM w),
b AS MATERIALIZED (SELECT keyword, row_number() OVER (ORDER BY length(keyword) DESC, keyword) AS rank FROM g),
t AS MATERIALIZED (SELECT doc_id, lower(text) AS t FROM documents),
h AS (SELECT doc_id, min(rank) AS rank FROM t JOIN b ON contains(t, keyword) GROUP BY doc_id)
SELECT d.doc_id, ['4240', '4250', '4260', '4930', '4950'][rank % 5 + 1] AS account, keyword FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN b USING (rank)""",
}
