"""The registered queries over the given tables, and the literal fixtures of some of them.

Orders with their lines play invoices: net is the discounted price of the lines, VAT
what their tax makes of it, and gross the sum of both, off by 25 for every tenth
order where a query is to see every light.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checksum, dates, money, text
from ..operators import intervals, items, keywords, ledger, loose, masking, matching, prefix, rules, sketches
from ..operators.extract import coerce_json, extract_fields
from ..schemas import CANDIDATE, EXTRACTED, FIELDS
from ..session import spread
from ..sources import audit, documents, master, store
from ..streaming import streams
from . import invoices, render
from .fixtures import CANDIDATES, DATES, IBANS, JSON_ANSWERS, LAYOUTS, NUMBERS, RECORDS, SENSITIVE, VAT_IDS, VENDORS

MONEY = "decimal(18,2)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _values(spark: SparkSession, rows: list[str], name: str = "x") -> DataFrame:
    return spark.createDataFrame([(r,) for r in rows], f"{name} string")


def order_amounts(spark: SparkSession, sf_dir: str, perturbed: bool = True) -> DataFrame:
    """o_orderkey, net_amount, vat_amount, vat_rate, gross_amount of orders that have lines.

    Lines are summed by order before the join, so that an order's row travels once.
    """
    line = _table(spark, sf_dir, "lineitem")
    price = line["l_extendedprice"].cast(MONEY)
    net = (price * (1 - line["l_discount"].cast("decimal(4,2)"))).cast("decimal(18,4)")
    sums = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(net).alias("net"), F.sum((net * line["l_tax"].cast("decimal(4,2)")).cast("decimal(18,6)")).alias("vat"))
    sums = sums.select("o_orderkey", F.col("net").cast(MONEY).alias("net_amount"), F.col("vat").cast(MONEY).alias("vat_amount"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", F.col("o_totalprice").cast(MONEY).alias("total"))
    out = orders.join(sums, "o_orderkey")
    off = F.when(F.col("o_orderkey") % 10 == 0, F.lit(25)).otherwise(F.lit(0)).cast(MONEY)
    gross = (F.col("net_amount") + F.col("vat_amount") + off).cast(MONEY) if perturbed else F.col("total")
    rate = F.when(F.col("o_orderkey") % 7 == 0, F.lit(7)).otherwise(F.lit(19)).cast("decimal(9,4)")
    return out.withColumn("gross_amount", gross).withColumn("vat_rate", rate)


def _double(*names: str) -> list[Column]:
    return [F.col(n).cast("double").alias(n) for n in names]


def _summary(df: DataFrame, light: Column) -> DataFrame:
    out = df.withColumn("light", light).groupBy("light").agg(F.count("*").alias("n"), F.sum("net_amount").alias("net"), F.sum("gross_amount").alias("gross"))
    return out.select("light", "n", *_double("net", "gross"))


def _balance_ok() -> Column:
    return F.abs(rules.balance_delta()) <= F.lit("0.02").cast("decimal(18,2)")


def invoice_light_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by light of the balance rule, on their own totals."""
    return _summary(order_amounts(spark, sf_dir, perturbed=False), F.when(_balance_ok(), F.lit("GREEN")).otherwise(F.lit("RED")))


def order_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id and the eleven fields of orders taken for invoices: vendors that are creditors, known by a keyword, or unknown, and every rule broken by some."""
    o, key = order_amounts(spark, sf_dir), F.col("o_orderkey")
    vat = (F.round(F.col("net_amount") * F.col("vat_rate") / 100, 2) + F.when(key % 19 == 0, 1).otherwise(0)).cast(MONEY)
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    vendors = F.array(*[F.lit(v) for v in (" beispiel ENERGIE saar gmbh", "ImmoFix", "JurisMuster Beratung GmbH", "Office-Muster Handels", "Stadtwerke Nord AG", "Unbekannt OHG")])
    goods = F.array(*[F.lit(v) for v in ("Strom und Gas", "Reparatur Heizung", None, "Papier", "Sonstiges")])
    made = o.select(
        key.cast("string").alias("invoice_id"), F.when(key % 13 == 0, F.lit("Andere Firma GmbH")).otherwise(F.lit(f"z. Hd. {master.CLIENTS[0][1]}")).alias("invoice_recipient"),
        F.get(vendors, (key % 6).cast("int")).alias("vendor_name"), F.when(key % 17 != 0, key.cast("string")).alias("invoice_number"), date.alias("invoice_date"),
        F.when(~F.col("o_orderpriority").startswith("4"), date).alias("service_date"), F.lit("EUR").alias("currency"), "net_amount", "vat_rate", vat.alias("vat_amount"),
        (F.col("net_amount") + vat + F.when(key % 10 == 0, 25).otherwise(0)).cast(MONEY).alias("gross_amount"), F.get(goods, (key % 5).cast("int")).alias("description"),
    )
    return made.select("invoice_id", *FIELDS)


def invoice_light_perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices through rules and ledger, by light."""
    out = invoices.decide(order_invoices(spark, sf_dir))
    lines = F.size("booking_proposal").cast("long")
    return out.groupBy(F.col("traffic_light").alias("light")).agg(F.count("*").alias("n"), F.sum("net_amount").alias("net"), F.sum("gross_amount").alias("gross"), F.sum(lines).alias("n_lines")).select("light", "n", "n_lines", *_double("net", "gross"))


def invoice_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's checks, light, suggestion and proposal."""
    out = invoices.decide(order_invoices(spark, sf_dir))
    delta = F.get(F.filter("validations", lambda v: v["check"].startswith("R4")), F.lit(0))["delta"]
    return out.select(
        "invoice_id", F.array_join(F.transform("validations", lambda v: v["status"]), ",").alias("statuses"), delta.cast("double").alias("vat_delta"), "traffic_light", "blocked",
        F.size("decision_reasons").cast("long").alias("n_reasons"), F.array_join("decision_reasons", " | ").alias("reasons"), "suggestion.account", "suggestion.name", "suggestion.source", "suggestion.confidence", "suggestion.creditor_id", "suggestion.keyword",
        F.array_join(F.transform("booking_proposal", lambda x: F.concat(x["side"], F.lit(" "), x["account"], F.lit(" "), x["amount"].cast("string"))), "; ").alias("lines"),
    )


def audit_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What uploading all orders and correcting some leaves in the audit log."""
    records, patches = _records_and_patches(spark, sf_dir)
    after, _ = invoices.revalidate(records, patches)
    log = audit.uploads(records).unionByName(audit.revalidations(after))
    detail = F.col("details")
    return log.select(
        "invoice_id", "action", F.try_element_at(detail, F.lit("filename")).alias("filename"), F.try_element_at(detail, F.lit("traffic_light")).alias("light"),
        F.get_json_object(F.try_element_at(detail, F.lit("extracted")), "$.description").alias("description"),
    )


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = order_amounts(spark, sf_dir).filter(_balance_ok())
    account = F.element_at(F.array(*[F.lit(a) for a in ("4240", "4250", "4260", "4930", "9999")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    lines = ledger.proposal(account, F.col("net_amount"), F.col("vat_amount"), F.col("vat_rate"), F.col("gross_amount"))
    return df.select("o_orderkey", F.inline(lines))


def booking_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_lines(spark, sf_dir).select("o_orderkey", "side", "account", "name", *_double("amount"))


def trial_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.trial_balance(_order_lines(spark, sf_dir)).select("account", "name", "n_lines", *_double("debit", "credit"))


def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.balance_check(_order_lines(spark, sf_dir), "o_orderkey").select("o_orderkey", "balanced", *_double("debit", "credit"))


def mandatory_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by which mandatory fields they lack, some fields being emptied by rule."""
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    df = joined.select(
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).alias("invoice_number"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("invoice_date"),
        F.col("o_totalprice").alias("net_amount"), F.when(F.col("o_orderkey") % 11 != 0, F.lit(0.0)).alias("vat_amount"), F.col("o_totalprice").alias("gross_amount"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.lit("EUR")).alias("currency"),
    )
    return df.withColumn("missing", F.array_join(rules.missing(), ", ")).groupBy("missing").agg(F.count("*").alias("n"))


def vat_account_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by input VAT account of a rate made from their number and tax; 13 is as near to 7 as to 19."""
    rate = (F.col("l_linenumber") * 3 + F.round(F.col("l_tax") * 100)).cast("decimal(9,4)")
    return _table(spark, sf_dir, "lineitem").groupBy(rate.cast("double").alias("rate"), matching.vat_account(rate).alias("account")).agg(F.count("*").alias("n"))


def creditor_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as invoices' vendors and, every second one, as creditors."""
    s = _table(spark, sf_dir, "supplier")
    creditors = s.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("rank"), F.concat(F.lit("K"), "s_suppkey").alias("creditor_id"), F.col("s_name").alias("name"), F.concat(F.lit("DE"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("vat_id"), F.concat(F.lit("DE79 "), "s_suppkey").alias("iban"))
    vendors = s.select(
        F.col("s_suppkey").alias("key"), F.concat(F.lit("  "), F.upper("s_name")).alias("vendor_name"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("de"), F.lpad((F.col("s_suppkey") + 1).cast("string"), 9, "0"))).alias("vat_id"),
        F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("de79"), (F.col("s_suppkey") - 1).cast("string"))).alias("iban"),
    )
    return matching.match_creditors(vendors, creditors).select("key", "creditor_id")


def creditor_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors of the fixture against the built-in creditors: by equal name, else loosely."""
    m = master.Master()
    return _values(spark, VENDORS, "vendor").select("vendor", matching.creditor(m, F.col("vendor"))["creditor_id"].alias("creditor_id"))


def creditor_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as invoices' vendors, whose names hold a supplier's, are held by one or by many, or by none; all suppliers as creditors."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rank"), F.concat(F.lit("K"), "s_suppkey").alias("creditor_id"), F.col("s_name").alias("name"))
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("key") % 1200).cast("string"), 9, "0"))
    forms = F.array(F.concat(F.upper(name), F.lit(" GmbH & Co")), F.substring(name, 3, 30), F.concat(F.lit("Haus "), F.reverse(name)), F.substring(name, 1, 14), F.lit("Supp"), F.concat(F.lit("An "), F.replace(name, F.lit("#"), F.lit("-"))))
    vendors = c.withColumn("vendor_name", F.get(forms, (F.col("key") % 6).cast("int")))
    return c.join(loose.match_loosely(vendors, s), "key", "left")


def keyword_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first of thousands of keywords: all pairs of words that follow each other in the benchmark's passages, longer ones first."""
    words = _table(spark, sf_dir, "benchmark").select(F.split(F.lower("text"), " ").alias("w"))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).alias("keyword")).distinct()
    book = pairs.filter("instr(keyword, ' ') > 0").withColumn("rank", F.row_number().over(Window.orderBy(F.length("keyword").desc(), "keyword")))  # a rule book, of bounded size
    book = book.withColumn("account", F.element_at(F.array(*[F.lit(a) for a, _ in master.KEYWORDS]), F.col("rank") % 5 + 1))
    return keywords.match_keywords(_documents(spark, sf_dir), book).select("doc_id", "account", "keyword")


def keyword_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the account that keywords in their text suggest."""
    m = master.Master()
    hit = matching.keyword(m, F.lit(None).cast("string"), F.col("text"))
    return _documents(spark, sf_dir).select(F.coalesce(hit["account"], F.lit("none")).alias("account"), F.coalesce(hit["keyword"], F.lit("none")).alias("keyword")).groupBy("account", "keyword").agg(F.count("*").alias("n"))


def parse_german_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, NUMBERS).select("x", money.parse_decimal(F.col("x")).cast("double").alias("value"))


def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, DATES).select("x", dates.normalize_date(F.col("x")).alias("value"))


def vat_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, VAT_IDS).select("x", checksum.vat_id_valid(F.col("x")).alias("valid"))


def iban_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, IBANS).select("x", checksum.iban_valid(F.col("x")).alias("valid"))


def text_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.round(text.quality_score(F.col("text")), 6).alias("score"))


def best_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and garbled or shortened variants of them as candidates of three engines."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text")
    variants = [
        ("pdfplumber", F.when(F.col("doc") % 3 == 0, F.translate("text", "aeinr", "^~^~^")).otherwise(F.col("text"))),
        ("pymupdf", F.when(F.col("doc") % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))),
        ("ocr", F.substring("text", 1, 100)),
    ]
    made = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(name).alias("engine"), t.alias("text")) for i, (name, t) in enumerate(variants)])
    return docs.select("doc", documents.best_of(made).alias("best")).select("doc", "best.engine", F.round("best.score", 6).alias("score"))


def best_engine_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.best_candidate(spark.createDataFrame(CANDIDATES, CANDIDATE), "doc").select("doc", "engine")


def pii_email_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents masked, some with an identifier of each kind put before them, valid ones and others."""
    number = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    marks = F.concat(F.lit("DE"), number, F.lit(" DE999999995 DE44"), F.lit("50010517"), F.lpad(number, 10, "0"), F.lit(" DE79100100100012345678 tel 0681/"), number, F.lit(" "))
    docs = _documents(spark, sf_dir).select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, marks).otherwise(F.lit("")), F.col("text")).alias("text"))
    out = docs.withColumn("s", masking.sanitize(F.col("text"))).withColumn("c", masking.counts(F.col("s.mapping")))
    return out.select("doc_id", "c.*", F.sha2(F.col("s.text"), 256).alias("masked_sha256"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, SENSITIVE).select("x", masking.sanitize(F.col("x")).alias("s")).select("x", F.col("s.text").alias("masked"), masking.counts(F.col("s.mapping")).alias("c")).select("x", "masked", "c.*")


def pii_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("s", masking.sanitize(F.col("text")))
    same = masking.reidentify(F.col("s.text"), F.col("s.mapping")) == F.col("text")
    return docs.agg(F.count("text").alias("n"), F.count_if(same).alias("n_same"))


def extract_fields_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(LAYOUTS, "doc string, text string")
    out = extract_fields(df)
    return out.select("doc", *[F.col(f).cast("double").alias(f) if f in invoices.DECIMALS else F.col(f) for f in FIELDS])


def process_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layouts from text to decision."""
    out = invoices.process(spark.createDataFrame(LAYOUTS, "invoice_id string, text string"))
    statuses = F.array_join(F.transform("validations", lambda v: v["status"]), ",").alias("statuses")
    lines = F.array_join(F.transform("booking_proposal", lambda x: F.concat(x["side"], F.lit(" "), x["account"], F.lit(" "), x["amount"].cast("string"))), "; ").alias("lines")
    return out.select("invoice_id", "extracted.vendor_name", "traffic_light", "blocked", F.col("suggested_expense_account.account").alias("account"), statuses, lines, F.array_join("decision_reasons", " | ").alias("reasons"))


def process_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document taken for an invoice, from text to decision; no join, and no shuffle but that of the result and of inputs smaller than the cluster."""
    texts = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("invoice_id"), "text")
    out = invoices.process(texts)
    return out.groupBy("traffic_light").agg(F.count("*").alias("n"), F.count("extracted.vendor_name").alias("n_vendor"), F.count("extracted.invoice_recipient").alias("n_recipient"), F.count("extracted.invoice_date").alias("n_date"))


def rule_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rules.evaluate(spark.createDataFrame(RECORDS, "invoice_id string, " + ", ".join(f"{c.split()[0]} string" for c in EXTRACTED.replace("decimal(18,2)", "s").replace("decimal(9,4)", "s").split(", "))).withColumns({c: F.col(c).cast(t) for c, t in invoices.DECIMALS.items()}))
    return df.select("invoice_id", "traffic_light", "blocked", F.array_join("decision_reasons", " | ").alias("reasons"))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id and text: an invoice for each order that has lines, in one of the renderer's layouts."""
    return render.rendered(render.facts(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")))


def rendered_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven fields read back from the texts of all orders' invoices."""
    out = extract_fields(_rendered(spark, sf_dir))
    return out.select("invoice_id", *[F.col(f).cast("double").alias(f) if f in invoices.DECIMALS else F.col(f) for f in FIELDS])


def rendered_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders' invoices from text to decision, with every reason in full."""
    out = invoices.process(_rendered(spark, sf_dir))
    statuses = F.array_join(F.transform("validations", lambda v: v["status"]), ",").alias("statuses")
    lines = F.array_join(F.transform("booking_proposal", lambda x: F.concat(x["side"], F.lit(" "), x["account"], F.lit(" "), x["amount"].cast("string"))), "; ").alias("lines")
    reasons = F.array_join("decision_reasons", " | ").alias("reasons")
    return out.select("invoice_id", statuses, "traffic_light", "blocked", reasons, F.col("suggested_expense_account.account").alias("account"), lines, "audit.notes", F.col("audit.model_or_method").alias("method"))


def rendered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of all invoices that have a table of them."""
    out = items.invoice_lines(_rendered(spark, sf_dir))
    return out.select("invoice_id", "n", "text", "quantity", F.col("amount").cast("double").alias("amount"))


def rendered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers about all orders' invoices, coerced: some fenced, some no object, some with blank names, dates of another shape or amounts that are none."""
    facts = extract_fields(_rendered(spark, sf_dir))
    k = F.col("invoice_id").cast("long")
    said = F.to_json(F.struct(
        F.when(k % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "vendor_name")).alias("vendor_name"),
        F.when(k % 3 == 0, F.date_format("invoice_date", "dd.MM.yyyy")).otherwise(F.col("invoice_date")).alias("invoice_date"),
        F.when(k % 4 == 0, F.lit("n/a")).otherwise(F.concat(render.german(F.col("net_amount")), F.lit(" EUR"))).alias("net_amount"), "gross_amount", "description",
    ))
    answer = F.when(k % 23 == 0, F.concat(F.lit("["), said, F.lit("]"))).when(k % 2 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(said)
    got = facts.select("invoice_id", coerce_json(answer).alias("f"))
    return got.select("invoice_id", F.col("f").isNotNull().alias("parsed"), "f.vendor_name", "f.invoice_date", F.col("f.net_amount").cast("double").alias("net_amount"), F.col("f.gross_amount").cast("double").alias("gross_amount"), "f.description")


def _records_and_patches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records of all orders, and patches: a right total and a service date for some, then an explicit null, then an amount that is no number."""
    records = invoices.shaped(invoices.decide(order_invoices(spark, sf_dir)))
    key = F.col("invoice_id").cast("long")
    total = (F.col("extracted.net_amount") + F.col("extracted.vat_amount")).cast("string")

    def of(seq: int, every: int, *pairs: Column) -> Column:
        return F.when(key % every == 0, F.struct(F.lit(seq).cast("long").alias("seq"), F.create_map(*pairs).alias("patch")))

    none = F.lit(None).cast("string")
    made = F.array(
        of(1, 4, F.lit("gross_amount"), total, F.lit("service_date"), F.lit("2026-01-02"), F.lit("description"), F.lit("Wartung")), of(2, 8, F.lit("description"), none), of(3, 12, F.lit("net_amount"), F.lit("1,234.5")),
    )
    return records, records.filter(key % 4 == 0).select("invoice_id", F.inline(F.filter(made, lambda p: p.isNotNull())))


def revalidate_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders corrected and decided anew, and the corrections set aside."""
    after, bad = invoices.revalidate(*_records_and_patches(spark, sf_dir))
    told = after.select("invoice_id", F.lit("revalidated").alias("outcome"), F.col("extracted.gross_amount").cast("double").alias("gross"), "extracted.service_date", "extracted.description", "traffic_light", F.size("booking_proposal").cast("long").alias("n_lines"))
    return told.unionByName(bad.select("invoice_id", F.lit("quarantined").alias("outcome")), allowMissingColumns=True)


def account_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every booking line with its account's balance after it, debit less credit, in the order of invoices' dates and numbers."""
    days = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    signed = F.when(F.col("side") == "DEBIT", F.col("amount")).otherwise(-F.col("amount")).cast(MONEY)
    lines = _order_lines(spark, sf_dir).join(days, "o_orderkey").withColumn("signed", signed)
    out = prefix.running_sum(lines, ["account"], ["o_orderdate", "o_orderkey"], "signed", "balance")
    return out.select("account", "o_orderkey", *_double("signed", "balance"))


def events_in_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within the spans of orders: some seconds for most, eight hours for a few."""
    events = _table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    k = F.col("o_orderkey")
    start = F.lit(1_704_067_200_000_000) + k * 7919 % 2_592_000 * 1_000_000
    spans = _table(spark, sf_dir, "orders").select("o_orderkey", start.alias("start"), (start + F.when(k % 500 == 0, 28_800).otherwise((k % 13 + 1) * 20) * 1_000_000).alias("end"))
    return intervals.hold(events, spans, "at", "start", "end").select("o_orderkey", "event_id")


def events_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the two matched streams: purchases, each with the user's errors in the hour after it, or without."""
    e = _table(spark, sf_dir, "events")
    uploads = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    corrections = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("corrected_by"), F.col("ts").alias("corrected_at"))
    return streams.matched(uploads, corrections, "user_id", "ts", "corrected_at", "1 HOUR").select("user_id", "event_id", "corrected_by")


def sketch_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and median value by type of event, exactly, and whether the merged sketches of all days are as near as they are said to be."""
    e = _table(spark, sf_dir, "events").select("event_type", "user_id", "value", "ts")
    days = store.write_once(sketches.daily(e, "ts", ["event_type"], "user_id", "value"), f"{store.shared_dir(spark)}/sketches-{uuid.uuid4().hex}", "all")
    told = sketches.estimates(sketches.merged(days, ["event_type"]), ["event_type"])
    exact = e.groupBy("event_type").agg(F.count("*").alias("n_exact"), F.count_distinct("user_id").alias("users"))
    below = e.join(F.broadcast(told), "event_type").groupBy("event_type").agg(F.avg((F.col("value") < F.col("q50")).cast("int")).alias("under"), F.avg((F.col("value") <= F.col("q50")).cast("int")).alias("upto"))
    out = exact.join(told, "event_type").join(below, "event_type")
    near = F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * sketches.COUNT_WITHIN)
    ranked = (F.col("under") <= 0.5 + sketches.RANK_WITHIN) & (F.col("upto") >= 0.5 - sketches.RANK_WITHIN)
    return out.select("event_type", "n", "users", near.alias("users_near"), ranked.alias("median_near"), (F.col("n") == F.col("n_exact")).alias("n_same"))


def events_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest event, from a bucketed table that three batches of events were put into, one of them twice."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    path = f"{store.shared_dir(spark)}/upserts-{uuid.uuid4().hex}"
    for batch in (0, 1, 1, 2):
        store.upsert(e.filter(F.col("event_id") % 3 == batch), path, "user_id", batch, "ts", 16)
    return store.read(spark, path, e.schema).select("user_id", "event_id")


def audit_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of uploads in the log, of which one batch was logged twice, and one a second time under its own name."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("invoice_id"), F.pmod("o_orderkey", F.lit(3)).alias("part"))
    path = f"{store.shared_dir(spark)}/log-{uuid.uuid4().hex}"
    for part, batch in ((0, None), (1, 7), (0, None), (2, 8), (1, 7), (2, 9)):
        audit.log(audit.uploads(o.filter(F.col("part") == part).select("invoice_id")), path, batch)
    log = spark.read.parquet(path)
    return log.groupBy("invoice_id", "action").agg(F.count("*").alias("n"))


def session_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that returned lines name, as a session's records in the order of time: with their place, a description where they lack one, and an amount from a form."""
    named = _table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("invoice_id"))
    k = F.col("o_orderkey")
    o = _table(spark, sf_dir, "orders").select(
        k.cast("string").alias("invoice_id"), F.when(k % 40 != 0, F.col("o_orderdate")).alias("at"), F.when(k % 5 != 0, F.concat(F.lit("Haus "), "o_custkey")).alias("vendor_name"),
        F.when(k % 3 == 0, F.lit(" ")).when(k % 3 == 1, F.lit("Wartung")).alias("description"), F.when(k % 7 == 0, F.lit("")).when(k % 11 == 0, F.lit("zwölf")).otherwise(F.col("o_totalprice").cast("string")).alias("given"),
    )
    own = invoices.with_default_description(invoices.only(o, named))
    placed = prefix.numbered(own.withColumn("_at", F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(0))), ["_at", "invoice_id"], "n")
    return placed.select("invoice_id", "n", "description", invoices.numeric_input(F.col("given")).alias("amount"))


def master_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as master data after changes to some and additions, twice; and whether one is found by its id."""
    s = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("K"), "s_suppkey").alias("invoice_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    changes = s.filter("k % 3 = 0").withColumn("name", F.upper("name")).unionByName(s.filter("k % 10 = 0").withColumn("invoice_id", F.concat("invoice_id", F.lit("-neu"))))
    after = master.upsert(master.upsert(s, changes, "invoice_id"), changes, "invoice_id").select("invoice_id", "name")
    return after.withColumn("found", F.lit(False)).unionByName(documents.find(after, "K3").withColumn("found", F.lit(True)))


def invoice_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("processed_at"))
    return invoices.labels(o, F.col("processed_at"), "o_orderkey").select("o_orderkey", "label")


def audit_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the windowed stream of events."""
    out = streams.windowed(_table(spark, sf_dir, "events"), "ts", "event_type", "1 hour")
    return out.select(F.unix_timestamp("window_start").alias("start_s"), "event_type", "n")


def audit_event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.sessions(_table(spark, sf_dir, "events"), "ts", "user_id", "30 minutes")
    return out.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("most"))


def llm_json_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _values(spark, JSON_ANSWERS).select("x", coerce_json(F.col("x")).alias("f"))
    return got.select("x", F.col("f").isNotNull().alias("parsed"), "f.vendor_name", "f.invoice_date", F.col("f.net_amount").cast("double").alias("net_amount"))


def master_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the four built-in lists, in their order."""
    f = master.frames(spark)
    lists = {
        "accounts": f["accounts"].select("rank", "account", "name", F.col("category").alias("detail")),
        "clients": f["clients"].select("rank", "client_id", "company_name", "currency"),
        "creditors": f["creditors"].select("rank", "creditor_id", "name", F.concat_ws(" ", "default_expense_account", "vat_id", "iban")),
        "keyword_rules": f["keyword_rules"].select((F.col("rule_rank") * 100 + F.col("kw_rank")).alias("rank"), "account", "keyword", F.lit("")),
    }
    parts = [df.toDF("rank", "code", "name", "detail").select(F.lit(name).alias("list"), "*") for name, df in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def master_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each list has, as a seeding reports it."""
    return master_data(spark, sf_dir).groupBy("list").agg(F.count("*").alias("n"))


def record_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as indented JSON under the name of its number, or of its id where it has none."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("invoice_id"), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("N-"), "o_orderkey")).alias("number"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("long").alias("customer"))
    record = documents.as_json(F.struct("invoice_id", F.struct("number", "customer").alias("extracted"), "status"))
    return o.select("invoice_id", documents.export_name("number").alias("file"), record.alias("json"))


# What Spark itself offers and the engine exposes beside the inventory: labelled so, and not taken from it.


def surface_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    out = line.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast(MONEY)).alias("quantity"))
    return out.select("l_returnflag", "l_linestatus", "n", *_double("quantity"))


def surface_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's last view at or before it: a union and one window, no join of pairs."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    left, right = "purchase", "view"
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == right, 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == right, F.struct("ts", "event_id")), ignorenulls=True).over(w)
    return e.filter(F.col("event_type").isin(left, right)).withColumn("last", last).filter(F.col("event_type") == left).select("event_id", F.col("last.event_id").alias("as_of_id"))


def surface_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    both, only, any_ = c.intersect(s), c.subtract(s), c.union(s).distinct()
    return both.agg(F.lit("intersect").alias("op"), F.count("*").alias("n")).unionByName(only.agg(F.lit("except").alias("op"), F.count("*").alias("n"))).unionByName(any_.agg(F.lit("union").alias("op"), F.count("*").alias("n")))


def surface_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with and without orders, and nations of customers and suppliers side by side; both sides are counted before they meet."""
    c, o, s = (_table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    buyers = o.select(F.col("o_custkey").alias("c_custkey"))
    sides = c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_c")).join(s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_s")), "nation", "full")
    made = {
        "semi": c.join(buyers, "c_custkey", "left_semi").agg(F.count("*").alias("n")),
        "anti": c.join(buyers, "c_custkey", "left_anti").agg(F.count("*").alias("n")),
        "full": sides.agg(F.sum(F.coalesce("n_c", F.lit(0)) * F.coalesce("n_s", F.lit(0))).alias("n")),
    }
    parts = [df.select(F.lit(op).alias("op"), F.coalesce("n", F.lit(0)).cast("long").alias("n")) for op, df in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def surface_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    return line.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


def surface_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in time: their number, the one before, and the total so far."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    total = F.sum(F.col("o_totalprice").cast(MONEY)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("n"), F.lag("o_orderkey").over(w).alias("before"), total.cast("double").alias("so_far"))


def surface_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the user's events in the hour before it: a range frame instead of a join by interval."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, -1)
    return _table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("n_before"))


def surface_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of a column of few distinct values, which bound the state."""
    line = _table(spark, sf_dir, "lineitem")
    return line.groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.5)).alias("median"), F.percentile("l_quantity", F.lit(0.9)).alias("p90"))


QUERIES = {
    f.__name__: f
    for f in (
        invoice_light_summary, invoice_light_perturbed, booking_lines, trial_balance, balance_check, mandatory_fields, vat_account_nearest,
        creditor_exact, creditor_fuzzy, keyword_account, parse_german_decimal, normalize_dates, vat_checksum, iban_checksum, text_quality_score,
        best_engine, best_engine_fixture, pii_email_mask, pii_counts, pii_roundtrip, extract_fields_fixtures, process_fixtures, process_documents, rule_reasons,
        revalidate_overlay, invoice_labels, audit_event_windows, audit_event_sessions, llm_json_coerce, master_data, master_counts, record_export,
        invoice_decisions, audit_log_events, rendered_fields, rendered_decisions, rendered_items, rendered_answers, creditor_loose, keyword_book,
        session_records, master_upserts, account_statements, events_in_intervals, events_matched, sketch_estimates, events_upserted, audit_once,
        surface_rollup, surface_as_of, surface_set_ops, surface_joins, surface_cube, surface_windows, surface_interval, surface_percentiles,
    )
}
