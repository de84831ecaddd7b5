"""From invoice texts to records, corrections, and lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..functions.text import strip
from ..operators import ledger, masking, rules
from ..operators import prefix as ordered
from ..operators.extract import coerce_json, extract_fields, model_answers, prefer_answers
from ..schemas import FIELDS
from ..session import master_data
from ..session import tolerance as session_tolerance
from ..sources import audit, store
from ..sources.master import Master

TEXT_FIELDS = ("invoice_recipient", "vendor_name", "invoice_number", "invoice_date", "service_date", "currency", "description")
DECIMALS = {"net_amount": "decimal(18,2)", "vat_amount": "decimal(18,2)", "gross_amount": "decimal(18,2)", "vat_rate": "decimal(9,4)"}
DIRECT = "Direct through-the-wall processing. No manual interaction required."
HALTED = "Workflow halted automatically. Human intervention mandatory to review invoice."


def decide(df: DataFrame, master: Master | None = None, tolerance: float | None = None) -> DataFrame:
    """Rules and booking proposal for rows with the eleven fields; master data and tolerance are the session's unless given."""
    master = master_data(df.sparkSession) if master is None else master
    tolerance = session_tolerance(df.sparkSession) if tolerance is None else tolerance
    return ledger.with_proposal(rules.evaluate(df, master, tolerance), master)


def shaped(df: DataFrame) -> DataFrame:
    """Records: the fields in one struct beside what was decided."""
    rest = [c for c in df.columns if c not in FIELDS and c not in ("text", "engine", "score", "suggestion", "decided")]
    return df.select(*[c for c in rest if c in ("invoice_id", "invoice_file", "original_filename")], F.struct(*FIELDS).alias("extracted"), *[c for c in rest if c not in ("invoice_id", "invoice_file", "original_filename")])


def process(texts: DataFrame, master: Master | None = None, tolerance: float | None = None, ask: Callable[[str], str | None] | None = None) -> DataFrame:
    """Records from rows (invoice_id, text): mask, extract, unmask, validate, propose.

    Extraction sees the masked text alone; text and map of tokens stay out of the result.
    With ``ask``, a function from masked text to a model's JSON answer, its fields count
    wherever it gives a JSON object, and the patterns elsewhere.
    """
    masked = texts.withColumn("_safe", masking.sanitize(F.col("text"))).withColumn("text", F.col("_safe.text")).withColumn("_map", F.col("_safe.mapping")).drop("_safe")
    by_model = F.lit(False)
    if ask is None:
        fields = extract_fields(masked)
    else:
        answered = masked.withColumn("_answer", model_answers(ask)(F.col("text"))).withColumn("_answer", coerce_json(F.col("_answer")))
        fields = prefer_answers(extract_fields(answered), "_answer").withColumn("_by_model", F.col("_answer").isNotNull()).drop("_answer")
        by_model = F.col("_by_model")
    fields = fields.withColumns({c: masking.reidentify(F.col(c), F.col("_map")) for c in TEXT_FIELDS}).drop("_map", "text")
    done = decide(fields, master, tolerance)
    engine = F.col("engine") if "engine" in texts.columns else F.lit("text")
    method = F.concat(F.lit("extractor("), engine, F.lit(")+fields("), F.when(by_model, F.lit("llm")).otherwise(F.lit("regex")), F.lit(")+rules"))
    notes = F.when(F.col("blocked"), F.lit(HALTED)).otherwise(F.lit(DIRECT))
    block = F.struct(F.current_timestamp().alias("processed_at"), method.alias("model_or_method"), notes.alias("notes"))
    return shaped(done.withColumn("audit", block).drop("_by_model"))


def upload(texts: DataFrame, records_path: str, audit_path: str, batch: str | int | None = None, **settings) -> None:
    """Adds the records of texts and an event for each, once: a batch repeated, or run again after a failure, leaves what it left before.

    Batches have names, or are told apart by the texts.
    """
    batch = store.content_key(texts) if batch is None else batch
    store.write_once(process(texts, **settings), records_path, batch)
    audit.log(audit.uploads(texts), audit_path, batch)


def fold_patches(patches: DataFrame) -> DataFrame:
    """invoice_id and patch: for each field the value of the last patch (by seq) that names it; an explicit null counts."""
    each = patches.select("invoice_id", "seq", F.explode("patch").alias("field", "value"))
    last = each.groupBy("invoice_id", "field").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    return last.groupBy("invoice_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("v.value").alias("value")))).alias("patch"))


def _patched(field: str, old: Column, patch: Column) -> Column:
    new = F.try_element_at(patch, F.lit(field))
    if field in DECIMALS:
        new = money.parse_decimal(new).cast(DECIMALS[field])
    return F.when(F.coalesce(F.map_contains_key(patch, field), F.lit(False)), new).otherwise(old).alias(field)


def malformed(patch: Column) -> Column:
    """Whether a patch gives an amount that is no number; such patches belong into quarantine."""
    bad = F.lit(False)
    for field in DECIMALS:
        value = F.try_element_at(patch, F.lit(field))
        bad = bad | (value.isNotNull() & money.parse_decimal(value).isNull())
    return F.coalesce(bad, F.lit(False))


def revalidate(records: DataFrame, patches: DataFrame, master: Master | None = None, tolerance: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Patched and freshly decided records, and the patches set aside because an amount in them is no number.

    Named fields replace the old ones, nulls too. The audit block stays as it was.
    """
    good, bad = patches.filter(~malformed(F.col("patch"))), patches.filter(malformed(F.col("patch")))
    joined = records.select("invoice_id", *[c for c in ("invoice_file", "original_filename", "audit") if c in records.columns], "extracted").join(fold_patches(good).withColumnRenamed("patch", "_patch"), "invoice_id")
    rows = joined.select(*[c for c in joined.columns if c not in ("extracted", "_patch")], *[_patched(f, F.col(f"extracted.{f}"), F.col("_patch")) for f in FIELDS])
    return shaped(decide(rows, master, tolerance)), bad


def correct(records: DataFrame, patches: DataFrame, records_path: str, audit_path: str, quarantine_path: str, batch: str | int | None = None) -> None:
    """Adds the records that patches change, an event for each, and the patches set aside, once, as ``upload`` does.

    Records are decided once and written; their events are taken from what was written.
    """
    batch = store.content_key(patches) if batch is None else batch
    after, bad = revalidate(records, patches)
    written = store.write_once(after, records_path, batch)
    audit.log(audit.revalidations(written), audit_path, batch)
    store.write_once(bad, quarantine_path, batch)


def labels(records: DataFrame, ts: Column, key: str = "invoice_id", prefix: str = "Rechnung-", rows: int = ordered.ROWS) -> DataFrame:
    """``records`` with label: numbered by processing time, those without one first; ties by key.

    Rows are dealt to ranges of (time, key) of about ``rows`` rows, as many as that takes, so neither a busy hour nor rows without a time
    meet in one task.
    """
    timed = records.withColumn("_at", F.unix_micros(F.coalesce(ts, F.timestamp_seconds(F.lit(0)))))
    digits = F.col("_number").cast("string")
    label = F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(5)), F.lit("0")))
    return ordered.numbered(timed, ["_at", key], "_number", rows).withColumn("label", label).select(*[F.col(f"`{c}`") for c in records.columns], "label")


def only(records: DataFrame, ids: DataFrame, key: str = "invoice_id") -> DataFrame:
    """The records whose key a session's table of keys holds, however often."""
    return records.join(ids.select(key), key, "left_semi")


def by_time(records: DataFrame, ts: Column, key: str = "invoice_id") -> DataFrame:
    """Records in the order of processing, those without a time first; ties by key."""
    return records.orderBy(F.coalesce(ts, F.timestamp_seconds(F.lit(0))), key)


def with_default_description(df: DataFrame) -> DataFrame:
    """Blank descriptions as vendor and "Rechnung"; opt-in, since it can change the account that keywords suggest."""
    blank = F.coalesce(strip(F.col("description")), F.lit("")) == ""
    return df.withColumn("description", F.when(blank & F.col("vendor_name").isNotNull(), F.concat("vendor_name", F.lit(" Rechnung"))).otherwise(F.col("description")))


def numeric_input(value: Column) -> Column:
    """A number from a form's text; empty is null."""
    return F.nullif(value, F.lit("")).try_cast("double")
