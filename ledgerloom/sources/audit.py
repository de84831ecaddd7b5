"""The append-only audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def events(records: DataFrame, action: str, **details: str) -> DataFrame:
    """invoice_id, action, details and ts for each record; details name columns by their key."""
    pairs = [x for key, column in details.items() for x in (F.lit(key), F.col(column).cast("string"))]
    held = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return records.select("invoice_id", F.lit(action).alias("action"), held.alias("details"), F.current_timestamp().alias("ts"))


def uploads(texts: DataFrame) -> DataFrame:
    """An event for each processed text, with its file's name where there is one."""
    return events(texts, "upload", filename="original_filename" if "original_filename" in texts.columns else "invoice_id")


def revalidations(records: DataFrame) -> DataFrame:
    """An event for each record decided anew, with what it now is, each part as JSON."""
    parts = [c for c in ("extracted", "validations", "suggested_expense_account", "traffic_light", "decision_reasons", "booking_proposal", "blocked") if c in records.columns]
    told = records.select("invoice_id", *[(F.to_json(c) if records.schema[c].dataType.typeName() in ("struct", "array") else F.col(c).cast("string")).alias(c) for c in parts])
    return events(told, "revalidate", **{c: c for c in parts})


def log(audit: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Adds events to the log, once: a batch of a name that the log has adds nothing.

    Without a name, events are a batch by what they say, whenever that was.
    """
    store.write_once(audit, path, store.content_key(audit.drop("ts")) if batch is None else batch)
