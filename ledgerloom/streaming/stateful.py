"""Revalidation as a stateful stream: records and patches in any order, the newest value of each field kept by invoice."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans import invoices
from ..schemas import EXTRACTED, FIELDS
from ..sources.master import Master

#: What reaches the state: a record's fields as JSON, or one patch.
INPUT = "invoice_id string, ts timestamp, seq long, record string, patch map<string,string>"


class Overlay(StatefulProcessor):
    """Keeps an invoice's record and, for each corrected field, the value of the patch with the greatest seq; gives both whenever one changes.

    Patches that come before their record wait for it. An invoice that nothing has reached for ``keep_ms`` of event time leaves the state.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "seq long, record string")
        self.fields = handle.getMapState("fields", "field string", "seq long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for pdf in rows:
            for seq, record, patch, ts in zip(pdf["seq"], pdf["record"], pdf["patch"], pdf["ts"], strict=True):
                latest = max(latest, int(ts.timestamp() * 1000))
                if isinstance(record, str):
                    if not self.record.exists() or self.record.get()[0] <= seq:
                        self.record.update((int(seq), record))
                for field, value in (patch.items() if isinstance(patch, dict) else patch if patch is not None else ()):
                    if not self.fields.containsKey((field,)) or self.fields.getValue((field,))[0] < seq:
                        self.fields.updateValue((field,), (int(seq), value))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.keep_ms)
        if self.record.exists():
            changed = {field: value for (field,), (_, value) in self.fields.iterator()}
            yield pd.DataFrame({"invoice_id": [key[0]], "record": [self.record.get()[1]], "patch": [json.dumps(changed)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.record.clear()
        self.fields.clear()
        return iter(())

    def close(self) -> None:
        pass


def revalidated(records: DataFrame, patches: DataFrame, late: str, keep: str, master: Master | None = None) -> DataFrame:
    """Streams of records (invoice_id, ts, extracted) and patches (invoice_id, ts, seq, patch) as one of decisions.

    outcome is ``decided`` for a record as patches leave it, again each time that it changes (the last counts), or
    ``quarantined`` for a patch whose amounts aren't numbers. Needs the RocksDB state store.
    """
    amounts = F.col("patch")
    bad = patches.filter(invoices.malformed(amounts)).select("invoice_id", F.lit("quarantined").alias("outcome"), F.to_json("patch").alias("patch"))
    good = patches.filter(~invoices.malformed(amounts)).select("invoice_id", "ts", "seq", F.lit(None).cast("string").alias("record"), "patch")
    told = records.select("invoice_id", "ts", F.unix_micros("ts").alias("seq"), F.to_json("extracted", {"ignoreNullFields": "false"}).alias("record"), F.lit(None).cast("map<string,string>").alias("patch"))
    both = told.unionByName(good).withWatermark("ts", late)
    overlay = Overlay(int(pd.Timedelta(keep).total_seconds() * 1000))
    held = both.groupBy("invoice_id").transformWithStateInPandas(overlay, "invoice_id string, record string, patch string", "Append", "eventTime")
    fields = held.select("invoice_id", F.from_json("record", EXTRACTED).alias("extracted"), F.from_json("patch", "map<string,string>").alias("_patch"))
    rows = fields.select("invoice_id", *[invoices._patched(f, F.col(f"extracted.{f}"), F.col("_patch")) for f in FIELDS])
    decided = invoices.shaped(invoices.decide(rows, master)).withColumn("outcome", F.lit("decided"))
    return decided.unionByName(bad, allowMissingColumns=True)
