"""Structured Streaming counterparts of the batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals
from ..plans import invoices
from ..schemas import PATCH
from ..sources import store
from ..sources.master import Master


def invoice_stream(spark: SparkSession, path: str, master: Master | None = None) -> DataFrame:
    """Records from a folder into which rows (invoice_id, text) arrive as Parquet files; there is no state."""
    texts = spark.readStream.schema("invoice_id string, text string").parquet(path)
    return invoices.process(texts, master)


def patch_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PATCH).parquet(path)


def latest_values(patches: DataFrame) -> DataFrame:
    """invoice_id, field, value, seq: what each corrected field now is, updated as patches arrive in any order; an explicit null counts."""
    each = patches.select("invoice_id", "seq", F.explode("patch").alias("field", "value"))
    newest = each.groupBy("invoice_id", "field").agg(F.max_by(F.struct("value"), "seq").alias("v"), F.max("seq").alias("seq"))
    return newest.select("invoice_id", "field", F.col("v.value").alias("value"), "seq")


def upsert_batches(changes: DataFrame, path: str, key: str, checkpoint: str, order: str | None = None, buckets: int = store.BUCKETS):
    """A query that keeps in a bucketed table under ``path`` one row per key, the newest; ``store.read`` gives the table.

    A micro-batch rewrites only the buckets that its keys fall into; one that is run again changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store.upsert(batch, path, key, number, order, buckets)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def upload_batches(texts: DataFrame, records_path: str, audit_path: str, checkpoint: str):
    """A query that uploads texts as they arrive: each micro-batch leaves its records and events once, however often it is run."""

    def upload(batch: DataFrame, number: int) -> None:
        invoices.upload(batch, records_path, audit_path, number)

    return texts.writeStream.foreachBatch(upload).option("checkpointLocation", checkpoint)


def matched(uploads: DataFrame, corrections: DataFrame, key: str, at: str, corrected_at: str, within: str, late: str | None = None) -> DataFrame:
    """Uploads with each correction of their key within an interval after them, and uploads without one.

    On two streams ``late`` is the watermark of both: an upload without a correction comes out once none can come any more, and what
    no later row can meet leaves the state. On two tables corrections are points in the uploads' intervals, so a key may have any
    share of the rows. Columns besides the key have different names.
    """
    other = corrections.withColumnRenamed(key, "_key")
    end = F.col(at) + F.expr(f"INTERVAL {within}")
    if uploads.isStreaming:
        left, right = uploads.withWatermark(at, late), other.withWatermark(corrected_at, late)
        met = left.join(right, (F.col(key) == F.col("_key")) & (F.col(corrected_at) >= F.col(at)) & (F.col(corrected_at) <= end), "left")
        return met.drop("_key")
    spans = uploads.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in uploads.columns])).withColumns({"_from": F.unix_micros(F.col(at).cast("timestamp")), "_to": F.unix_micros(end.cast("timestamp"))})
    points = other.withColumn("_time", F.unix_micros(F.col(corrected_at).cast("timestamp")))
    more = [F.col(f"`{c}`") for c in other.columns if c != "_key"]
    met = intervals.hold(points, spans.select("_row", key, "_from", "_to"), "_time", "_from", "_to", ("_key", key)).select("_row", *more)
    alone = spans.select("_row").join(met.select("_row").distinct(), "_row", "left_anti")
    return met.unionByName(alone, allowMissingColumns=True).select("_row.*", *more)


def windowed(events: DataFrame, ts: str, kind: str, size: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Events by kind and window (tumbling, or sliding with ``slide``); works on a batch, and on a stream with ``late`` as watermark."""
    held = events.withWatermark(ts, late) if late else events
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return held.groupBy(window.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a key: events with less than ``gap`` between them."""
    held = events.withWatermark(ts, late) if late else events
    return held.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")
