"""Helpers shared by the corpus operators: table access, stored intermediates, batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. In local mode alone it may be unset; one of the session's own is made then."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    fallback = getattr(spark, "_own_shared_dir", None)
    if fallback is None:
        fallback = spark._own_shared_dir = tempfile.mkdtemp(prefix="shared-")
    return fallback


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    for made in _OPEN[-1:]:
        made.append(out)
    return out


#: What is stashed within each open ``scratch``, innermost last.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Discards at its end all that was stashed within it, but for the frames put into the list it gives.

    What leaves it must be one of those frames or not depend on what was stashed.
    """
    _OPEN.append([])
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        paths = {getattr(df, "_stash_path", None) for df in kept}
        made = _OPEN.pop()
        discard(*[df for df in made if df._stash_path not in paths])
        for outer in _OPEN[-1:]:
            outer += [df for df in made if df._stash_path in paths]


def discard(*frames: DataFrame) -> None:
    """Deletes stashed tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def crc_mod(key: str, modulus: int) -> Column:
    """crc32 of an integer key written as text, modulo ``modulus``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; nulls become empty."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each, so that numpy temporaries stay small."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def portions(batches: Iterator[pa.RecordBatch], rows: int = 1024, column: str | None = None, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what Python holds of them at a time; by bytes of a column too, where one is named."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if column is None:
                yield part
                continue
            for start, end in slices(raw_texts(part, column), limit):
                yield part.slice(start, end - start)


def ddl(df: DataFrame, *without: str) -> str:
    """The schema of ``df`` as text, less some columns."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns added, or replaced where the name exists."""
    arrays = dict(zip(batch.schema.names, batch.columns, strict=True)) | columns
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
