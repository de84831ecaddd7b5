"""Reversible line deduplication over a growing corpus.

State is an exact table of reference counts, one row per line key with the number
of documents that hold it, and beside it one cuckoo filter per shard of the keys
that have reached the threshold. Inserting documents adds to the counts and
deleting them subtracts; keys that cross the threshold on the way are inserted into
or deleted from their shard's filter, so that a line that fell to few enough
documents comes back. A filter that overflows is made anew, larger, from the exact
table, and all are, for twice as many shards or more, once shards hold more than
``SHARD_KEYS`` keys on average. Both tables can be saved and loaded.

Filters let a document's lines be tested while the text is being read. While they
are small (``FILTER_BYTES``) each task has them all; else keys are dealt to the
shards and probed where the filters lie. What a filter reports is confirmed against
the exact table, so results don't depend on hash collisions in it.

Keys are 128-bit hashes of a line stripped of ASCII white space with A-Z
lower-cased. Every row counts as a document of its own; null and empty texts have
one empty line, whose key is empty and never counted. Rows with equal doc_id and
text get equal results. Documents that aren't in an index can be cleaned by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl, portions, raw_texts, stash, with_columns

SLOTS = 4
#: Repeated keys of a shard on average, at most, and shards at most (which bounds what is known of each).
SHARD_KEYS = 16_384
MOST_SHARDS = 100_000
#: Filters, and likewise the keys that they report wrongly, go to every task up to this size in total; beyond it keys go to the shards.
FILTER_BYTES = 64 << 20
#: Keys that are probed together where a filter lies.
PART_KEYS = 250_000
_FLUSH = 200_000


def line_key(line: bytes) -> bytes:
    """The normalised line, hashed; empty for a line of white space."""
    line = line.strip(b" \t\n\r\x0b\x0c").lower()
    return xxhash.xxh3_128_digest(line) if line else b""


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["key", "n_docs"])
        held.clear()
        return out

    for batch in batches:
        for text in raw_texts(batch):
            for key in {line_key(x) for x in text.split(b"\n")}:
                if key:
                    held[key] = held.get(key, 0) + 1
            if len(held) > _FLUSH:
                yield flush()
    if held:
        yield flush()


class CuckooFilter:
    """Cuckoo filter over 16-byte keys: 16-bit fingerprints, four to a bucket."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def read(cls, body: bytes) -> CuckooFilter:
        table = np.frombuffer(body, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    @staticmethod
    def places(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of keys given as rows of 16 bytes."""
        parts = np.ascontiguousarray(keys).view("<u4").reshape(-1, 4)
        mark = np.maximum(parts[:, 1] & 0xFFFF, 1).astype(np.uint16)
        one = parts[:, 2] & np.uint32(buckets - 1)
        return mark, one, CuckooFilter.other(one, mark, buckets)

    @staticmethod
    def other(bucket, mark, buckets: int):
        return bucket ^ ((np.uint32(0x5BD1E995) * np.asarray(mark, np.uint32)) & np.uint32(buckets - 1))

    def insert(self, key: bytes, tries: int = 500) -> bool:
        mark, one, two = (x[0] for x in self.places(np.frombuffer(key, np.uint8), self.buckets))
        for bucket in (one, two):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = int(one)
        for k in range(tries):
            slot = k % SLOTS
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = int(self.other(np.uint32(bucket), mark, self.buckets))
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, one, two = (x[0] for x in self.places(np.frombuffer(key, np.uint8), self.buckets))
        for bucket in (one, two):
            found = np.flatnonzero(self.table[bucket] == mark)
            if len(found):
                self.table[bucket, found[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Whether the filter may hold each key, given as rows of 16 bytes."""
        mark, one, two = self.places(keys, self.buckets)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        """A filter of these keys, as large as they need."""
        buckets = 1 << max(4, int(np.ceil(np.log2(max(len(keys), 1) * 1.25 / (SLOTS * 0.85)))))
        while True:
            own = cls(buckets)
            if all(own.insert(k) for k in keys):
                return own
            buckets *= 2


class Shards:
    """The filters of all shards, for a task that has them all."""

    def __init__(self, bodies: dict[int, bytes], shards: int):
        self.shards = shards
        self.buckets, self.start = np.ones(shards, np.int64), np.zeros(shards, np.int64)
        parts, at = [np.zeros((1, SLOTS), np.uint16)], 1
        for shard, body in bodies.items():
            own = np.frombuffer(body, np.uint16).reshape(-1, SLOTS)
            self.buckets[shard], self.start[shard], at = len(own), at, at + len(own)
            parts.append(own)
        self.table = np.concatenate(parts)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        shard = shard_of(keys, self.shards)
        start, buckets = self.start[shard], self.buckets[shard].astype(np.uint32)
        mark, one, two = CuckooFilter.places(keys, buckets)
        return ((self.table[start + one] == mark[:, None]) | (self.table[start + two] == mark[:, None])).any(axis=1)


class Keys:
    """A set of 16-byte keys in 16 bytes each."""

    def __init__(self, keys: pa.ChunkedArray):
        some = [chunk.slice(i, 65_536) for chunk in keys.chunks for i in range(0, len(chunk), 65_536)]
        parts = np.concatenate([np.zeros((0, 2), np.uint64), *[np.frombuffer(b"".join(c.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64) for c in some]])
        parts = parts[np.lexsort((parts[:, 1], parts[:, 0]))]
        self.high, self.low = np.ascontiguousarray(parts[:, 0]), np.ascontiguousarray(parts[:, 1])

    def __len__(self) -> int:
        return len(self.high)

    def __contains__(self, key: bytes) -> bool:
        high, low = np.uint64(int.from_bytes(key[:8])), np.uint64(int.from_bytes(key[8:]))
        begin, end = np.searchsorted(self.high, high, "left"), np.searchsorted(self.high, high, "right")
        at = begin + np.searchsorted(self.low[begin:end], low)
        return bool(at < end and self.low[at] == low)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(keys).reshape(-1, 16)[:, :4]).view(">u4").ravel().astype(np.int64) % shards


def _bytes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)


def _fresh(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "body": [CuckooFilter.of([bytes(k) for k in rows["key"]]).table.tobytes()], "whole": [True]})


def _update(old: pd.DataFrame, crossed: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after the keys that fell below the threshold and those that reached it; not whole if it overflowed."""
    own = CuckooFilter.read(old["body"].iloc[0]) if len(old) else CuckooFilter(16)
    gone, come = ([bytes(k) for k in crossed["key"][crossed["add"] == way]] for way in (False, True))
    whole = all([own.delete(k) for k in gone]) and all(own.insert(k) for k in come)
    return pd.DataFrame({"shard": (old if len(old) else crossed)["shard"].iloc[:1], "body": [own.table.tobytes()], "whole": [whole]})


_FILTER = "shard long, body binary, whole boolean"


def _hits(batches: Iterator[pa.RecordBatch], known: Shards) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[np.ndarray]]]:
    """Portions of a table with the lines of each text and whether the filters may hold each."""
    for batch in portions(batches, 1024, "text"):
        split = [t.split(b"\n") for t in raw_texts(batch)]
        keys = [[line_key(x) for x in lines] for lines in split]
        flat = [k for own in keys for k in own if k]
        found = iter(known.contains(_bytes(flat)).tolist() if flat else ())
        yield batch, split, [[k if k and next(found) else b"" for k in own] for own in keys]


def _unused(name: str, df: DataFrame) -> str:
    while name in df.columns:
        name += "_"
    return name


class LineIndex:
    """Reference counts of line keys (key, n_docs) and filters of the repeated ones (shard, body), and what follows from them for documents."""

    def __init__(self, refs: DataFrame, filters: DataFrame, shards: int, min_docs: int = 10):
        self.refs, self.filters, self.shards, self.min_docs = refs, filters, shards, min_docs

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10) -> LineIndex:
        refs = stash(cls._counts(docs), "line-refs")
        own = cls(refs, refs, 1, min_docs)
        own.shards = own._shards_wanted()
        own._renew()
        return own

    def _shards_wanted(self) -> int:
        return min(MOST_SHARDS, max(1, -(-self.repeated().count() // SHARD_KEYS)))

    def _renew(self) -> None:
        """All filters made anew from the exact table."""
        self.filters = stash(self._dealt(self.repeated()).groupBy("shard").applyInPandas(_fresh, _FILTER).select("shard", "body"), "line-filters")

    @staticmethod
    def _counts(docs: DataFrame) -> DataFrame:
        partial = docs.select("text").mapInArrow(_count_keys, "key binary, n_docs long")
        return partial.groupBy("key").agg(F.sum("n_docs").alias("n_docs"))

    def _dealt(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % self.shards)

    def _merged(self, docs: DataFrame, sign: int) -> LineIndex:
        old = self.refs.select("key", F.col("n_docs").alias("was"), F.lit(0).cast("long").alias("change"))
        new = self._counts(docs).select("key", F.lit(0).cast("long").alias("was"), (F.col("n_docs") * sign).alias("change"))
        total = old.unionByName(new).groupBy("key").agg(F.sum("was").alias("was"), (F.sum("was") + F.sum("change")).alias("n_docs"))
        both = stash(total, "line-refs")
        add = F.col("n_docs") >= self.min_docs
        crossed = self._dealt(both.filter((F.col("was") >= self.min_docs) != add).select("key", add.alias("add")))
        updated = stash(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(_update, _FILTER), "line-filters")
        out = LineIndex(both.filter("n_docs > 0").select("key", "n_docs"), updated.select("shard", "body"), self.shards, self.min_docs)
        if not updated.filter("NOT whole").isEmpty():
            larger = out._dealt(out.repeated()).join(updated.filter("NOT whole").select("shard"), "shard").groupBy("shard").applyInPandas(_fresh, _FILTER)
            out.filters = stash(updated.filter("whole").unionByName(larger).select("shard", "body"), "line-filters")
        wanted = out._shards_wanted()
        if wanted > out.shards:
            out.shards = min(MOST_SHARDS, max(wanted, 2 * out.shards))
            out._renew()
        return out

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with further documents counted."""
        return self._merged(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without documents that it holds; their lines stop counting."""
        return self._merged(docs, -1)

    def save(self, path: str) -> None:
        """Writes both tables and the settings into a folder, replacing what is there."""
        self.refs.write.mode("overwrite").parquet(f"{path}/refs")
        self.filters.write.mode("overwrite").parquet(f"{path}/filters")
        self.refs.sparkSession.createDataFrame([(self.shards, self.min_docs)], "shards int, min_docs int").write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        refs, filters, settings = (spark.read.parquet(f"{path}/{t}") for t in ("refs", "filters", "settings"))
        own = settings.first()
        return cls(refs, filters, own["shards"], own["min_docs"])

    def repeated(self) -> DataFrame:
        return self.refs.filter(F.col("n_docs") >= self.min_docs).select("key")

    def apply(self, docs: DataFrame) -> DataFrame:
        """All columns of ``docs`` with repeated lines gone from text, plus n_lines (before) and n_dropped, which replace columns of these names."""
        return self._applied(docs.drop("n_lines", "n_dropped"), "n_lines", "n_dropped")

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` with repeated lines gone from text; all its columns stay."""
        lines = _unused("n_lines", docs)
        return self._applied(docs, lines, _unused("n_dropped", docs)).select(*[F.col(f"`{c}`") for c in docs.columns])

    def _applied(self, docs: DataFrame, n_lines: str, n_dropped: str) -> DataFrame:
        size = self.filters.agg(F.sum(F.octet_length("body")).alias("bytes")).first()["bytes"] or 0
        if size > FILTER_BYTES:
            return self._by_shard(docs, n_lines, n_dropped)
        known = Shards({r["shard"]: bytes(r["body"]) for r in self.filters.select("shard", "body").collect()}, self.shards)
        held = docs.sparkSession.sparkContext.broadcast(known)

        def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for _, _, keys in _hits(batches, held.value):
                seen.update(k for own in keys for k in own if k)
                if len(seen) > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary())], names=["key"])
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary())], names=["key"])

        wrong = stash(docs.select("text").mapInArrow(reported, "key binary").distinct().join(self.repeated(), "key", "left_anti"), "line-wrong")
        if wrong.count() * 16 > FILTER_BYTES:
            return self._by_shard(docs, n_lines, n_dropped)
        spared = docs.sparkSession.sparkContext.broadcast(Keys(wrong.toArrow()["key"]))

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, split, keys in _hits(batches, held.value):
                left = [[x for x, k in zip(lines, own, strict=True) if not k or k in spared.value] for lines, own in zip(split, keys, strict=True)]
                yield _shortened(batch, split, left, n_lines, n_dropped)

        return docs.mapInArrow(drop, f"{ddl(docs)}, `{n_lines}` long, `{n_dropped}` long")

    def _by_shard(self, docs: DataFrame, n_lines: str, n_dropped: str) -> DataFrame:
        """The same where filters are too large to be sent to every task: keys go to the shards.

        A shard whose keys have many references, as a very common line makes it, is in as many parts as they fill.
        """
        row, gone = _unused("_row", docs), _unused("_gone", docs)
        named = docs.withColumn(row, F.xxhash64("doc_id", "text"))

        def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches, 1024, "text"):
                own = [list({line_key(x) for x in t.split(b"\n")} - {b""}) for t in raw_texts(batch)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(own)), [len(k) for k in own]))), pa.array([k for x in own for k in x], pa.binary())], names=["row", "key"])

        loads = self._dealt(self.refs).groupBy("shard").agg(F.ceil(F.sum("n_docs") / PART_KEYS).cast("long").alias("parts"))  # a row a shard
        loads = F.broadcast(stash(loads, "line-loads"))
        asked = self._dealt(named.select(F.col(row), "text").mapInArrow(keys_of, "row long, key binary"))
        asked = asked.join(loads, "shard").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
        every = F.explode(F.expr("sequence(0L, parts - 1)"))
        filters = self.filters.join(loads, "shard").select("shard", "body", every.alias("part"))

        def probe(some: pd.DataFrame, filter_: pd.DataFrame) -> pd.DataFrame:
            if not len(some) or not len(filter_):
                return pd.DataFrame({"row": [], "key": [], "part": []})
            return some[CuckooFilter.read(filter_["body"].iloc[0]).contains(_bytes(some["key"].tolist()))][["row", "key", "part"]]

        hits = asked.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInPandas(probe, "row long, key binary, part long")
        sure = self._dealt(self.repeated()).join(loads, "shard").select("key", every.alias("part"))
        found = hits.join(sure, ["key", "part"]).groupBy(F.col("row").alias(row)).agg(F.collect_set("key").alias(gone))

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches, 1024, "text"):
                split = [t.split(b"\n") for t in raw_texts(batch)]
                away = [set(k or ()) for k in batch.column(batch.schema.get_field_index(gone)).to_pylist()]
                left = [[x for x in lines if not own or line_key(x) not in own] for lines, own in zip(split, away, strict=True)]
                yield _shortened(batch.drop_columns([gone]), split, left, n_lines, n_dropped)

        return named.join(found, row, "left").select(*[F.col(f"`{c}`") for c in docs.columns], gone).mapInArrow(drop, f"{ddl(docs)}, `{n_lines}` long, `{n_dropped}` long")


def _shortened(batch: pa.RecordBatch, split: list, left: list, n_lines: str, n_dropped: str) -> pa.RecordBatch:
    counts = {n_lines: [len(x) for x in split], n_dropped: [len(x) - len(y) for x, y in zip(split, left, strict=True)]}
    return with_columns(batch, text=pa.array([b"\n".join(x).decode() for x in left], pa.string()), **{k: pa.array(v, pa.int64()) for k, v in counts.items()})


def op9_line_dedup(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = LineIndex.build(docs).apply(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH named AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (
  SELECT r, doc_id, i, l, regexp_replace(regexp_replace(
           translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k
  FROM (SELECT r, doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
        FROM (SELECT r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM named) s) t),
hot AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(h.k) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE h.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN hot h ON lines.k = h.k GROUP BY r, doc_id
"""
