"""Vector codes by product quantisation, with nearest entries found in annuli of norms.

Components become whole numbers (floor of ``SCALE`` times the component), a vector is cut
into ``PARTS`` equal parts, and each part position has a codebook of ``ENTRIES`` entries,
first the parts of the vectors with the smallest ids, then ``ROUNDS`` times the rounded
means of what was assigned to each entry. Distances are exact integers.

An entry whose norm differs from a part's by more than the best distance so far can't be
nearer. So entries are sorted by norm; a part begins at its own norm, takes the next few
entries on both sides, and searches for the interval of norms that its best distance still
allows, ends included, until no entry of that annulus is left. Ties go to the lower index.

Each round is one pass over the stored parts; a task sends a sum for each entry and
position, so what reaches the driver has the size of the codebooks.

Vectors that are null or hold null or non-finite components are dropped. Vectors shorter
than the longest count as if zeros followed, as does a length that four doesn't divide.
Rows that repeat a vec_id are rows of their own; of the first entries' candidates that
share an id the smaller vector comes first. Rows without an id are kept, and come last
there. With fewer rows than entries there are as many entries as rows; without rows the
result is empty. Results are exact for components of a magnitude under 2**20.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, scratch, stash
from .minhash import with_unique

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Entries that a part takes on each side of its norm at a time.
STEP = 8
#: Rows that one numpy pass takes.
TOGETHER = 2_048


def finite(v: Column) -> Column:
    """Whether an array is there, and all its components are finite."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(v: Column, scale: int) -> Column:
    """Components times ``scale``, rounded down."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of a list column, each of ``dims`` components; zeros follow shorter ones."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


class Annuli:
    """A codebook's entries sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries * entries).sum(axis=1).astype(float))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance, for each row of x."""
        own = np.sqrt((x * x).sum(axis=1).astype(float))
        low = high = np.searchsorted(self.norms, own)  # what lies in [low, high) has been evaluated
        best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.norms))
        going = np.arange(len(x))
        while len(going):
            least, most = self._annulus(own[going], best[going])
            left = np.maximum(low[going] - STEP, least)
            right = np.minimum(high[going] + STEP, most)
            for begin, end in ((left, np.maximum(low[going], left)), (np.minimum(high[going], right), right)):
                for k in range(int((end - begin).max())):
                    some = begin + k < end
                    rows, at = going[some], (begin + k)[some]
                    d = self.entries[at] - x[rows]
                    distance, entry = (d * d).sum(axis=1), self.order[at]
                    better = (distance < best[rows]) | (distance == best[rows]) & (entry < index[rows])
                    best[rows[better]], index[rows[better]] = distance[better], entry[better]
            low, high = low.copy(), high.copy()
            low[going], high[going] = np.minimum(low[going], left), np.maximum(high[going], right)
            least, most = self._annulus(own[going], best[going])
            going = going[(low[going] > least) | (high[going] < most)]
        return index, best

    def _annulus(self, own: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of entries whose norms differ by the best distance or less; rounding only widens it."""
        reach = np.sqrt(best.astype(float)) * (1 + 1e-9) + 1e-6 * (1 + own)
        return np.searchsorted(self.norms, own - reach, "left"), np.searchsorted(self.norms, own + reach, "right")


def assign(x: np.ndarray, annuli: list[Annuli]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance, for each row and part."""
    width = x.shape[1] // len(annuli)
    found = [a.nearest(x[:, i * width : (i + 1) * width]) for i, a in enumerate(annuli)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts x entries x positions) after one round: each entry the rounded-down mean of its parts; unused ones stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books]
        sums, counts = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for batch in portions(batches, rows=TOGETHER):
            x = matrix(batch.column(0), parts * width)
            code, _ = assign(x, annuli)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], x[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        place = np.tile(np.arange(width), len(part))
        part, entry = np.repeat(part, width), np.repeat(entry, width)
        arrays = part.astype(np.int32), entry.astype(np.int32), place.astype(np.int32), sums[part, entry, place], counts[part, entry]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["part", "entry", "place", "total", "n"])

    sums = rows.select("v").mapInArrow(run, "part int, entry int, place int, total long, n long")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # as many rows as the codebooks have numbers, at most
        out[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return out


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector kept."""
    with scratch() as made:
        done = stash(_compressed(vectors, id_column, vector_column, label_column, parts, entries, rounds), "codes")
        made.append(done)
    return done


def _compressed(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, parts: int, entries: int, rounds: int) -> DataFrame:
    v, label = F.col(f"`{vector_column}`"), F.col(f"`{label_column}`").cast("string")
    good = vectors.filter(finite(v)).select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.when(label.isNull(), "").otherwise(F.concat(F.lit("="), label)).alias("label"), whole(v, SCALE).alias("v"))
    rows = stash(good, "parts")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    dims = -(-max(longest, 1) // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).toArrow()["v"].combine_chunks()  # ``entries`` rows at most
    start = matrix(first, dims) if len(first) else np.zeros((0, dims), np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2))
    for _ in range(rounds if len(start) else 0):
        books = moved(rows, books)
    written = ",".join(str(x) for x in books.ravel().tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books]
        for batch in portions(batches, rows=TOGETHER):
            code, error = assign(matrix(batch.column(2), dims), annuli)
            text = [bytes(c).hex() if entries <= 256 else "".join(f"{x:04x}" for x in c) for c in (code.astype(np.uint8) if entries <= 256 else code)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    coded = stash(rows.mapInArrow(run, "vec_id long, label string, code string, error long"), "coded")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = with_unique(coded, by_label, ["label"], "n", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(written.encode()).hexdigest()).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The same in SQL: all entries of all parts compared in each round."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (
  SELECT p.r, p.part, e.entry, sum((p.x - e.x) * (p.x - e.x)) AS d
  FROM parts p JOIN book{r} e ON p.part = e.part AND p.place = e.place GROUP BY ALL),
own{r} AS MATERIALIZED (SELECT r, part, min({{'d': d, 'entry': entry}}) AS best FROM d{r} GROUP BY ALL)""")
        if r < ROUNDS:
            steps.append(f"""
mean{r} AS (
  SELECT o.part, o.best.entry AS entry, p.place, sum(p.x) AS total, count(*) AS n
  FROM own{r} o JOIN parts p ON o.r = p.r AND o.part = p.part GROUP BY ALL),
book{r + 1} AS MATERIALIZED (
  SELECT e.part, e.entry, e.place, CASE WHEN m.n IS NULL THEN e.x ELSE CAST((m.total - ((m.total % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x
  FROM book{r} e LEFT JOIN mean{r} m ON e.part = m.part AND e.entry = m.entry AND e.place = m.place)""")
    return f"""
WITH good AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT CAST(ceil(max(len(v)) / {PARTS}.0) AS BIGINT) AS w FROM good),
each AS (
  SELECT r, unnest(range(CAST({PARTS} * w AS BIGINT))) AS i, v, w FROM good, width),
parts AS MATERIALIZED (
  SELECT r, i // w AS part, i % w AS place, coalesce(CAST(floor({SCALE} * CAST(v[i + 1] AS DOUBLE)) AS BIGINT), 0) AS x FROM each),
book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, place, x FROM parts WHERE r <= {ENTRIES}),{",".join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', CAST(best.entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM own{ROUNDS} GROUP BY r),
told AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM good JOIN coded USING (r), told
"""


ORACLE = _oracle()
