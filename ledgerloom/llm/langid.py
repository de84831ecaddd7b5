"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed byte trigrams of lower-cased letters,
learnt from labelled documents. A document is taken to be drawn from a mixture of
languages; expectation-maximisation estimates the proportions, and the set of
languages is the one of least penalised likelihood: sets grow by the language of
the next largest proportion as long as the gain exceeds the penalty for one more
proportion. Counting and learning are Spark jobs; tasks do the arithmetic in numpy.

The likelihoods are fitted on a bounded, seeded sample: about ``TRAIN_DOCS``
labelled documents of each language. Null texts and texts without a letter are
``und`` with score 0, as is everything where nothing was labelled. Rows with equal
texts get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, ddl, slices, with_columns

#: Documents of each language that the likelihoods are fitted on, about.
TRAIN_DOCS = 8_000
BUCKETS = 1 << 13
#: Trigrams of a text overlap: three of them count as one observation in the penalised likelihood.
OVERLAP = 3
ROUNDS = 12
_MADE = ("lang_pred", "score", "languages")
_KEEP = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_HASH = np.random.default_rng(7).integers(0, BUCKETS, (3, 256), dtype=np.uint16)


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's category L is in a text; numbers like ² or Ⅷ are none."""
    return any(map(str.isalpha, text))


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the text, bucket and count of each distinct trigram of lower-cased UTF-8 texts, in order."""
    data = _KEEP[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    lengths = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    middle = data[1:-1]
    codes = _HASH[0][data[:-2]] ^ _HASH[1][middle] ^ _HASH[2][data[2:]]
    inside = middle != 32
    flat = np.bincount(owner[: len(middle)][inside] * BUCKETS + codes[inside], minlength=1)
    at = np.flatnonzero(flat)
    return at // BUCKETS, at % BUCKETS, flat[at].astype(np.float32)


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the probability of each bucket under each, from rows (doc_id, text, lang)."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    scale = 1 << 20
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(int(np.ceil(scale * min(1.0, train_docs / n))))) for name, n in sorted(sizes.items())])
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = [t.lower().encode() for t in batch.column(1).to_pylist()]
            for start, end in slices(texts, 1 << 19):
                row, bucket, n = trigrams(texts[start:end])
                for k in range(start, end):
                    own = slice(*np.searchsorted(row, [k - start, k - start + 1]))
                    held.setdefault(langs[k], np.zeros(BUCKETS))[bucket[own]] += n[own]
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    totals = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sizes)
    table = np.full((BUCKETS, len(names)), 0.5)
    table[totals["bucket"], [names.index(x) for x in totals["lang"]]] += totals["n"]
    return names, (table / table.sum(axis=0)).astype(np.float32)


def mixture(p: np.ndarray, row: np.ndarray, n: np.ndarray, rows: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (rows x languages) and log-likelihood of each row, by EM from equal proportions.

    ``p`` has the probability of each observed trigram under each language.
    """
    starts = np.searchsorted(row, np.arange(rows))
    total = np.bincount(row, n, rows)[:, None]
    pi = np.full((rows, p.shape[1]), 1 / p.shape[1], np.float32)
    for _ in range(rounds):
        joint = p * pi[row]
        joint *= (n / joint.sum(axis=1))[:, None]
        pi = (np.add.reduceat(joint, starts, axis=0) / total).astype(np.float32)
    return pi, np.add.reduceat(n * np.log((p * pi[row]).sum(axis=1)), starts)


def infer(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Proportions of the selected languages, 0 for the others; a row of zeros where a text has no trigram."""
    out = np.zeros((len(texts), table.shape[1]), np.float32)
    row, bucket, n = trigrams(texts)
    seen, row = np.unique(row, return_inverse=True)
    if not len(seen):
        return out
    p = table[bucket]
    full, best = mixture(p, row, n, len(seen), ROUNDS)
    ranked = np.argsort(-full, axis=1, kind="stable")
    total = np.bincount(row, n)
    penalty = 0.5 * np.log(np.maximum(total / OVERLAP, 2))
    starts = np.searchsorted(row, np.arange(len(seen)))
    chosen = np.zeros_like(full)
    chosen[np.arange(len(seen)), ranked[:, 0]] = 1
    like = np.add.reduceat(n * np.log(p[np.arange(len(row)), ranked[row, 0]]), starts)
    open_rows = np.flatnonzero((best - like) / OVERLAP > penalty)
    for k in range(2, table.shape[1] + 1):
        if not len(open_rows):
            break
        place = np.full(len(seen), -1)
        place[open_rows] = np.arange(len(open_rows))
        mine = place[row] >= 0
        own = place[row[mine]]
        columns = ranked[open_rows, :k]
        pi, now = mixture(np.take_along_axis(p[mine], columns[own], axis=1), own, n[mine], len(open_rows), ROUNDS)
        better = (now - like[open_rows]) / OVERLAP > penalty[open_rows]
        open_rows, pi, now = open_rows[better], pi[better], now[better]
        chosen[open_rows] = 0
        np.put_along_axis(wide := np.zeros((len(open_rows), table.shape[1]), np.float32), ranked[open_rows, :k], pi, axis=1)
        chosen[open_rows] = wide
        like[open_rows] = now
    out[seen] = chosen
    return out


def identify(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """``docs`` without text, with lang_pred, score (its proportion) and languages: the selected set as name:proportion, largest first.

    Columns of these names that ``docs`` has are replaced; all others stay.
    """
    docs = docs.drop(*_MADE)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            texts = [t.lower().encode() for t in raw]
            pred, score, mix = [], [], []
            for start, end in slices(texts, 1 << 18):
                pi = infer(texts[start:end], held.value) if names else np.zeros((end - start, 0))
                for text, own in zip(raw[start:end], pi, strict=True):
                    if not names or not has_letter(text):
                        pred.append("und"), score.append(0.0), mix.append("")
                        continue
                    own = own if own.any() else np.full(len(names), 1 / len(names))
                    order = [k for k in np.argsort(-own, kind="stable") if own[k] > 0]
                    pred.append(names[order[0]])
                    score.append(min(1.0, float(own[order[0]])))
                    mix.append(",".join(f"{names[k]}:{own[k]:.3f}" for k in order))
            yield with_columns(batch.drop_columns(["text"]), lang_pred=pa.array(pred, pa.string()), score=pa.array(score, pa.float64()), languages=pa.array(mix, pa.string()))

    held_columns = f"{ddl(docs, 'text')}, " if len(docs.columns) > 1 else ""
    return docs.mapInArrow(run, f"{held_columns}lang_pred string, score double, languages string")


def op1_language_id(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    names, table = learn(docs.filter(crc_mod("doc_id", 3) != 1))
    asked = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return identify(asked, names, table)
