"""Corpus preparation in five stages, each on all that the one before kept.

Quality filter, line dedup, near-dedup, mixing to target weights, encoding. Every
stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, linededup, minhash, mixing, quality
from ledgerloom.llm.common import crc_mod, discard, scratch, stash, table

VOCABULARY = "byte_bpe_50k.json"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from the labelled ones that aren't held out, doesn't reject."""
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    return quality.accept(docs, quality.fit(docs.filter(crc_mod("doc_id", 5) != 0), labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more share; a document may end up empty, but stays."""
    out = linededup.LineIndex.build(docs).clean(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash.keep_one(docs, words=5, percent=80)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rates keep: those most likely clean, and what targets leave of low and toxic ones; none is repeated after it was deduplicated."""
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"), ceiling=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their number, and digests of ids and decoded text."""
    import public_tokenizers

    out = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path(VOCABULARY), decoded=True)
    digests = F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return out.select("doc_id", "source", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", *digests)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_domains),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express the learnt stages; tests compare the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage wrote for itself or read is deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scratch() as kept:
            docs = stash(stage(spark, before, sf_dir), f"stage-{i + 1}")
            kept.append(docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
