"""The pipeline's result against plain versions of its stages, on one small table."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import mixing, quality
from ledgerloom.llm.common import crc_mod
from parity import DATA

public = pytest.importorskip("public_tokenizers")


def plain_line_dedup(rows, least=10):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").encode().lower()
    held = collections.Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")} if k)
    return [(i, "\n".join(x for x in t.split("\n") if held[key(x)] < least)) for i, t in rows]


def plain_near_dedup(rows, words=5, percent=80):
    sets = []
    for i, t in rows:
        w = t.encode().lower().split()
        sets.append((i, {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()))
    group = {i: i for i, _ in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, (a, one) in enumerate(sets):
        for b, two in sets[k + 1 :]:
            if one and two and 100 * len(one & two) >= percent * len(one | two):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return [(i, t) for i, t in rows if find(i) == i]


def test_the_pipeline_equals_plain_stages(spark):
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    learnt = crc_mod("doc_id", 5) != 0
    rules = quality.fit(docs.filter(learnt), labels.filter(learnt))
    good = {r.doc_id for r in quality.score(docs, rules, ["doc_id"]).collect() if r.score >= 0.3}
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id in good)
    rows = plain_near_dedup(plain_line_dedup(rows))
    left = spark.createDataFrame(rows, "doc_id long, text string")
    stays = {r.doc_id: r.copies for r in mixing.mix(left, labels, ceiling=1.0).select("doc_id", "copies").collect()}
    assert set(stays.values()) <= {0, 1}
    tokenizer = Tokenizer.from_file(str(public.path(corpus_pipeline.VOCABULARY)))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = {}
    for i, t in rows:
        if stays[i]:
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            packed = b"".join(x.to_bytes(4, "little") for x in ids)
            want[i] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(DATA)).collect()}
    assert got == want and 100 < len(got) < docs.count()


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(DATA)).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(DATA)).filter(F.col("n_tokens") > 0).count() == 0
