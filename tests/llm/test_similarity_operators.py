"""SimHash groups, hard negatives and vector codes against plain versions."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import codes, hardneg, simhash
from ledgerloom.llm.graph import UnionFind
from parity import DATA, assert_same

TABLE = "vec_id long, embedding array<double>, label int, score string, row int, v string, n int"


def plain_fingerprint(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + words]).encode(), 42) for i in range(max(1, len(found) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, bits=4):
    """component by doc_id, all pairs compared."""
    sets, fps = UnionFind(), [(i, plain_fingerprint(t)) for i, t in rows if i is not None]
    for i, f in fps:
        sets.find(i)
        for j, g in fps:
            if (f ^ g).bit_count() <= bits:
                sets.union(i, j)
    return {i: sets.find(i) for i, _ in fps}


def test_op11_against_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = simhash.op11_simhash(spark, str(DATA)).collect()
    want = plain_groups(rows)
    assert {(r.doc_id, r.fingerprint) for r in got} == {(i, f"{plain_fingerprint(t):016x}") for i, t in rows} and len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want


def test_op11_odd_rows(spark):
    long = "wort " * 30_000 + "ende"
    rows = [(1, None), (2, ""), (3, " \t\x0b"), (4, "ein"), (4, "ganz anderer text mit wörtern"), (5, "EIN"), (6, "ganz anderer text mit wörtern"), (None, "ein"), (None, None), (7, long), (8, long.upper()), (8, long)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, fp int, rep string")
    got = simhash.near_duplicates(df).collect()
    want = plain_groups(rows)
    assert len(got) == len(rows) and all(r.component_id == want.get(r.doc_id) for r in got)
    assert {r.component_id for r in got if r.doc_id in (4, 5, 6)} == {4} and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [simhash.CELL, 40])
def test_op11_dense_groups(spark, monkeypatch, cell):
    """Fingerprints around a few centres and chains of them; small cells make every anchor hot."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(11)
    fps = []
    for centre in [rng.getrandbits(64) for _ in range(3)]:
        fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(120)]
    chain = [rng.getrandbits(64)]
    while len(chain) < 60:
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 4)))
    fps = list(dict.fromkeys(fps + chain))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    for bits in (4, 3):
        sets, want = UnionFind(), UnionFind()
        for r in simhash.links(classes, bits).collect():
            assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= bits
            sets.union(r.a, r.b)
        for i, f in enumerate(fps):
            for j in range(i):
                if (f ^ fps[j]).bit_count() <= bits:
                    want.union(signed[i], signed[j])
        assert {f: sets.find(f) for f in signed} == {f: want.find(f) for f in signed}


@pytest.mark.parametrize("width", [7, 21, 22, 32])
def test_anchors_cover_and_meet(width):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << width, 200, dtype=np.uint64)
    near = values ^ (np.uint64(1) << rng.integers(0, width, 200, dtype=np.uint64))
    row, anchor, home = simhash.anchors(values, width)
    assert (np.bitwise_count(values[row] ^ anchor) <= 2).all() and (np.bincount(row[home], minlength=200) == 1).all() and (np.bitwise_count(values[row[home]] ^ anchor[home]) <= 1).all()
    other, theirs, _ = simhash.anchors(near, width)
    assert all(set(anchor[home & (row == i)]) <= set(theirs[other == i]) for i in range(200))
    with pytest.raises(ValueError, match="bits"):
        simhash.blocks_of(18)


def test_op12_equals_sql(spark):
    assert_same(hardneg.op12_hard_negatives(spark, str(DATA)), hardneg.ORACLE)


def plain_negatives(rows, n_positives=5, k=10):
    """All pairs; rows are (id, vector, label)."""
    good = [(i, [int(np.floor(256 * x)) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (i, v, lab) in enumerate(good):
        if i % 100:
            continue
        scored = [(-dot(v, w), j, other) for b, (j, w, other) in enumerate(good) if a != b]
        for s, j, _ in sorted((s, j, o) for s, j, o in scored if o == lab)[:n_positives]:
            inside = sorted((t, m) for t, m, o in scored if o != lab and 30 * -s <= 100 * -t <= 90 * -s)[:k]
            out += [(i, j, r, m, -s, -t) for r, (t, m) in enumerate(inside, 1)]
    return sorted(out)


def test_op12_blocks_ties_and_odd_rows(spark, monkeypatch):
    for name, value in (("ROWS", 16), ("ANCHORS", 2), ("DIMS", 3)):
        monkeypatch.setattr(hardneg, name, value)
    rng = random.Random(4)
    rows = [(rng.choice([100, 200, 300]) if rng.random() < 0.08 else rng.randint(1, 90), [rng.choice([0.0, 0.25, 0.5, 1.0, -0.01]) for _ in range(rng.choice([7, 7, 7, 4]))], rng.choice([0, 0, 0, 1, 2])) for _ in range(150)]
    rows += [(100, [1.0] * 7, 0), (100, [1.0] * 7, 0), (400, [1e6] * 7, 1), (401, [1e6] * 7, 1), (402, [5e5] * 7, 0), (500, [], 0), (600, [1.0], None), (700, None, 0), (800, [float("nan")], 0), (900, [None, 1.0], 0), (None, [1.0], 0), (1000, [1.0], 77)]
    df = spark.createDataFrame([(*r, "s", 1, "v", 1) for r in rows], TABLE)
    got = hardneg.mine(df, F.col("id") % 100 == 0, F.col("label"))
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect()) == plain_negatives(rows)
    assert hardneg.mine(df.limit(0), F.col("id") % 100 == 0, F.col("label")).count() == 0
    assert hardneg.mine(df.filter("vec_id = 1000"), F.col("id") % 100 == 0, F.col("label")).count() == 0


def test_op13_equals_sql(spark):
    assert_same(codes.op13_vector_codes(spark, str(DATA)), codes.ORACLE)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 30), st.integers(1, 4), st.integers(1, 2000), st.integers(0, 2**32 - 1))
def test_annuli_find_the_nearest_entry(entries, rows, dims, size, seed):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-size, size + 1, (entries, dims)), rng.integers(-size, size + 1, (rows, dims))
    index, best = codes.Annuli(book).nearest(x)
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()


def plain_codes(rows, entries=256):
    good = [(i, [int(np.floor(1024 * x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(max((len(v) for _, v, _ in good), default=1), 1) // 4)
    x = np.array([v + [0] * (4 * width - len(v)) for _, v, _ in good]).reshape(len(good), 4, width)
    order = sorted(range(len(good)), key=lambda r: (good[r][0] is None, good[r][0] or 0, good[r][1]))
    books = x[order[:entries]].transpose(1, 0, 2)
    for step in range(5):
        d = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
        own = d.argmin(axis=2)
        if step < 4:
            books = np.array([[(x[own[:, p] == e, p].sum(axis=0) // (own[:, p] == e).sum()) if (own[:, p] == e).any() else books[p, e] for e in range(books.shape[1])] for p in range(4)])
    error = d.min(axis=2).sum(axis=1)
    return sorted(((-1 if i is None else i), bytes(c.tolist()).hex(), int(e), int(error[[q for q, g in enumerate(good) if g[2] == lab]].sum())) for (i, _, lab), c, e in zip(good, own, error, strict=True))


def test_op13_odd_rows(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 500), [rng.uniform(-1, 1) for _ in range(rng.choice([10, 10, 6]))], rng.choice([0, 0, 1, None])) for _ in range(400)]
    rows += [(3, [0.5] * 10, 1)] * 120 + [(None, [0.1] * 10, 2), (7, None, 1), (8, [None], 1), (9, [float("inf")], 1), (10, [], None)]
    df = spark.createDataFrame([(*r, "s", 1, "v", 1) for r in rows], TABLE)
    got = codes.compress(df).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error) for r in got) == plain_codes(rows)
    assert len({r.codebooks_sha256 for r in got}) == 1 and codes.compress(df.limit(0)).count() == 0
    few = [r for r in rows[:5]]
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in codes.compress(spark.createDataFrame([(*r, "s", 1, "v", 1) for r in few], TABLE)).collect()) == plain_codes(few)
