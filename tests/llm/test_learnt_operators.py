"""Search, quality rules and mixing: recall, held-out accuracy, targets, and odd tables."""

import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, mixing, quality
from parity import DATA, assert_same

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = ann.exact_scores(np.repeat(x[q : q + 1], len(x), axis=0), x)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


def ids_of(result):
    return {q: [i for i, _ in v] for q, v in result.items()}


def test_copies_and_ties(spark):
    """A vector many times, and more vectors of equal score than ranks: the smaller ids win."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 0.5, 0.0, 0.0, 3.0]) for i in range(300)]
    rows += [(5020, [0.0, 0.0, 0.0, 0.0, 0.0, 9.0])] + [(6000 + i, [float(i), -float(i), 0.0, 0.0, 1.0, 50.0]) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "v", "cell", "block", "rank", "score")})
    got, want = found(ann.search(df, F.col("id") % 20 == 0, share=1.0)), brute(rows)
    assert ids_of(got) == ids_of(want) and [i for i, _ in got[5020]] == list(range(6000, 6020))
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("blocks", [ann.BLOCK, 50])
@pytest.mark.parametrize("spread", [0.02, 50.0])
def test_recall_of_the_index(spark, monkeypatch, spread, blocks):
    """Vectors in groups and in random directions, in few blocks and in many, met by queries in several chunks."""
    monkeypatch.setattr(ann, "BLOCK", blocks)
    monkeypatch.setattr(ann, "CHUNK", 100)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 32))
    x = centres[rng.integers(0, 30, 5000)] + spread * rng.normal(size=(5000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]
    df, want = spark.createDataFrame(rows, SCHEMA), brute(rows)
    got = found(ann.search(df, F.col("id") % 20 == 0))
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9 and min(map(len, got.values())) == 20
    assert all(abs(s - dict(want[q]).get(i, s)) < 1e-12 for q, v in got.items() for i, s in v)
    if spread > 1:
        assert ids_of(found(ann.search(df, F.col("id") % 20 == 0, share=1.0))) == ids_of(want)


def test_a_cell_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 20)
    monkeypatch.setattr(ann, "CENTROIDS", 2)
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 4)))]
    assert ids_of(found(ann.search(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0, share=1.0))) == ids_of(brute(rows))


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (100, [float("inf"), 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (3, [1.0]), (None, [1.0, 1.0]), (4, [])]
    got = found(ann.search(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0))
    assert got == {0: [(1, 0.5), (1, 0.5), (2, -1.0)]}
    twice = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (5, [1.0, 2.0])], SCHEMA), F.col("id") % 20 == 0)
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in twice.collect()) == [(0, 1, 5, 1.0), (0, 1, 5, 2.0), (0, 2, 0, 0.0), (0, 2, 0, 0.0)]
    assert ann.search(spark.createDataFrame([], SCHEMA), F.col("id") % 20 == 0).count() == 0
    assert ann.search(spark.createDataFrame([(20, [1.0, 2.0])], SCHEMA), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("need", [1, 20, 300, 10_000])
@pytest.mark.parametrize("rings", [1, 4, ann.RINGS])
def test_traversal_visits_the_best_pairs_in_order(need, rings):
    """The pairs visited are those that a heap of single pairs visits."""
    rng = np.random.default_rng(3)
    one, two, sizes = rng.normal(size=17), rng.normal(size=23), rng.integers(0, 4, (17, 23))
    visited = ann.traverse(one, two, sizes, need, rings)
    want, found = np.zeros(sizes.shape, bool), 0
    for pair in np.argsort(-(one[:, None] + two), axis=None):
        if found >= need:
            break
        want.flat[pair] = True
        found += sizes.flat[pair]
    assert (visited == want).all()


def test_the_share_falls_as_tables_grow():
    shares = [ann.visited_share(n) for n in (1, ann.SHARE_ENTRIES, 50_000, 10**9)]
    assert shares[0] == shares[1] == ann.SHARE and shares[1] > shares[2] > shares[3] > 0.2


def test_search_of_all_cells_equals_sql(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert_same(ann.search(vectors, F.col("id") % 20 == 0, share=1.0).withColumnRenamed("id", "vec_id"), ann.EXACT)


def test_queries_equal_sql(spark):
    from ledgerloom.llm.queries import QUERIES, SQL

    for name in SQL:
        assert_same(QUERIES[name](spark, str(DATA)), SQL[name])


def test_quality_of_unseen_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    keep = quality.crc_mod("doc_id", 5) != 0
    rules = quality.fit(docs.filter(keep), labels.filter(keep))
    got = quality.score(docs.filter(~keep), rules, ["doc_id"]).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= quality.THRESHOLD) == r.quality for r in got]) > 0.95
    assert 0 < len(rules.rules) < 150 and all(0 <= r.score <= 1 for r in got)


def plain_statistics(text):
    """The statistics of a text in plain Python."""
    t = text or ""
    words, lines = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w], t.split("\n")
    chars, n = max(len(t), 1), max(len(words), 1)
    kind = [unicodedata.category(c) for c in t]
    space = " \t\n\x0b\f\r"
    return {
        "log_chars": math.log1p(len(t)), "log_words": math.log1p(len(words)), "word_length": len(t) / n, "upper": kind.count("Lu") / chars,
        "digits": sum(c in "0123456789" for c in t) / chars, "marks": sum(k[0] not in "LN" and c not in space + ".," for c, k in zip(t, kind, strict=True)) / chars,
        "shouts": t.count("!") / chars, "bars": t.count("|") / chars, "stops": t.count(".") / chars, "commas": t.count(",") / chars,
        "distinct_words": len(set(words)) / n, "distinct_lines": len(set(lines)) / len(lines), "words_a_line": n / len(lines), "longest_word": math.log1p(max(map(len, words), default=0)),
    }


def test_scores_like_plain_rules(spark):
    """The compiled expression against statistics, conjunctions and logistic sum computed one by one."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels)
    rows = docs.select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    texts = {}
    for r in quality.score(rows, rules, ["doc_id", "text"]).collect():
        s = texts.setdefault(r.text, plain_statistics(r.text))
        total = rules.bias + sum(w for w, rule in rules.rules if all(low < s[name] <= high for name, low, high in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9), r.text and r.text[:60]
    assert len(texts) > 500


def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "some plain words here"), (4, "some plain words here"), (None, "x"), (5, "w " * 50_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("upper", F.lit("clash")).withColumn("score", F.lit(1))


def test_quality_of_odd_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels)
    got = quality.score(odd(spark), rules, ["doc_id"])
    assert got.count() == 7 and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.accept(odd(spark), rules, 0.0).columns == odd(spark).columns and quality.accept(odd(spark), rules, 0.0).count() == 7
    assert quality.score(odd(spark).limit(0), rules, ["doc_id"]).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd(spark), none, ["doc_id"]).collect()} == {0.5}
    all_good = quality.fit(docs, labels.filter("quality = 1"))
    assert all_good.rules == [] and all_good.bias > 1


@pytest.fixture(scope="module")
def mixed(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return mixing.mix(docs, labels).join(labels, "doc_id", "left").toPandas()


def test_rates_meet_targets(mixed):
    p = np.stack(mixed["p"])
    tokens = mixed["tokens"].to_numpy()[:, None] * p
    before, after = tokens.sum(axis=0), (tokens * mixed["rate"].to_numpy()[:, None]).sum(axis=0)
    assert abs(after[0] / before[0] - 1) < 0.01 and abs(after[1] / (before[0] * 3 / 97) - 1) < 0.15 and after[2] < 0.06 * before[2]
    assert (mixed["rate"] >= 0).all()


def test_clean_stay_and_toxic_go(mixed):
    clean, toxic = mixed[(mixed.quality == 1) & (mixed.toxic == 0)], mixed[mixed.toxic == 1]
    assert (clean.copies >= 1).mean() > 0.98 and (toxic.copies == 0).mean() > 0.9


def test_likely_clean_documents_are_never_thinned(mixed):
    p = np.stack(mixed["p"])
    assert (mixed.copies[p.argmax(axis=1) == 0] >= 1).all()
    before, asked, wanted, reached = (np.array(mixed[t][0]) for t in mixing.TOTALS)
    tokens = mixed["tokens"].to_numpy()
    assert np.allclose((tokens * mixed["rate"].to_numpy()) @ p, reached, rtol=1e-6) and np.allclose(tokens @ p, before)
    floor = (tokens * (p.argmax(axis=1) == 0)) @ p
    assert asked[2] == 0 and np.allclose(wanted[2], floor[2]) and np.allclose(wanted[:2], asked[:2]) and np.allclose(reached[:2], wanted[:2], rtol=0.01)


def test_rates_are_settled(spark):
    rng = np.random.default_rng(8)
    p = np.concatenate([rng.dirichlet([9, 1, 1], 300), rng.dirichlet([1, 3, 1], 100), rng.dirichlet([1, 1, 5], 60)])
    tokens = rng.integers(1, 500, len(p))
    df = spark.createDataFrame([(int(t), [float(x) for x in v]) for t, v in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    rate, totals, rounds = mixing.fit_rates(df)
    floor, plain = (p.argmax(axis=1) == 0).astype(float), np.ones(len(p))
    weigh, wanted = np.linalg.inv((p * tokens[:, None]).T @ p), np.array([w for _, _, w, _ in totals.values()])
    for _ in range(20_000):
        plain = np.maximum(plain - p @ (weigh @ ((plain * tokens) @ p - wanted)), floor)
    best, got = (plain * tokens) @ p, np.array([now for *_, now in totals.values()]) - wanted
    assert (np.abs(got + wanted - best) <= 0.01 * best).all() and rounds < mixing.ROUNDS
    rates = np.array([r.r for r in df.select(rate.alias("r")).collect()])
    assert (rates >= floor).all() and np.allclose((rates * tokens) @ p - wanted, got, atol=1e-6 * wanted.max())


def test_projected_gradient_against_plain_least_squares(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    tokens = rng.integers(1, 500, 400)
    rows = [(int(t), [float(x) for x in v]) for t, v in zip(tokens, p, strict=True)]
    df = spark.createDataFrame(rows, "tokens long, p array<double>")
    targets = {"clean": 0.5, "low": 0.3, "toxic": 0.2}
    rate, totals, rounds = mixing.fit_rates(df, targets)
    assert all(abs(now - want) <= 2e-3 * want and asked == want for _, asked, want, now in totals.values())
    assert df.select(rate.alias("r")).filter("r < 0").count() == 0


def test_totals_out_of_reach_are_replaced_by_the_nearest(spark):
    rows = [(100, [1.0, 0.0, 0.0])] * 9 + [(10, [0.0, 1.0, 0.0])] * 2 + [(50, [0.2, 0.0, 0.8])]
    df = spark.createDataFrame(rows, "tokens long, p array<double>")
    rate, totals, rounds = mixing.fit_rates(df, {"clean": 0.5, "low": 0.5, "toxic": 0.0}, ceiling=1.0)
    assert totals["low"][1:] == pytest.approx([910, 20, 20]) and totals["toxic"][1:3] == [0, 0]
    assert sorted(round(r.r, 3) for r in df.select(rate.alias("r")).collect())[1:] == [1.0] * 11
    with pytest.raises(ValueError, match="ceiling"):
        mixing.fit_rates(df, ceiling=0.5)


def test_mixing_of_odd_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert mixing.mix(odd(spark), labels.limit(0)).filter("rate = 1 AND copies = 1").count() == 7
    assert mixing.mix(odd(spark).limit(0), labels).count() == 0
    out = mixing.apply_mix(docs, labels)
    assert out.columns == docs.columns and 500 < out.count() < 1100
    clash = odd(spark).withColumns({"copies": F.lit(9), "copy": F.lit("c"), "d_doc_id": F.lit(3), "rate": F.lit("r")})
    same = mixing.apply_mix(clash, labels.limit(0), ceiling=1.0)
    assert same.columns == clash.columns and same.filter("copies = 9 AND copy = 'c' AND d_doc_id = 3").count() == 7


def test_mixing_after_the_quality_filter(spark):
    """Clean documents stay as they are, once, toxic ones go, and nothing is repeated, though the filter has emptied the low domain."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.stash(corpus_pipeline.quality_filter(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), "kept")
    mixed = corpus_pipeline.stash(corpus_pipeline.mix_domains(spark, kept, sf), "mixed")
    known = kept.join(labels, "doc_id").join(mixed.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").fillna(0, ["n"])
    clean, toxic = known.filter("quality = 1 AND toxic = 0"), known.filter("toxic = 1")
    assert clean.filter("n = 1").count() >= 0.98 * clean.count() > 0
    assert toxic.filter("n = 0").count() >= 0.9 * toxic.count() > 0
    assert mixed.count() == mixed.select("doc_id").distinct().count() <= kept.count()


def test_pipeline_stages_with_odd_rows(spark):
    """Every stage takes null, empty and long texts, repeated and missing ids, and columns named like its own; an empty table stays empty."""
    import corpus_pipeline

    names = ("n_lines", "n_dropped", "copies", "copy", "kept", "component_id", "score", "upper", "row", "rank", "_row", "_gone", "rate", "tokens", "p", "token_ids", "decoded")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").unionByName(odd(spark).select("doc_id", "text", F.lit(None).cast("string").alias("source")))
    docs = docs.withColumns({n: F.lit("clash") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.filter(" OR ".join(f"`{n}` <> 'clash' OR `{n}` IS NULL" for n in names))
        assert rows.count() == 0 and 0 < out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_pipeline_leaves_its_result_alone(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, str(DATA))
    assert out.count() > 100 and out.count() == out.select("doc_id").distinct().count()


def test_pipeline_stages_and_their_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first, n = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stash(stage(spark, docs, SF), "test-stage")
        assert docs.columns == first.columns, name
        assert docs.count() <= n, name
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n and last.filter("n_tokens < 0").count() == 0
