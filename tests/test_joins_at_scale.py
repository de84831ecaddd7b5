"""Joins, keywords and running sums of any size against plain versions."""

import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import intervals, items, keywords, loose, prefix, sketches, skew
from ledgerloom.plans import render


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_loose_names_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    creditors = [(i, f"K{i}", rng.choice([word(rng.randint(1, 12)), word(4) + " GmbH", "--", None])) for i in range(150)]
    vendors = [(i, rng.choice([word(rng.randint(4, 14)), "x" + word(9), "GmbH " + word(5), "", None])) for i in range(300)] + [(400, "aaaaaaaa")] * 2
    clean = lambda s: "".join(c for c in (s or "").lower() if c.isascii() and c.isalnum())
    want = {}
    for key, v in vendors:
        own = clean(v)
        hits = [(r, i) for r, i, n in creditors if clean(n) and len(own) >= 6 and (own in clean(n) or clean(n) in own)]
        if hits:
            want[key] = min(hits)[1]
    got = loose.match_loosely(spark.createDataFrame(vendors, "key int, vendor_name string"), spark.createDataFrame(creditors, "rank int, creditor_id string, name string"))
    rows = got.collect()
    assert {r.key: r.creditor_id for r in rows} == want and len([r for r in rows if r.key == 400]) == 2 * (400 in want)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    none = spark.createDataFrame([], "key int, vendor_name string")
    assert loose.match_loosely(none, spark.createDataFrame(creditors, "rank int, creditor_id string, name string")).count() == 0


def test_more_than_a_hundred_creditors(spark):
    creditors = spark.range(250).select(F.col("id").cast("int").alias("rank"), F.concat(F.lit("K"), "id").alias("creditor_id"), F.concat(F.lit("Werk "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"))
    vendors = spark.createDataFrame([(1, "Werk 000249 AG")], "key int, vendor_name string")
    assert loose.match_loosely(vendors, creditors).first().creditor_id == "K249"


def test_a_hot_key_is_cut_on_both_sides(spark):
    left = spark.range(3000).select(F.lit("k").alias("key"), F.col("id").alias("a")).unionByName(spark.createDataFrame([("l", 1), (None, 2)], "key string, a long"))
    right = spark.range(50).select(F.lit("k").alias("key"), F.col("id").alias("b")).unionByName(spark.createDataFrame([("l", 7), ("m", 8), (None, 9)], "key string, b long"))
    got = skew.meet(left, right, "key", F.col("a") % 50 == F.col("b"), "a", "b", left_rows=100, right_rows=5)
    assert {(r.a, r.b) for r in got.collect()} == {(a, a % 50) for a in range(3000)} and got.count() == 3000  # l's pair fails the condition, nulls meet nothing


def test_tasks_of_a_join_grow_with_its_pairs(spark, monkeypatch):
    """Few bytes may make many pairs, so tasks are counted by pairs."""
    monkeypatch.setattr(skew, "PAIRS", 1_000)
    left = spark.range(2000).select((F.col("id") % 20).alias("key"), F.col("id").alias("a"))
    right = spark.range(200).select((F.col("id") % 20).alias("key"), F.col("id").alias("b"))
    got = skew.meet(left, right, "key", F.lit(True), "a", "b")
    assert "REPARTITION_BY_NUM" in plan(got) and got.count() == 20 * 100 * 10
    assert "hashpartitioning(key" in plan(got) and ", 20), REPARTITION_BY_NUM" in plan(got)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abä ", min_size=0, max_size=5), max_size=12), st.lists(st.one_of(st.none(), st.text("abcä 𝄞", max_size=40)), max_size=8), st.integers(1, 12))
def test_keywords_against_contains(words, texts, states):
    ranked = list(enumerate(words))
    want = [min((r for r, w in ranked if t is not None and w in t), default=keywords.NONE) for t in texts]
    assert keywords.first_ranks(keywords.automata(ranked, states), texts).tolist() == want


def test_keywords_over_chunks_and_ties(spark):
    rules = spark.createDataFrame([(2, "B", "nadel"), (1, "A", "heuhaufen"), (2, "A", "naadel"), (None, "X", "x")], "rank int, account string, keyword string")
    texts = ["x" * 250 + "NADEL" + "y" * 600, "z" * 251 + "heuhaufen nadel", "nade l", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("_rank_of", F.lit(1))
    got = {r.id: (r.account, r.keyword) for r in keywords.match_keywords(df, rules).collect()}
    assert got == {0: ("A", "naadel"), 1: ("A", "heuhaufen"), 2: (None, None), 3: (None, None), 4: (None, None)} and keywords.match_keywords(df, rules.limit(0)).count() == 5


def test_keywords_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(keywords, "MOST", 5)
    with pytest.raises(ValueError, match="characters"):
        keywords.keyword_ranks(spark.createDataFrame([(1, "abcdef")], "rank int, keyword string"), F.col("text"))


def test_intervals_against_all_pairs(spark):
    rng = random.Random(5)
    points = [(i, rng.choice([rng.randint(-500, 500), None])) for i in range(300)]
    spans = [(i, s, s + rng.choice([-1, 0, 1, 7, 8, 60, 900])) for i in range(120) for s in [rng.randint(-600, 600)]] + [(900, None, 5)]
    df = intervals.hold(spark.createDataFrame(points, "p int, at long"), spark.createDataFrame(spans, "q int, s long, e long"), "at", "s", "e", point_rows=20, interval_rows=5)
    got = [(r.p, r.q) for r in df.collect()]
    want = {(p, q) for p, t in points for q, s, e in spans if None not in (t, s) and s <= t <= e}
    assert set(got) == want and len(got) == len(want) and "NestedLoop" not in plan(df)
    assert intervals.hold(spark.createDataFrame(points, "p int, at long"), spark.createDataFrame([], "q int, s long, e long"), "at", "s", "e").count() == 0


def test_most_pairs_that_are_compared_are_results(spark, monkeypatch):
    """Where points are dense, bins are narrower than intervals; where they are few, an interval is sent to two bins at most."""
    seen = []
    monkeypatch.setattr(intervals, "meet", lambda left, right, key, *rest: seen.append((left, right)) or left.join(right, key).filter(rest[0]))
    spans = spark.range(200).select(F.col("id").alias("q"), (F.col("id") * 37).alias("s"), (F.col("id") * 37 + 1500 + F.col("id") % 900).alias("e"))
    pairs = intervals.hold(spark.range(20_000).select(F.col("id").alias("p"), F.col("id").alias("at")), spans, "at", "s", "e").count()
    left, right = seen[0]
    assert pairs == sum(1501 + i % 900 for i in range(200)) and left.join(right, "_cell").count() < 1.6 * pairs
    few = spark.range(500).select(F.col("id").alias("p"), (F.col("id") * 1000).alias("at"))
    assert intervals.hold(few, spans, "at", "s", "e").count() == sum(1 for i in range(200) for p in range(500) if 37 * i <= 1000 * p <= 37 * i + 1500 + i % 900) and seen[1][1].count() <= 400


def test_running_sums_of_one_large_group(spark):
    rng = random.Random(7)
    rows = [(g, i, rng.choice([None, Decimal(rng.randint(-500, 500))])) for i in range(700) for g in [rng.choice(["a", "a", "a", None])]]
    df = spark.createDataFrame(rows, "g string, i int, v decimal(10,0)")
    got = {(r.g, r.i): r.running for r in prefix.running_sum(df, ["g"], ["i"], "v", rows=60).collect()}
    sums = {"a": 0, None: 0}
    for g, i, v in rows:
        sums[g] += v or 0
        assert got[g, i] == sums[g]
    ranged = prefix._ranged(df, [F.col("g"), F.col("i")], 60)
    assert ranged.groupBy("_part").count().agg(F.max("count")).first()[0] < 200  # no range has a whole group
    assert prefix.running_sum(df.limit(0), ["g"], ["i"], "v").count() == 0
    assert [r.number for r in prefix.numbered(df, ["i", "g"], rows=50).orderBy("i", "g").collect()] == list(range(1, 701))


def test_sketches_by_day_merge_to_those_of_all(spark):
    df = spark.range(20000).select(F.timestamp_seconds(F.col("id") * 700).alias("ts"), (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 4000).alias("u"), F.when(F.col("id") % 5 != 0, F.col("id") % 1000).alias("v"))
    days = sketches.daily(df, "ts", ["g"], "u", "v")
    for r in sketches.estimates(sketches.merged(days, ["g"]), ["g"], (0.5, 0.9)).collect():
        exact = df.filter(f"g = {r.g}")
        assert r.n == exact.count() and abs(r.distinct - exact.select("u").distinct().count()) <= 4000 * sketches.COUNT_WITHIN
        assert abs(r.q50 - 500) <= 1000 * sketches.RANK_WITHIN + 5 and abs(r.q90 - 900) <= 1000 * sketches.RANK_WITHIN + 5


def test_items_of_odd_tables(spark):
    head = "Bezeichnung Menge Betrag"
    texts = [
        f"Kopf 1 2,00 EUR\n{head}\nSchraube\n  M8 lang 3 1.234,50 EUR\nMutter 10 2,5 €\nNetto 99,00 EUR\nTrinkgeld 1 5,00 EUR", f"{head}\nA 1 1,00 EUR", f"{head}\nohne Betrag\nNetto 1,00 EUR",
        f"Pos. {head}\r\nB 2 3,4,5 EUR\r\nZwischensumme 1,00", "keine Tabelle", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [(r.id, r.n, r.text, r.quantity, r.amount) for r in items.invoice_lines(df).orderBy("id", "n").collect()]
    assert got[:3] == [(0, 1, "Schraube M8 lang", 3, Decimal("1234.50")), (0, 2, "Mutter", 10, Decimal("2.50")), (1, 1, "A", 1, Decimal("1.00"))]
    assert [g[:2] for g in got[3:]] == [(3, 1)] and got[3][4] is None and df.select(F.size(items.items(F.col("text"))).alias("n")).filter("n IS NULL").count() == 0


def test_items_are_found_in_one_pass(spark):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    plan = items.invoice_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bezeichnung") == 1 and plan.count("regexp_extract") == 1 and plan.count("regexp_extract_all") == 0 and plan.count("(.+?)") == 1


def test_items_beside_characters_of_two_units_and_within_texts(spark):
    """Places are counted in characters; an item's text may hold what the reader itself writes: dollars, backslashes, blanks."""
    texts = [
        "😀" * 40 + "\nBezeichnung Menge Betrag\nA 1 1,00 EUR\nB 2 2,00 EUR\nNetto 3,00 EUR", "Artikel Menge Preis Betrag\n" + "😀" * 20 + " 1 1,00 EUR\nNetto 5 9,00 EUR",
        "Artikel Menge Betrag\r$1 \\ 2 x  y 3 7,50 €\rRest", "Artikel Menge Betrag\n\n  \n1 2 3 EUR\nC 99999999999999999999 1.5 EUR",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [tuple(r) for r in items.invoice_lines(df).orderBy("id", "n").collect()]
    assert got == [
        (0, 1, "A", 1, Decimal("1.00")), (0, 2, "B", 2, Decimal("2.00")), (1, 1, "😀" * 20, 1, Decimal("1.00")), (2, 1, "$1 \\ 2 x y", 3, Decimal("7.50")),
        (3, 1, "1", 2, Decimal("3.00")), (3, 2, "C", None, Decimal("1.50")),
    ]
    arrays = df.select("id", F.inline(items.items(F.col("text")))).orderBy("id", "n")
    assert [tuple(r) for r in arrays.collect()] == got


def test_facts_shuffle_numbers_alone(spark):
    lines = spark.createDataFrame([(1, 2, 15, 3.0, 10.0, 0.1), (1, 1, 7, 1.0, 5.0, 0.0), (1, 3, 8, 1.0, None, 0.0), (2, 1, 7, 1.0, None, 0.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double")
    orders = spark.sql("SELECT o_orderkey, 5L AS o_custkey, DATE '2026-01-31' AS o_orderdate FROM VALUES (1L), (2L), (3L) AS t(o_orderkey)")
    facts = render.facts(orders, lines)
    got = {r.k: r for r in facts.collect()}
    assert sorted(got) == [1, 2] and got[1].net == Decimal("14.00") and got[2].net is None
    assert [(x["n"], x["text"], x["quantity"], x["amount"], x["long"]) for x in got[1]["items"]] == [
        (1, "Artikel A7 Standard", 1, Decimal("5.00"), False), (2, "Artikel A15 in der verstärkten Ausführung Standard", 3, Decimal("9.00"), True), (3, "Artikel A8 Standard", 1, None, False),
    ]
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "Artikel" in plan and "Artikel" not in plan[plan.index("Aggregate") :]
