"""Soft-membership mixing of a corpus to target weights.

A classifier learnt from a labelled table gives each document's posterior over
domains. Each document gets a nonnegative rate, the number of times it is to be
seen, so that the domains' expected token totals meet their targets: sum over
documents of rate x tokens x posterior. Least squares: the squared misses, weighted
by the inverse of the domains' token products, are minimal, and among such rates those
nearest to one are taken, with token counts as the metric, so that documents of equal
posterior change alike, however long. Documents that are most likely of the first
domain keep a rate of one at least, and none exceeds ``ceiling`` where one is given.

Gradients are projected: a document's rate is one less its posteriors times a multiplier
for each domain, cut to its bounds. The multipliers sum up gradients, which are the misses that
the rates leave, each scaled by the inverse token products of the documents that
bounds don't hold. A round tries ``LENGTHS`` of the step in one aggregate over documents, a few numbers
for each, and takes the best; rates are never gathered. The fit ends when the gradient is within
``SETTLED`` of nothing, when no length is better, or after ``ROUNDS`` rounds; which it was is told by
the number of rounds beside the rates. A target that bounds put out of reach is replaced by the nearest total
within reach before the fit; totals before, asked for, wanted within reach and reached
stand there too.

Domains come from labels: ``toxic`` where toxic is 1, else ``low`` where quality is
0, else ``clean``. The classifier is fitted on a bounded sample (``TRAIN_ROWS``
labelled documents, those whose doc_id has the smallest hash): the words that tell
the domains best apart, a few statistics of the text, and multinomial logistic
regression. Without labels every document is ``clean``. Null and empty texts have no
tokens and keep their rate of one. Rows that repeat are documents of their own;
equal rows get equal rates.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stash
from .quality import TRAIN_ROWS, labelled

DOMAINS = ("clean", "low", "toxic")
#: Share of the tokens that each domain is to have, in a budget that the first domain fills by its share as it is.
TARGETS = {"clean": 0.97, "low": 0.03, "toxic": 0.0}
VOCABULARY = 1_500
#: The gradient, as a part of each domain's wanted total, at which rates are final, and rounds at most.
SETTLED = 1e-4
ROUNDS = 60
LENGTHS = tuple(2.0**-i for i in range(-1, 9))
#: How much more a miss weighs than a rate's distance from one.
WEIGHT = 1e7
_STATISTICS = ("upper", "marks", "bars", "distinct")


def words(text: str = "text") -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")


def _inputs(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the distinct words, their number before that and a few statistics."""
    t = F.coalesce(F.col("text"), F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    made = docs.withColumn("_all", words())
    return made.select(
        *keep, F.array_distinct("_all").alias("_words"), F.size("_all").cast("long").alias("_tokens"),
        (F.regexp_count(t, F.lit(r"\p{Lu}")) / chars).alias("upper"),
        ((F.length(t) - F.length(F.translate(t, "!$%&*#@", ""))) / chars).alias("marks"),
        ((F.length(t) - F.length(F.replace(t, F.lit("|")))) / chars).alias("bars"),
        (F.size(F.array_distinct("_all")) / F.greatest(F.size("_all"), F.lit(1))).alias("distinct"),
    )


class Domains:
    """A fitted classifier: vocabulary and logistic regression over the domains."""

    def __init__(self, vocabulary: list[str], model: LogisticRegressionModel | None):
        self.vocabulary, self.model = vocabulary, model

    def _vectors(self, rows: DataFrame) -> DataFrame:
        found = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="_words", outputCol="_found", minTF=1.0)
        found.setBinary(True)
        return VectorAssembler(inputCols=["_found", *_STATISTICS], outputCol="_x").transform(found.transform(rows))

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, vocabulary: int = VOCABULARY) -> Domains:
        """Learns from docs (doc_id, text) and labels (doc_id, quality, toxic)."""
        domain = F.when(F.col("toxic") == 1, 2.0).when(F.col("quality") == 0, 1.0).when(F.col("quality") == 1, 0.0)
        train = stash(_inputs(labelled(docs, labels, domain, rows), ["y"]).coalesce(16), "domain-train")
        seen = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(seen) < 2:
            discard(train)
            return cls([], None)
        total = sum(seen.values())
        by = train.select("y", F.explode("_words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), *[F.count_if(F.col("y") == y).alias(f"n{int(y)}") for y in sorted(seen)])
        gain = [F.abs(F.col(f"n{int(y)}") - F.col("n") * (n / total)) / F.sqrt(F.col("n") * (n / total)) for y, n in seen.items()]
        best = by.filter("n >= 3").withColumn("gain", F.greatest(*gain)).orderBy(F.desc("gain"), "w").limit(vocabulary)
        own = cls([r["w"] for r in best.select("w").collect()] or [""], None)
        vectors = stash(own._vectors(train).select("y", "_x"), "domain-vectors")
        own.model = LogisticRegression(featuresCol="_x", labelCol="y", family="multinomial", regParam=0.0005, maxIter=60, probabilityCol="_p", predictionCol="_d", rawPredictionCol="_r").fit(vectors)
        discard(train, vectors)
        return own

    def posteriors(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """``keep``, tokens (words of letters) and p: the posterior of each domain, in the order of DOMAINS."""
        rows = _inputs(docs, keep)
        if self.model is None:
            return rows.select(*keep, F.col("_tokens").alias("tokens"), F.array(*[F.lit(float(d == DOMAINS[0])) for d in DOMAINS]).alias("p"))
        p = vector_to_array("_p")
        if self.model.numClasses < len(DOMAINS):
            p = F.concat(p, F.array_repeat(F.lit(0.0), len(DOMAINS) - self.model.numClasses))
        return self.model.transform(self._vectors(rows)).select(*keep, F.col("_tokens").alias("tokens"), p.alias("p"))


def _floor() -> Column:
    """The least rate: one where the first domain is the most likely."""
    return F.when(F.element_at("p", 1) >= F.array_max("p"), 1.0).otherwise(0.0)


def _capped(rate: Column, ceiling: float | None) -> Column:
    return rate if ceiling is None else F.least(F.lit(float(ceiling)), rate)


def _projected(multipliers: list[Column], ceiling: float | None) -> tuple[Column, Column]:
    """A document's rate for these multipliers, and whether no bound holds it."""
    free = 1 - sum((F.element_at("p", k + 1) * m for k, m in enumerate(multipliers)), F.lit(0.0))
    rate = F.greatest(_floor(), _capped(free, ceiling))
    return rate, rate == free


def _tried(members: DataFrame, trials: np.ndarray, ceiling: float | None) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each trial of multipliers: the dual value but for the totals' part, the domains' totals, and the token products of documents within bounds."""
    n = len(DOMAINS)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(x)).alias(f"m{k}") for k, x in enumerate(t)]) for i, t in enumerate(trials)])).alias("trial")
    rate, free = _projected([F.col(f"trial.m{k}") for k in range(n)], ceiling)
    share = [F.element_at("p", k + 1) * F.col("tokens") for k in range(n)]
    rows = members.filter("tokens > 0").select("p", "tokens", each).withColumn("rate", rate).withColumn("free", free.cast("double"))
    value = F.col("tokens") * ((F.col("rate") - 1) * (F.col("rate") - 1) / 2 + F.col("rate") * sum((F.element_at("p", k + 1) * F.col(f"trial.m{k}") for k in range(n)), F.lit(0.0)))
    products = {(i, j): F.sum(share[i] * F.element_at("p", j + 1) * F.col("free")).alias(f"a{i}{j}") for i in range(n) for j in range(i, n)}
    found = {r["i"]: r for r in rows.groupBy("trial.i").agg(F.sum(value).alias("value"), *[F.sum(F.col("rate") * s).alias(f"s{k}") for k, s in enumerate(share)], *products.values()).collect()}  # a row a trial
    gram = lambda r: np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in range(n)] for i in range(n)])
    return [(found[i]["value"], np.array([found[i][f"s{k}"] for k in range(n)]), gram(found[i])) if i in found else (0.0, np.zeros(n), np.zeros((n, n))) for i in range(len(trials))]


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, ceiling: float | None = None) -> tuple[Column, dict[str, list[float]], int]:
    """The expression for rates over rows (tokens, p); by domain the totals before, asked for, wanted within reach, and reached; and the number of rounds."""
    if ceiling is not None and ceiling < 1:
        raise ValueError("a ceiling under one would thin documents that are to stay whole")
    n = len(DOMAINS)
    weights = np.array([targets.get(d, 0.0) for d in DOMAINS], float)
    weights /= weights.sum()
    share = [F.element_at("p", k + 1) * F.col("tokens") for k in range(n)]
    first = members.agg(*[F.sum(_floor() * s).alias(f"f{k}") for k, s in enumerate(share)], *[F.sum(s).alias(f"s{k}") for k, s in enumerate(share)], *[F.sum(share[i] * F.element_at("p", j + 1)).alias(f"a{i}{j}") for i in range(n) for j in range(i, n)]).first()
    start = np.array([first[f"s{k}"] or 0.0 for k in range(n)])
    gram = np.array([[first[f"a{min(i, j)}{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    asked = weights * (start[0] / weights[0] if weights[0] else start.sum())
    least = np.array([first[f"f{k}"] or 0.0 for k in range(n)])
    most = np.where(start > 0, np.inf if ceiling is None else ceiling * start, 0.0)
    wanted = np.clip(asked, least, most)
    slack = gram / WEIGHT

    def worth(value: float, m: np.ndarray) -> float:
        return value - wanted @ m - m @ slack @ m / 2

    multipliers, rounds = np.zeros(n), 0
    value, now, free = _tried(members, multipliers[None], ceiling)[0]
    while rounds < ROUNDS:
        gradient = now - wanted - slack @ multipliers
        if (np.abs(gradient) <= SETTLED * np.maximum(wanted, 1.0)).all():
            break
        rounds += 1
        step = np.linalg.pinv(free + slack, rcond=1e-13, hermitian=True) @ gradient
        trials = multipliers + np.array(LENGTHS)[:, None] * step
        tried = _tried(members, trials, ceiling)
        best = max(range(len(trials)), key=lambda i: worth(tried[i][0], trials[i]))
        if worth(tried[best][0], trials[best]) <= worth(value, multipliers) + 1e-12 * abs(worth(value, multipliers)):
            break
        multipliers, (value, now, free) = trials[best], tried[best]
    rate = _projected([F.lit(float(m)) for m in multipliers], ceiling)[0]
    return rate, {d: [float(x[k]) for x in (start, asked, wanted, now)] for k, d in enumerate(DOMAINS)}, rounds


def copies(rate: Column) -> Column:
    """A whole number of copies whose mean is the rate, decided by the hash of doc_id."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    return F.floor(rate + draw).cast("int")


TOTALS = ("before", "asked", "wanted", "reached")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, ceiling: float | None = None) -> DataFrame:
    """doc_id, tokens, p, rate and copies of each row of docs, and the domains' totals (``TOTALS``) and the fit's rounds, the same in all rows."""
    model = Domains.fit(docs, labels)
    members = stash(model.posteriors(docs.select("doc_id", "text"), ["doc_id"]), "members")
    rate, totals, rounds = fit_rates(members, targets, ceiling)
    told = {name: F.array(*[F.lit(totals[d][i]) for d in DOMAINS]) for i, name in enumerate(TOTALS)}
    return members.withColumn("rate", rate).withColumn("copies", copies(F.col("rate"))).withColumns(told).withColumn("rounds", F.lit(rounds))


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, ceiling: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say; with a ``ceiling`` of one no row repeats.

    Rows that share a doc_id have the copies of the one with the most. A row without a doc_id can't be told from others and stays once.
    """
    own = docs.select(*[F.col(f"`{c}`").alias(f"d_{c}") for c in docs.columns])
    plan = mix(docs, labels, targets, ceiling).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    joined = own.join(plan, F.col("d_doc_id") == F.col("doc_id"), "left").withColumn("copies", F.coalesce("copies", F.lit(1))).filter("copies > 0")
    return joined.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select(*[F.col(f"`d_{c}`").alias(c) for c in docs.columns])


def op10_mixing(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    p = [F.element_at("p", k + 1) for k in range(len(DOMAINS))]
    top = F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.array_position("p", F.array_max("p")).cast("int"))
    return out.select("doc_id", "tokens", top.alias("domain"), *[c.alias(f"p_{d}") for c, d in zip(p, DOMAINS, strict=True)], "rate", "copies", *[F.element_at(c, k + 1).alias(f"{c}_{d}") for c in TOTALS for k, d in enumerate(DOMAINS)], "rounds")
