"""Sparse rule ensemble for text quality.

Statistics of a text are Spark column expressions. A random forest is fitted on
labelled documents; each path from its root to a node is a conjunction of
conditions on the statistics. Lasso logistic regression weighs these rules, and
those with a weight are compiled back into one column expression, so that scoring
is a projection without Python.

The forest and the weights are fitted on at most ``TRAIN_ROWS`` labelled documents,
those whose doc_id has the smallest hash. A null text counts as empty; where no
document is labelled, or all have one label, the score is that label's share (0.5
without labels). A doc_id labelled more than once has its largest label.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, stash

#: Labelled documents that a model is fitted on, at most.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3


def statistics(text: str = "text") -> dict[str, Column]:
    """Name and expression of each statistic of a text column."""
    t = F.coalesce(F.col(text), F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(t, "\n")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")

    def share(mark: str) -> Column:
        return (F.length(t) - F.length(F.replace(t, F.lit(mark)))) / chars

    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(t) / n_words,
        "upper": F.regexp_count(t, F.lit(r"\p{Lu}")) / chars,
        "digits": F.regexp_count(t, F.lit(r"[0-9]")) / chars,
        "marks": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,]")) / chars,
        "shouts": share("!"),
        "bars": share("|"),
        "stops": share("."),
        "commas": share(","),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "words_a_line": n_words / F.size(lines),
        "longest_word": F.log1p(F.array_max(F.transform(words, lambda w: F.length(w))).cast("double")),
    }


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(*keep, *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in statistics().items()))


class Rules:
    """Weighted conjunctions of conditions (statistic, low, high): low < value <= high."""

    def __init__(self, bias: float, rules: list[tuple[float, tuple[tuple[str, float, float], ...]]]):
        self.bias, self.rules = bias, rules

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        terms = [F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0)) for weight, rule in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.bias))))


def condition(rule: tuple[tuple[str, float, float], ...]) -> Column:
    parts = []
    for name, low, high in rule:
        if low > -math.inf:
            parts.append(F.col(name) > low)
        if high < math.inf:
            parts.append(F.col(name) <= high)
    return reduce(lambda a, b: a & b, parts)


def paths(model, names: list[str]) -> list[tuple[tuple[str, float, float], ...]]:
    """The distinct conjunctions that lead to the nodes of a forest's trees."""
    found: dict[tuple, None] = {}

    def walk(node, held: dict[str, tuple[float, float]]) -> None:
        if held:
            found[tuple((n, *held[n]) for n in names if n in held)] = None
        if node.getClass().getSimpleName() != "InternalNode":
            return
        split = node.split()
        name, at = names[split.featureIndex()], float(split.threshold())
        low, high = held.get(name, (-math.inf, math.inf))
        walk(node.leftChild(), held | {name: (low, min(high, at))})
        walk(node.rightChild(), held | {name: (max(low, at), high)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def labelled(docs: DataFrame, labels: DataFrame, label: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text and y of a bounded sample of labelled documents; the sample's size bounds what is broadcast."""
    known = labels.select("doc_id", label.alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, trees: int = 20, depth: int = 4, lasso: float = 0.001, rows: int = TRAIN_ROWS) -> Rules:
    """Learns from docs (doc_id, text) and labels (doc_id, quality)."""
    names = list(statistics())
    train = stash(with_statistics(labelled(docs, labels, F.col("quality").cast("double"), rows), ["y"]).coalesce(16), "quality-train")
    seen = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        discard(train)
        share = min(0.98, max(0.02, next(iter(seen), 0.5)))
        return Rules(math.log(share / (1 - share)), [])
    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(train)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, subsamplingRate=0.5, featureSubsetStrategy="onethird", seed=11).fit(vectors)
    rules = paths(forest, names)
    flags = F.array(*[condition(r).cast("double") for r in rules])  # one column: a plan with one for each rule is large
    flat = stash(train.select("y", array_to_vector(flags).alias("x")), "quality-rules")
    lines = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(flat)
    discard(train, flat)
    weights = lines.coefficients.toArray().tolist()
    return Rules(float(lines.intercept), [(w, r) for w, r in zip(weights, rules, strict=True) if w])


def score(docs: DataFrame, rules: Rules, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, with score: the probability of label 1."""
    return with_statistics(docs, keep).select(*keep, rules.score().alias("score"))


def accept(docs: DataFrame, rules: Rules, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, as they are."""
    held = docs.withColumns({f"_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in statistics().items()})
    own = Rules(rules.bias, [(w, tuple((f"_{n}", low, high) for n, low, high in r)) for w, r in rules.rules])
    return held.filter(own.score() >= threshold).select([f"`{c}`" for c in docs.columns])


def op4_quality(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = fit(docs.filter(crc_mod("doc_id", 5) != 0), labels.filter(crc_mod("doc_id", 5) != 0))
    asked = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)))
    out = score(asked, rules, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
