"""Hard negatives by a block matrix product in two dimensions.

Anchors times rows is a matrix of inner products. Anchors and rows are dealt into blocks
and their components into chunks of ``DIMS``; for each pair of blocks and each chunk a
task multiplies one block of anchors with one of rows. These partial tiles of int64
scores are shuffled to their tile and added there, and a whole tile gives no more than a
window's first few entries. Components are whole numbers (floor of ``SCALE`` times the
component), so sums are exact in any order; a product takes floating point only
where no sum can leave the whole numbers that it holds.

Positives come first: blocks of anchors meet rows of their own label. Then blocks of
anchors, which know the scores of their positives, meet blocks of all rows, and each tile
keeps the first ``k`` rows of another label in the window of each anchor and positive.
Labels, however common, are cut into blocks of ``ROWS`` rows.

Rows with a null label or id, a null vector, or one with null or non-finite components take
no part. Vectors shorter than the longest count as if zeros followed. Rows that
repeat an id are rows of their own, each an anchor, positive or negative. Ties go to the
smaller id. An anchor without another row of its label, or without a row of another label
in a window, has no result; nor has an empty table. Scores are exact while they fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .codes import finite, matrix, whole
from .common import portions, scratch, stash

SCALE = 256
#: Rows and anchors of a block, and components of a chunk.
ROWS = 4_096
ANCHORS = 128
DIMS = 32
#: Below this a product of whole numbers is exact in floating point.
EXACT = 2.0**53


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two int64 matrices."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < EXACT else a @ b.T


def panels(rows: DataFrame, keys: list[str], dims: int, extra: list[str]) -> DataFrame:
    """One row for each block (``keys``) and chunk of components: its rows' numbers and the columns ``extra``, in order of their numbers, and the components packed."""
    chunks = -(-dims // DIMS)
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*keys, "row", *extra).schema}
    told = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "chunk int, rows array<long>", *(f"{e} array<{kinds[e]}>" for e in extra), "values binary"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, rows=1024):
            x = matrix(batch.column(batch.schema.get_field_index("v")), dims)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in kinds]
            for c in range(chunks):
                part = np.ascontiguousarray(x[:, c * DIMS : (c + 1) * DIMS])
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(x), c, np.int32)), pa.array([p.tobytes() for p in part], pa.binary())], names=[*kinds, "chunk", "values"])

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable")
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "chunk": [pdf["chunk"].iloc[0]], "rows": [pdf["row"].tolist()], **{e: [pdf[e].tolist()] for e in extra}, "values": [b"".join(pdf["values"])]})

    parts = rows.mapInArrow(cut, ", ".join([*(f"{c} {t}" for c, t in kinds.items()), "chunk int, values binary"]))
    return parts.groupBy(*keys, "chunk").applyInPandas(pack, told)


def tiles(left: DataFrame, right: DataFrame, pairs: list[str], reduce, schema: str) -> DataFrame:
    """Whole tiles of scores, each given to ``reduce``; ``pairs`` are the columns that name a tile.

    ``left`` and ``right`` are panels that have these columns. Their partial products are shuffled to the tile and added.
    """

    first = {c: f.dataType.simpleString() for c, f in zip(left.columns, left.schema, strict=True) if c not in (*pairs, "chunk", "values")}
    second = {c: f.dataType.simpleString() for c, f in zip(right.columns, right.schema, strict=True) if c not in (*pairs, "chunk", "values")}
    keys = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in pairs)
    told = ", ".join([keys, "high int", *(f"{c} {t}" for c, t in first.items()), *(f"other_{c} {t}" for c, t in second.items()), "tile binary"])

    def multiply(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        """One block of each side at a time; what belongs to their rows travels with the first chunk alone."""
        if one.empty or two.empty:
            return pd.DataFrame(columns=[*pairs, "high", *first, *[f"other_{c}" for c in second], "tile"], dtype=object)
        x, y = one.iloc[0], two.iloc[0]
        a, b = (np.frombuffer(r["values"], np.int64).reshape(len(r["rows"]), -1) for r in (x, y))
        lead = x["chunk"] == 0
        about = {c: [x[c] if lead else None] for c in first} | {f"other_{c}": [y[c] if lead else None] for c in second}
        return pd.DataFrame({**{c: [x[c]] for c in pairs}, "high": [len(a)], **about, "tile": [product(a, b).tobytes()]})

    partial = left.groupBy(*pairs, "chunk").cogroup(right.groupBy(*pairs, "chunk")).applyInPandas(multiply, told)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        high = int(pdf["high"].iloc[0])
        total = sum(np.frombuffer(t, np.int64).reshape(high, -1) for t in pdf["tile"])
        return reduce(pdf[pdf["rows"].notna()].iloc[0], total)

    return partial.groupBy(*pairs).applyInPandas(add, schema)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def positives(anchors: DataFrame, rows: DataFrame, dims: int, k: int) -> DataFrame:
    """anchor, n (from 1) and score, id of its k first other rows of the same label."""
    own = panels(anchors.withColumn("anchor_block", F.pmod(F.xxhash64("row"), F.ceil(F.col("n_anchors") / ANCHORS)).cast("int")), ["label", "anchor_block"], dims, [])
    theirs = panels(rows.withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("n_rows") / ROWS)).cast("int")), ["label", "block"], dims, ["id"])
    sizes = rows.groupBy("label").agg(F.ceil(F.max("n_rows") / ROWS).cast("int").alias("blocks"), F.ceil(F.max("n_anchors") / ANCHORS).cast("int").alias("anchor_blocks")).filter("anchor_blocks > 0")
    own = own.join(sizes, "label").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks", "anchor_blocks")
    theirs = theirs.join(sizes, "label").withColumn("anchor_block", F.explode(F.expr("sequence(0, anchor_blocks - 1)"))).drop("blocks", "anchor_blocks")

    def first(r: pd.Series, scores: np.ndarray) -> pd.DataFrame:
        mine, others, ids = (np.array(r[c], np.int64) for c in ("rows", "other_rows", "other_id"))
        found = []
        for i, anchor in enumerate(mine):
            use = np.flatnonzero(others != anchor)
            use = use[_best(scores[i, use], ids[use], k)]
            found.append(pd.DataFrame({"anchor": anchor, "id": ids[use], "score": scores[i, use]}))
        return pd.concat(found)

    found = tiles(own, theirs, ["label", "anchor_block", "block"], first, "anchor long, id long, score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, id_column: str = "vec_id", vector_column: str = "embedding", n_positives: int = 5, k: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``is_anchor`` and ``label`` are expressions over ``id``, and ``label`` over the table's columns; negatives score
    between the two percentages of their positive's score.
    """
    with scratch() as made:
        done = stash(_mined(vectors, is_anchor, label, id_column, vector_column, n_positives, k, window), "negatives")
        made.append(done)
    return done


def _mined(vectors: DataFrame, is_anchor: Column, label: Column, id_column: str, vector_column: str, n_positives: int, k: int, window: tuple[int, int]) -> DataFrame:
    v = F.col(f"`{vector_column}`")
    good = vectors.filter(F.col(f"`{id_column}`").isNotNull() & finite(v))
    good = good.select(F.col(f"`{id_column}`").cast("long").alias("id"), label.cast("string").alias("label"), whole(v, SCALE).alias("v")).filter("label IS NOT NULL")
    # a stored number for each row, as ids may repeat
    rows = stash(good.withColumn("row", F.monotonically_increasing_id()).withColumn("is_anchor", is_anchor), "rows")
    dims = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    sizes = stash(rows.groupBy("label").agg(F.count("*").alias("n_rows"), F.count_if("is_anchor").alias("n_anchors")), "labels")
    n_rows, n_anchors = sizes.agg(F.sum("n_rows"), F.sum("n_anchors")).first()
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    counted = rows.join(F.broadcast(sizes), "label") if sizes.count() <= 10_000 else rows.join(sizes, "label")
    found = stash(positives(counted.filter("is_anchor"), counted, dims, n_positives), "positives")

    asked = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("p"))
    anchors = rows.filter("is_anchor").join(asked.withColumnRenamed("anchor", "row"), "row")
    anchors = anchors.withColumn("scores", F.transform("p", lambda x: x["score"])).withColumn("anchor_block", F.pmod(F.xxhash64("row"), F.lit(-(-n_anchors // ANCHORS))).cast("int"))
    blocks, anchor_blocks = -(-n_rows // ROWS), -(-n_anchors // ANCHORS)
    own = panels(anchors, ["anchor_block"], dims, ["label", "scores"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    theirs = panels(rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), ["block"], dims, ["label", "id"]).withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    low, high = window

    def in_windows(r: pd.Series, scores: np.ndarray) -> pd.DataFrame:
        ids, labels = np.array(r["other_id"], np.int64), np.array(r["other_label"], object)
        out: list[tuple] = []
        for i, (anchor, own_label, wanted) in enumerate(zip(r["rows"], r["label"], r["scores"], strict=True)):
            use = np.flatnonzero(labels != own_label)
            use = use[_best(scores[i, use], ids[use], len(use))]
            falling = -scores[i, use]
            for n, p in enumerate(wanted, 1):
                most, least = high * int(p) // 100, -(-low * int(p) // 100)
                begin, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                out += [(anchor, n, int(ids[j]), int(scores[i, j])) for j in use[begin : max(begin, min(end, begin + k))]]
        return pd.DataFrame(out, columns=["anchor", "n", "negative_id", "negative_score"]).astype("int64")

    negatives = tiles(own, theirs, ["anchor_block", "block"], in_windows, "anchor long, n int, negative_id long, negative_score long")
    best = Window.partitionBy("anchor", "n").orderBy(F.desc("negative_score"), "negative_id")
    kept = negatives.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = found.select("anchor", "n", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(rows.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return kept.join(named, ["anchor", "n"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    """One label in seven is moved on by one first, as labels that can't be trusted."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(vectors, F.col("id") % 100 == 0, label)


ORACLE = """
WITH good AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
each AS (
  SELECT r, unnest(range(1, len(v) + 1)) AS i, unnest(list_transform(v, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS x FROM good),
products AS (
  SELECT a.r AS anchor, b.r AS other, CAST(sum(a.x * b.x) AS BIGINT) AS s
  FROM each a JOIN good g ON a.r = g.r AND g.vec_id % 100 = 0 JOIN each b ON a.i = b.i GROUP BY ALL),
scored AS (
  SELECT g.r AS anchor, g.vec_id AS anchor_id, o.r AS other, o.vec_id AS other_id, g.label = o.label AS same, coalesce(p.s, 0) AS s
  FROM good g JOIN good o ON g.vec_id % 100 = 0 AND g.r <> o.r LEFT JOIN products p ON p.anchor = g.r AND p.other = o.r),
positive AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY s DESC, other_id) AS n FROM scored WHERE same QUALIFY n <= 5),
negative AS (
  SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY c.s DESC, c.other_id) AS INTEGER) AS rank,
    c.other_id AS negative_id, p.s AS positive_score, c.s AS negative_score
  FROM positive p JOIN scored c ON p.anchor = c.anchor AND NOT c.same AND 30 * p.s <= 100 * c.s AND 100 * c.s <= 90 * p.s)
SELECT * FROM negative WHERE rank <= 10
"""
