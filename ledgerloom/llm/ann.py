"""Nearest neighbours by inner product with an inverted multi-index.

Each half of a vector is quantised on its own, so a vector lies in the cell of a
pair of centroids. For a query a heap yields the pairs from the best sum of the two
halves' scores on, until their cells hold the share ``share`` of all entries, and
more than ``k`` at least. Entries of these cells are reranked with the original
vectors in double precision. The share falls slowly as tables grow (``visited_share``),
since the nearest of more vectors stand out more; a share of one visits every cell. Equal
vectors are one entry with its smallest ids, as many as a result can hold, so that
copies of a vector, however many, cost nothing.

Codebooks are fitted on a bounded sample (``SAMPLE_ROWS`` vectors, those whose id has
the smallest hash); every vector is indexed. Blocks are ranges of cells with about
``BLOCK`` entries (a larger cell is in several blocks); a query goes to the blocks that
hold cells it visits, and a block that many queries visit meets them in chunks.

Vectors that are null, zero or hold null or non-finite components take no part, nor
do those of another length than most of the sample, or without an id. Rows that
repeat an id are rows of their own: each is a candidate, for the others too, and each
query row has its own result. A query with fewer candidates has them all.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

SAMPLE_ROWS = 20_000
#: Centroids of each half.
CENTROIDS = 256
#: Share of all entries that a query's cells are to hold in a table of so many entries or fewer, and the power by which it falls beyond; less suits vectors that lie in groups.
SHARE = 0.35
SHARE_ENTRIES = 10_000
FALLS = 0.04
#: Steps into which the traversal cuts the range of sums; only of the last step are pairs put in order.
RINGS = 16
#: Entries of a block, and blocks at most (which bounds what is known of each).
BLOCK = 8_192
MOST_BLOCKS = 100_000
#: Queries that a block meets at a time, and those scored together.
CHUNK = 4_096
TOGETHER = 512


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and v (array of double) of the vectors that take part."""
    v = F.col(f"`{vector_column}`")
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(f"`{id_column}`").isNotNull() & v.isNotNull()).filter(good)
    return rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.cast("array<double>").alias("v"))


def visited_share(entries: int) -> float:
    """The share of a table's entries that a query's cells are to hold."""
    return SHARE * min(1.0, SHARE_ENTRIES / max(entries, 1)) ** FALLS


def codebook(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids of the rows of x by Lloyd's algorithm from spread-out rows."""
    rng = np.random.default_rng(5)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)
        sizes = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1)).argmax(axis=1)


def traverse(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, need: int, rings: int = RINGS) -> np.ndarray:
    """Which centroid pairs are visited: from the best sum of scores on, until their cells hold ``need`` entries.

    The heap has each first centroid with its best sum not yet visited, and yields the pairs of one step of sums (one of ``rings`` equal ones)
    before those of the next. A step that doesn't reach the need is visited whole, in whatever order; of the one that does, pairs are taken by
    their sums. So the pairs visited are those that a heap of single pairs visits, at the price of few heap operations.
    """
    order = np.argsort(-two, kind="stable")
    falling, held = two[order], np.zeros((len(one), len(two) + 1), np.int64)
    np.cumsum(sizes[:, order], axis=1, out=held[:, 1:])
    step = max(float(one.max() - one.min() + falling[0] - falling[-1]) / rings, 1e-300)
    rising, best = (-falling).tolist(), one.tolist()
    queue = [(-(s + falling[0]), i) for i, s in enumerate(best)]
    heapq.heapify(queue)
    top = -queue[0][0]
    reached, found, ring, inside = [0] * len(best), 0, 0, []
    while queue:
        now = int((top + queue[0][0]) / step) + 1  # sums above top - ring * step belong to this step
        if now != ring and inside:
            took = sum(int(held[i, end] - held[i, begin]) for i, begin, end in inside)
            if found + took >= need:
                break
            found += took
            inside = []
        ring = now
        _, i = heapq.heappop(queue)
        end = max(bisect.bisect_left(rising, best[i] - (top - ring * step)), reached[i] + 1)
        inside.append((i, reached[i], end))
        reached[i] = end
        if end < len(rising):
            heapq.heappush(queue, (rising[end] - best[i], i))
    for i, begin, _ in inside:
        reached[i] = min(reached[i], begin)
    visited = np.zeros(sizes.shape, bool)
    visited[:, order] = np.arange(len(two)) < np.array(reached)[:, None]
    first = np.repeat([i for i, _, _ in inside], [end - begin for _, begin, end in inside])
    second = order[np.concatenate([np.arange(begin, end) for _, begin, end in inside])] if inside else first
    last = np.argsort(-(one[first] + two[second]), kind="stable")
    reach = int(np.searchsorted(np.cumsum(sizes[first[last], second[last]]), need - found)) + 1
    visited[first[last[:reach]], second[last[:reach]]] = True
    return visited


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, each summed from the first component to the last."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def rerank(queries: pd.DataFrame, entries: pd.DataFrame, top: int, seconds: int) -> pd.DataFrame:
    """The best ``top`` ids of this block for each query, of entries in cells that it visits.

    Entries lie in order of their cells, so those of one first centroid are a slice, which meets the queries that visit any cell of it.
    """
    entries = entries.sort_values("cell", kind="stable")
    q, x = np.stack(queries["v"]), np.stack(entries["v"])
    base = int(queries["base"].iloc[0])
    cell = entries["cell"].to_numpy() - base
    ids, own = entries["ids"].tolist(), entries["rows"].tolist()
    first = (cell + base) // seconds
    starts = np.flatnonzero(np.diff(first, prepend=-1))
    out = []
    for at in range(0, len(q), TOGETHER):
        some = q[at : at + TOGETHER]
        seen = np.unpackbits(np.frombuffer(b"".join(queries["mask"].iloc[at : at + TOGETHER]), np.uint8).reshape(len(some), -1), axis=1)[:, cell].astype(bool)
        scores = np.full(seen.shape, -np.inf)
        for low, high in zip(starts, [*starts[1:], len(cell)], strict=True):
            rows = np.flatnonzero(seen[:, low:high].any(axis=1))
            scores[rows, low:high] = np.where(seen[rows, low:high], some[rows] @ x[low:high].T, -np.inf)
        k = min(top, scores.shape[1])
        least = np.partition(scores, -k, axis=1)[:, -k]
        row, entry = np.nonzero((scores >= least[:, None] - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))[:, None]) & (scores > -np.inf))
        exact = exact_scores(some[row], x[entry])
        sizes = np.array([len(ids[e]) for e in entry], int)
        flat = pd.DataFrame({"query": queries["id"].to_numpy()[at + np.repeat(row, sizes)], "id": np.array([i for e in entry for i in ids[e]], np.int64), "row": np.array([i for e in entry for i in own[e]], np.int64), "score": np.repeat(exact, sizes)})
        flat = flat.sort_values(["query", "score", "id"], ascending=[True, False, True], kind="stable")
        out.append(flat.groupby("query", sort=False).head(top))
    return pd.concat(out)


def search(vectors: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20, share: float | None = None) -> DataFrame:
    """query_id, rank, id, score: the k nearest found of each row for which ``is_query`` (an expression over id) holds.

    With a ``share`` of one every cell is visited, so the nearest of all are found; without one it is that of the table's size.
    """
    spark = vectors.sparkSession
    rows = stash(usable(vectors, id_column, vector_column).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE_ROWS).toPandas()
    if sample.empty:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    dims = int(sample["v"].map(len).value_counts().sort_index(ascending=True).idxmax())
    half = dims // 2
    fitted = np.stack([v for v in sample["v"] if len(v) == dims])
    books = spark.sparkContext.broadcast((codebook(fitted[:, :half], CENTROIDS), codebook(fitted[:, half:], CENTROIDS)))
    firsts, seconds = (len(b) for b in books.value)

    # equal vectors as one entry; a result needs no more than k + 1 ids of it
    rows = rows.filter(F.size("v") == dims)
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id", "row"))).filter(F.col("n") <= k + 1)
    classes = ranked.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("own")).select("v", F.col("own.id").alias("ids"), F.col("own.row").alias("rows"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["v"])
                i, j = nearest(x[:, :half], books.value[0]), nearest(x[:, half:], books.value[1])
                yield pdf.assign(cell=(i * seconds + j).astype(np.int32))

    entries = stash(classes.mapInPandas(place, "v array<double>, ids array<long>, rows array<long>, cell int"), "entries")
    sizes = np.zeros(firsts * seconds, np.int64)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row a cell at most
        sizes[r["cell"]] = r["n"]
    total = int(sizes.sum())
    need = max(int(np.ceil((visited_share(total) if share is None else share) * total)), k + 1)
    size, ends = max(BLOCK, -(-total // MOST_BLOCKS)), np.cumsum(sizes)
    low, high = (ends - sizes) // size, np.maximum(ends - 1, 0) // size  # the blocks that a cell's entries are in
    used = np.flatnonzero(sizes)
    begin, stop = np.full(high[-1] + 1, len(sizes)), np.zeros(high[-1] + 1, np.int64)  # a block's range of cells
    for way, blocks in ((np.minimum, begin), (np.maximum, stop)):
        way.at(blocks, low[used], used), way.at(blocks, high[used], used)
    for c in used[high[used] - low[used] > 1]:
        begin[low[c] + 1 : high[c]] = stop[low[c] + 1 : high[c]] = c
    known = spark.sparkContext.broadcast((sizes, low, high, begin, stop))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, low, high, _, _ = known.value
        for pdf in frames:
            cell = pdf["cell"].to_numpy()
            spread = high[cell] - low[cell] + 1
            own = np.array([x[0] for x in pdf["rows"]], np.int64)
            yield pdf.assign(block=low[cell] + own % spread)

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, low, high, begin, stop = known.value
        for pdf in frames:
            out: dict[str, list] = {"id": [], "v": [], "block": [], "base": [], "mask": []}
            for i, v in zip(pdf["id"], pdf["v"], strict=True):
                seen = traverse(books.value[0] @ v[:half], books.value[1] @ v[half:], sizes.reshape(firsts, seconds), need).ravel() & (sizes > 0)
                cells = np.flatnonzero(seen)
                for b in np.unique(np.concatenate([low[cells], high[cells], *[np.arange(low[c], high[c]) for c in cells[high[cells] - low[cells] > 1]]])).tolist():
                    for key, value in zip(out, (i, v, b, int(begin[b]), np.packbits(seen[begin[b] : stop[b] + 1]).tobytes()), strict=True):
                        out[key].append(value)
            yield pd.DataFrame(out)

    # queries of equal vectors are one search
    asked = rows.filter(is_query)
    leader = asked.groupBy("v").agg(F.min("row").alias("lead"))
    led = asked.join(leader, "v").select(F.col("id").alias("query_id"), F.col("row").alias("query_row"), "lead")
    tasks = max(spark.sparkContext.defaultParallelism, -(-asked.count() // 2_048))
    probes = leader.select(F.col("lead").alias("id"), "v").repartition(tasks, "id").mapInPandas(plan, "id long, v array<double>, block long, base int, mask binary")
    probes = stash(probes, "probes")
    visits = F.broadcast(stash(probes.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "visits"))  # a row a block
    probes = probes.join(visits, "block").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = entries.mapInPandas(deal, "v array<double>, ids array<long>, rows array<long>, cell int, block long").join(visits, "block").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "id": [], "row": [], "score": []})
        return rerank(left, right, k + 1, seconds)

    found = probes.select("id", "v", "block", "base", "mask", "chunk").groupBy("block", "chunk").cogroup(dealt.drop("chunks").groupBy("block", "chunk")).applyInPandas(meet, "query long, id long, row long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")  # a task keeps no more than these of what it found before it sends them
    nearest_ = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    out = led.join(nearest_, F.col("lead") == F.col("query")).filter("row <> query_row")
    last = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    return out.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op2_inverted_multi_index(spark, sf_dir) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")


#: What the search is held against: all vectors.
EXACT = """
WITH good AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
parts AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM good),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x) AS score
  FROM parts q JOIN parts c ON q.i = c.i
  WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id GROUP BY ALL),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
