"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

A document's set has the hashes of its distinct word shingles. SuperMinHash gives
each element a random permutation of the signature's slots: the j-th slot it meets
gets j plus a random fraction, and a slot keeps its least value. Values of one
element are so correlated across slots that estimates vary less than with
independent hashes; once every slot holds a value below j + 1 no later step can
change it, and the element loop stops early.

Documents with equal sets are one class, represented by the smallest doc_id. Classes
meet where a band of their signatures agrees; each meets the band's pivot first.
Links are confirmed on the full sets. Buckets whose classes aren't in one component
by then are compared further: classes outside a bucket's largest component, its
minority, meet all of its classes in blocks of up to ``BLOCK`` of each. Signatures
come first; only classes that have a likely partner in another component go on with
their sets. A component is named by its smallest doc_id.

Bands and the least agreement follow from the similarity asked for (``bands_for``, ``least_for``), so that a
pair at it is missed with a probability under ``MISSED`` by either. With ``exact`` none is: classes then meet at
the smallest of their shingles' hashes, as many as two similar sets must share one of, and
signatures exclude no pair. That costs about (100 - percent) % of all shingles in rows.

No task gets all rows of a hot key. A join with a table that has one row a key splits
off the keys of most rows, fewer than ``HEAVY`` by counting, and broadcasts these; a
pivot's pairs are confirmed in groups of ``PAIRS``, each with one copy of its set; no
pair is written before it is confirmed.

A text without a word has an empty set and is linked with nothing, as is a null. With
fewer words than a shingle has, the whole sequence is one shingle. Every row of the
input has a row in the result. Rows that share a doc_id are one document: each has
the size of its own set, and all have one component, reached through any of their
texts. Rows without a doc_id are linked with nothing, have no component, and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, raw_texts, scratch, slices, stash
from .graph import UnionFind, connected_components

SLOTS = 128
MISSED = 1e-7
BLOCK = 512
PAIRS = 256
#: Keys that are split off and broadcast, at most, and the rows that a key has then, at least.
HEAVY = 100_000
LEAST_HEAVY = 1_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_STEPS = np.arange(1, 257, dtype=np.uint64) * _STEP
_SEED = mix64(_STEPS)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, and where each text's begin (one more entry than texts).

    Words are what lies between ASCII white space, with A-Z lower-cased.
    """
    data = _LOWER[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    space = _SPACE[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    power = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SEED[data] * power[:-1], out=sums[1:])
    unshift = np.full(len(data) + 1, _INVERSE, np.uint64)
    unshift[0] = 1
    word = mix64((sums[end] - sums[start]) * np.cumprod(unshift, dtype=np.uint64)[start] + (end - start).astype(np.uint64) * _STEP)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(start, edges)
    count = np.diff(first)
    made = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    ends = np.cumsum(made)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - made, made) + np.repeat(first[:-1], made)
    taken = np.repeat(np.minimum(count, words), made)
    hashes = np.zeros(len(at), np.uint64)
    for k in range(words):
        use = taken > k
        hashes[use] = mix64((hashes[use] ^ word[at[use] + k]) + _STEP)
    hashes[taken < words] ^= np.uint64(0xA5A5A5A5A5A5A5A5)
    owner = np.repeat(np.arange(len(texts)), made)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, begins: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signature of each set: texts x slots, a value's step in the top byte and its fraction below.

    Slots of an empty set hold the largest integer.
    """
    rows = len(begins) - 1
    out = np.full((rows, slots), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.diff(begins)
    owner = np.repeat(np.arange(rows), sizes)
    element = hashes
    order: np.ndarray | None = None
    flat = out.reshape(-1)
    for j in range(slots):
        if not len(element):
            break
        random = mix64(element + _STEPS[j])
        pick = j + ((random & np.uint64(0xFFFFFF)) * np.uint64(slots - j) >> np.uint64(24)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            each = np.arange(len(element))
            slot = order[each, pick].astype(np.int64)
            order[each, pick] = order[:, j]
        np.minimum.at(flat, owner * slots + slot, np.uint64(j) << np.uint64(56) | random >> np.uint64(8))
        open_rows = (out >> np.uint64(56)).max(axis=1) > j
        going = open_rows[owner]
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8), (int(going.sum()), 1))
            order[np.arange(len(order)), pick[going]] = 0
        elif not going.all():
            order = order[going]
        element, owner = element[going], owner[going]
    return out


def bands_for(percent: int) -> int:
    """The fewest bands of equal width that a pair of this similarity shares none of with a probability under MISSED; 32 for 80 %."""
    for width in (64, 32, 16, 8, 4, 2, 1):
        if (1 - (percent / 100) ** width) ** (SLOTS // width) <= MISSED:
            return SLOTS // width
    raise ValueError(f"signatures of {SLOTS} slots can't tell pairs of {percent} % from others; exact=True can")


def least_for(percent: int) -> int:
    """Slots in which signatures of this similarity agree at least, seven standard deviations down; 70 for 80 %."""
    share = percent / 100
    return max(0, int(SLOTS * share - 7 * (SLOTS * share * (1 - share)) ** 0.5))


def bands_of(signature: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each band of each signature: texts x bands."""
    rows, slots = signature.shape
    parts = signature.reshape(rows, bands, slots // bands)
    out = np.zeros((rows, bands), np.uint64)
    for k in range(parts.shape[2]):
        out = mix64((out ^ parts[:, :, k]) + _STEP)
    return out.view(np.int64)


def _sums(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Two hashes of each set: sums of its elements, scrambled in two ways."""
    total = np.zeros((2, len(hashes) + 1), np.uint64)
    np.cumsum(mix64(hashes), out=total[0, 1:])
    np.cumsum(mix64(hashes + _STEP), out=total[1, 1:])
    return (total[:, begins[1:]] - total[:, begins[:-1]]).view(np.int64)


def _sketch(docs: DataFrame, words: int, n_bands: int) -> DataFrame:
    """One row per document with a set: doc_id, n_shingles, two hashes of the set, its bands and short forms of its slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch)
            for start, end in slices(texts, 1 << 18):
                hashes, begins = shingles(texts[start:end], words)
                signature = signatures(hashes, begins)
                sizes = np.diff(begins)
                one, two = _sums(hashes, begins)
                bands = bands_of(signature, n_bands)
                short = (mix64(signature) & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start).cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(one), pa.array(two),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1]), pa.int32()), pa.array(bands.ravel())),
                        pa.array([x.tobytes() for x in short], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "one", "two", "bands", "slots"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, one long, two long, bands array<long>, slots binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and its sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch)
            for start, end in slices(texts, 1 << 18):
                hashes, begins = shingles(texts[start:end], words)
                one, two = _sums(hashes, begins)
                items = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start).cast(pa.int64()), pa.array(one), pa.array(two), items], names=["doc_id", "one", "two", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, one long, two long, items array<long>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the share of common elements is at least ``percent``; sets without repeats."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (small + large - common)


def with_unique(rows: DataFrame, unique: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with a table that has one row a key and in ``n`` the number of rows of that key, of ``total`` rows in all.

    Keys of more than a HEAVY-th of all rows can't be as many as HEAVY, so they are broadcast; no task gets more rows of another key.
    """
    most = max(LEAST_HEAVY, total // HEAVY)
    marked = rows.join(F.broadcast(unique.filter(F.col(n) > most)), keys, "left")
    return marked.filter(f"{n} IS NOT NULL").unionByName(marked.filter(f"{n} IS NULL").select(*rows.columns).join(unique.filter(F.col(n) <= most), keys))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose sets are similar; ``sets`` has doc_id and items, and more than one row for a document of several texts."""
    total = pairs.count()
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = with_unique(pairs, sizes, ["a"], "n", total).withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PAIRS)))
    ones = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.col("a").alias("b"), "items")
    others = dealt.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "items")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _runs(batches, "a", "part"):
            found = []
            for group in some:
                pivot, ids = group.column("a")[0].as_py(), group.column("b").to_numpy()
                items = _lists(group.column("items"))
                own = [items[k] for k in np.flatnonzero(ids == pivot)]
                found += [(pivot, int(ids[k])) for k in np.flatnonzero(ids != pivot) for x in own if similar(x, items[k], percent)]
            yield _pairs(found)

    return ones.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part").mapInArrow(check, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[pa.RecordBatch]]:
    """Lists of whole groups of a sorted partition: those that each batch completes."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        done = []
        for start, end in zip(cuts, cuts[1:], strict=False):
            mark = tuple(marks[:, start].tolist())
            if held and mark != last:
                done.append(_whole(held))
                held = []
            held.append(batch.slice(start, end - start))
            last = mark
        yield done
    if held:
        yield [_whole(held)]


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[x:y] for x, y in zip(ends, ends[1:], strict=False)]


def _sides(group: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the group that are members, rows that are its minority, and for each pair of them one more than the slots they agree in.

    It is 0 for pairs of one component and for those that agree in fewer slots than ``least``.
    """
    minor = group.column("minor").to_numpy(zero_copy_only=False)
    component = group.column("component").to_numpy()
    left, right = np.flatnonzero(~minor), np.flatnonzero(minor)
    short = np.frombuffer(b"".join(group.column("slots").to_pylist()), np.uint8).reshape(len(minor), -1)
    equal = np.zeros((len(left), len(right)), np.int16)
    for i in range(0, len(left), 32):
        equal[i : i + 32] = (short[left[i : i + 32], None] == short[right][None]).sum(axis=2)
    equal += 1
    equal[(equal <= least) | (component[left][:, None] == component[right])] = 0
    return left, right, equal


def _likely(least: int):
    """The rows of each group that have a likely partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _runs(batches, "g"):
            for group in some:
                left, right, equal = _sides(group, least)
                if equal.any():
                    yield group.take(pa.array(np.concatenate([left[equal.any(axis=1)], right[equal.any(axis=0)]])))

    return run


def _compare(percent: int, least: int):
    """A forest of the links found in each group, the most similar pairs first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _runs(batches, "g"):
            found = []
            for group in some:
                left, right, equal = _sides(group, least)
                ids, items = group.column("doc_id").to_pylist(), _lists(group.column("items"))
                sets = UnionFind()
                for i, c in zip(ids, group.column("component").to_pylist(), strict=True):
                    sets.union(i, c)
                row, column = np.nonzero(equal)
                for k in np.argsort(-equal[row, column], kind="stable").tolist():
                    i, j = int(left[row[k]]), int(right[column[k]])
                    if sets.find(ids[i]) != sets.find(ids[j]) and similar(items[i], items[j], percent):
                        sets.union(ids[i], ids[j])
                        found.append((ids[i], ids[j]))
            yield _pairs(found)

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of each row; with ``exact`` no link is left to chance."""
    with scratch() as made:
        done = stash(_grouped(docs, words, percent, exact), "near-duplicates")
        made.append(done)
    return done


def _grouped(docs: DataFrame, words: int, percent: int, exact: bool) -> DataFrame:
    n_bands, least = (1, 0) if exact else (bands_for(percent), least_for(percent))
    sketch = stash(_sketch(docs, words, n_bands), "sketch")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    lone, full = sketch.filter(alone), sketch.filter(~alone).select("doc_id", "n_shingles", "one", "two", "bands", "slots")
    best = F.min(F.struct("doc_id", "bands", "slots")).alias("own")
    classes = stash(full.groupBy("one", "two", "n_shingles").agg(best, F.count("*").alias("n")).select("one", "two", "n_shingles", "n", F.col("own.doc_id").alias("rep"), "own.bands", "own.slots"), "classes")
    total, n_classes = full.count(), classes.count()
    # rows with what represents their set, and links between the sets of one document
    key = ["one", "two", "n_shingles"]
    owned = stash(with_unique(full.select("doc_id", *key), classes.select(*key, "rep", "n"), key, "n", total).select("doc_id", "n_shingles", "rep"), "owned")
    several = owned.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x <> y").select("doc_id")
    own = owned.join(several, "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()

    wanted = classes.select(F.col("rep").alias("doc_id"), "one", "two")

    def sets_of(texts: DataFrame) -> DataFrame:
        return stash(_sets(texts, words).join(wanted, ["doc_id", "one", "two"], "left_semi").dropDuplicates(["doc_id", "one", "two"]).select("doc_id", "items"), "sets")

    texts = docs.select("doc_id", "text")
    if exact:
        sets = sets_of(texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"))
        shared_one = F.size("items") - F.ceil(F.size("items") * percent / 100).cast("int") + 1
        member = sets.select("doc_id", F.lit(0).alias("band"), F.explode(F.slice("items", F.lit(1), shared_one)).alias("key")).select("doc_id", "band", "key")
    else:
        member = classes.select(F.col("rep").alias("doc_id"), F.posexplode("bands").alias("band", "key"))
    n_members = member.count() if exact else n_bands * n_classes
    shared = member.groupBy("band", "key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    met = stash(with_unique(member, shared, ["band", "key"], "n", n_members).select("band", "key", "doc_id", "pivot", "n"), "met")
    if not exact:
        sets = sets_of(texts.join(met.select("doc_id").distinct(), "doc_id", "left_semi"))
    pairs = stash(met.filter("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    first = stash(confirmed(pairs, sets, percent).unionByName(own), "links")
    groups = stash(connected_components(first), "groups")

    placed = met.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    parts = placed.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    unsure = parts.groupBy("band", "key").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("most"), F.sum("n").alias("size"), F.max("n").alias("largest")).filter("size > largest")
    slots = classes.select(F.col("rep").alias("doc_id"), "slots").dropDuplicates(["doc_id"])
    rest = stash(with_unique(placed.select("band", "key", "doc_id", "component"), unsure, ["band", "key"], "size", n_members).join(slots, "doc_id"), "unsure")

    def blocks(n: Column) -> Column:
        return F.ceil(n / BLOCK).cast("int")

    def dealt(rows: DataFrame, own: Column, others: Column, minor: bool) -> DataFrame:
        part, other = F.pmod(F.xxhash64("doc_id"), own).cast("int"), F.explode(F.sequence(F.lit(0), others - 1))
        each = rows.withColumn("part", part).withColumn("other", other)
        x, y = ("other", "part") if minor else ("part", "other")
        return each.select(F.xxhash64("band", "key", x, y).alias("g"), F.lit(minor).alias("minor"), "doc_id", "component", "slots")

    all_parts, minor_parts = blocks(F.col("size")), blocks(F.col("size") - F.col("largest"))
    met_again = dealt(rest, all_parts, minor_parts, False).unionByName(dealt(rest.filter("component <> most"), minor_parts, all_parts, True))
    likely = met_again.repartition("g").sortWithinPartitions("g").mapInArrow(_likely(least), met_again.schema)
    second = stash(likely, "likely").join(sets, "doc_id").repartition("g").sortWithinPartitions("g").mapInArrow(_compare(percent, least), "a long, b long")
    merged = connected_components(stash(first.unionByName(second).distinct(), "links"))

    sizes = owned.groupBy("rep").agg(F.count("*").alias("n")).join(merged.withColumnRenamed("node", "rep"), "rep")
    placed_rows = with_unique(owned, sizes, ["rep"], "n", total).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    unlinked = owned.join(merged.select(F.col("node").alias("rep")), "rep", "left_anti").select("doc_id", "n_shingles", F.col("rep").alias("component_id"))
    out = placed_rows.unionByName(unlinked).unionByName(lone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those that have a near duplicate of smaller doc_id in their group.

    Of rows that share a doc_id the one of least text hash stays; rows without a doc_id stay.
    """
    kept = near_duplicates(docs, words, percent).filter("kept").select("doc_id").distinct()
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select("doc_id", every, F.struct(F.xxhash64("text"), F.xxhash64("text", F.lit(1))).alias("rank")).join(kept, "doc_id", "left_semi")
    once = own.groupBy("doc_id").agg(F.min_by("row", "rank").alias("row")).select("row.*")
    return once.unionByName(docs.filter("doc_id IS NULL"))


def op7_near_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=80)


ORACLE = r"""
WITH RECURSIVE named AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
split AS (
  SELECT r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM named),
sets AS (
  SELECT r, doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS s
  FROM split),
classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
each AS (SELECT rep, n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM each a JOIN each b ON a.x = b.x AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT rep AS node, rep AS root FROM classes
  UNION SELECT e.b, reach.root FROM reach JOIN edges e ON e.a = reach.node WHERE reach.root < e.b),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(doc_id = coalesce(root, doc_id), true) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s AND doc_id IS NOT NULL LEFT JOIN least ON classes.rep = least.node
"""
