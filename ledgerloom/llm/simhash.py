"""SimHash near-dedup with the words of a covering code as anchors.

A fingerprint's bit is 1 where over half of a text's shingle hashes (XXH64) have it.
Two fingerprints that differ in few bits differ in one bit at most in one of a few
blocks, so each block is searched on its own for that. In a block the anchors are the
words of a Hamming code on its low bits with the other bits free: every value has its
home, the anchor within the covering radius (``COVERING``, one). If two values differ in ``WITHIN`` bits,
one lies within the radius plus ``WITHIN`` of the other's home. So a fingerprint is
replicated to every anchor of that distance, about 15 a block, and at each anchor those
at home meet all that came there. Whole fingerprints decide on links.

Equal fingerprints are one class. No task gets all rows of a hot anchor: anchors of more
than ``CELL`` rows are dealt into parts, each with the same few pivots; parts that have
not become one component by then are compared in blocks, those outside the largest
component with all. Within a part a search goes on from each linked fingerprint and looks
only at those not yet reached, so a dense group costs little. Every link is found
that joins two components; components are named by their smallest doc_id.

A null or empty text, or one without a word, has the fingerprint zero, linked like any
other. With fewer words than a shingle has, the whole sequence is one shingle. Every row
of the input has a row in the result; rows that share a doc_id are one document, with
one component through all their texts. Rows without a doc_id keep their fingerprint, are
linked with nothing and have no component.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, raw_texts, scratch, stash
from .graph import connected_components
from .minhash import _pairs, _runs, with_unique

BITS = 64
SEED = 42
#: A Hamming code's covering radius, and the differing bits that one block has at most.
COVERING = 1
WITHIN = 1
#: Rows of an anchor that one task compares, at most; pivots that the parts of a larger one share.
CELL = 4_096
PIVOTS = 64
#: Comparisons made at a time for anchors with few rows.
AT_ONCE = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, words: int = 4) -> int:
    """The 64-bit fingerprint of a text in UTF-8; zero without words."""
    found = _WORD.findall(text.translate(_LOWER))
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(found) - words + 1)
    ends = ends[min(words, len(found)) - 1 :].tolist()
    digest, half = xxhash.xxh64_intdigest, n / 2
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + (1 << 16))], ends[at:], strict=False)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones > half, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, column="text"):
            fps = np.array([fingerprint(t, words) for t in raw_texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def blocks_of(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the blocks: so many that fingerprints that differ in ``bits`` bits differ in WITHIN at most in one."""
    n = bits // (WITHIN + 1) + 1
    if not 0 <= bits or BITS // n < 7:
        raise ValueError("fingerprints are linked at 0 to 17 differing bits")
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def flips(width: int, most: int) -> np.ndarray:
    """All values of ``width`` bits with ``most`` ones at most, fewest first."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(width), k)], np.uint64)


def syndrome(values: np.ndarray, width: int) -> np.ndarray:
    """Zero where the value is an anchor: the exclusive or of the numbers, from 1, of the set bits among the code's."""
    length = (1 << ((width + 1).bit_length() - 1)) - 1  # the longest Hamming code that fits
    out = np.zeros(values.shape, np.uint64)
    for i in range(length):
        out ^= np.where(values >> np.uint64(i) & np.uint64(1), np.uint64(i + 1), np.uint64(0))
    return out


def anchors(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every anchor within the covering radius and WITHIN of each value: row, anchor, and whether it is the row's home."""
    patterns = flips(width, COVERING + WITHIN)
    row, k = np.nonzero(syndrome(values, width)[:, None] == syndrome(patterns, width)[None, :])
    home = np.ones(len(row), bool)
    home[1:] = row[1:] != row[:-1]  # patterns come fewest ones first, and a home is nearest
    return row, values[row] ^ patterns[k], home


def _replicas(classes: DataFrame, bits: int) -> DataFrame:
    """cell (block and anchor), home and fp: each fingerprint at all its anchors."""
    parts = blocks_of(bits)
    shift = np.uint64(max(width for _, width in parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, rows=4096):
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i, (low, width) in enumerate(parts):
                values = fps >> np.uint64(low) & (np.uint64(1 << width) - np.uint64(1) if width < BITS else np.uint64(2**64 - 1))
                row, anchor, home = anchors(values, width)
                cell = anchor if len(parts) == 1 else np.uint64(i) << shift | anchor
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(home), pa.array(fps[row].view(np.int64))], names=["cell", "home", "fp"])

    return classes.select("fp").mapInArrow(run, "cell long, home boolean, fp long")


def _close(one: np.ndarray, two: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(one ^ two) <= bits


def _meet_small(fp: np.ndarray, home: np.ndarray, begin: np.ndarray, size: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows at home and all rows of their anchor; begin and size are of each row's anchor."""
    left = np.flatnonzero(home)
    found = []
    many = np.cumsum(size[left])
    cuts = np.searchsorted(many, np.arange(AT_ONCE, many[-1] + AT_ONCE, AT_ONCE), side="left") + 1 if len(many) else []
    at = 0
    for cut in cuts:
        some = left[at:cut]
        at = cut
        n = size[some]
        if not len(some):
            continue
        ends = np.cumsum(n)
        partner = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(begin[some], n)
        own = np.repeat(some, n)
        hit = _close(fp[own], fp[partner], bits) & (fp[own] != fp[partner])
        found.append(np.stack([fp[own[hit]], fp[partner[hit]]]))
    return np.unique(np.sort(np.concatenate(found, axis=1).view(np.int64), axis=0), axis=1) if found else np.zeros((2, 0), np.int64)


def _reach(fp: np.ndarray, bits: int, minor: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints: each one reached looks at those not yet reached; with ``minor``, links have a side in it."""
    rest = np.arange(len(fp))
    found = []
    while len(rest):
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            i = frontier.pop()
            hit = _close(fp[rest], fp[i], bits)
            if minor is not None and not minor[i]:
                hit &= minor[rest]
            near = rest[hit]
            rest = rest[~hit]
            found += [(int(fp[i].view(np.int64)), int(x)) for x in fp[near].view(np.int64)]
            frontier += near.tolist()
    return found


def _compare(bits: int):
    """Links of each group g of a sorted partition; groups of few rows are compared together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _runs_at_once(batches):
            g, fp = some.column("g").to_numpy(), some.column("fp").to_numpy().view(np.uint64)
            home = some.column("home").to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            sizes = np.diff(np.r_[begins, len(g)])
            small = np.repeat(sizes <= 256, sizes)
            one, two = _meet_small(fp, home & small, np.repeat(begins, sizes), np.repeat(sizes, sizes), bits)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["a", "b"])
            for k in np.flatnonzero(sizes > 256):
                yield _pairs(_reach(np.unique(fp[begins[k] : begins[k] + sizes[k]]), bits))

    return run


def _runs_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(batch.schema.get_field_index("g")).to_numpy()
        last = int(np.searchsorted(g, g[-1]))  # the last group may go on
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blockwise(bits: int):
    """Links of each group between its minority and its other rows, and within its minority."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _runs(batches, "g"):
            found = []
            for group in some:
                fp, minor = group.column("fp").to_numpy().view(np.uint64), group.column("minor").to_numpy(zero_copy_only=False)
                order = np.lexsort((~minor, fp))
                fp, minor = fp[order], minor[order]
                new = np.r_[True, fp[1:] != fp[:-1]]
                found += _reach(fp[new], bits, minor[new])
            yield _pairs(found)

    return run


def links(classes: DataFrame, bits: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints: as many as give the components of all pairs that differ in ``bits`` bits or fewer."""
    cells = stash(_replicas(classes, bits), "anchors")
    total = cells.count()
    counts = cells.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    large = stash(counts.filter(F.col("n") > CELL), "large-anchors")
    hot = large.filter("homes > 0").select("cell", "n")  # at the others nothing meets

    def found(rows: DataFrame, work) -> DataFrame:
        return rows.repartition("g").sortWithinPartitions("g").mapInArrow(work(bits), "a long, b long")

    cool = cells.join(large.select("cell"), "cell", "left_anti").withColumnRenamed("cell", "g")
    if hot.isEmpty():
        return stash(found(cool, _compare).distinct(), "links")
    marked = with_unique(cells.join(hot.select("cell"), "cell", "left_semi"), hot, ["cell"], "n", total)
    parts = F.ceil(F.col("n") / CELL).cast("int")
    chosen = marked.groupBy("cell", F.pmod(F.xxhash64("fp"), F.lit(PIVOTS)).alias("k")).agg(F.min("fp").alias("fp"), F.first("n").alias("n"))
    own = marked.select(F.xxhash64("cell", F.pmod(F.hash("fp"), parts)).alias("g"), F.lit(True).alias("home"), "fp")
    pivots = chosen.select("cell", "fp", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select(F.xxhash64("cell", "part").alias("g"), F.lit(True).alias("home"), "fp")
    first = stash(found(cool, _compare).unionByName(found(own.unionByName(pivots), _compare)).distinct(), "links")

    groups = connected_components(first).withColumnRenamed("node", "fp")
    placed = stash(marked.select("cell", "fp").join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "placed")
    sizes = placed.groupBy("cell", "component").agg(F.count("*").alias("m"))
    unsure = sizes.groupBy("cell").agg(F.max_by("component", F.struct("m", "component")).alias("most"), F.sum("m").alias("size"), F.max("m").alias("largest")).filter("size > largest")
    rest = with_unique(placed, stash(unsure, "unsure"), ["cell"], "size", total).withColumn("minor", F.col("component") != F.col("most"))
    all_parts, minor_parts = F.ceil(F.col("size") / CELL).cast("int"), F.ceil((F.col("size") - F.col("largest")) / CELL).cast("int")

    def dealt(rows: DataFrame, mine, others, swapped: bool) -> DataFrame:
        each = rows.withColumn("part", F.pmod(F.hash("fp"), mine)).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
        x, y = ("other", "part") if swapped else ("part", "other")
        return each.select(F.xxhash64("cell", x, y).alias("g"), "fp", "minor")

    again = dealt(rest, all_parts, minor_parts, False).unionByName(dealt(rest.filter("minor"), minor_parts, all_parts, True))
    return stash(first.unionByName(found(again, _blockwise)).distinct(), "links")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of each row."""
    with scratch() as made:
        done = stash(_grouped(docs, words, bits), "simhash")
        made.append(done)
    return done


def _grouped(docs: DataFrame, words: int, bits: int) -> DataFrame:
    rows = stash(fingerprints(docs, words), "fingerprints")
    named = rows.filter("doc_id IS NOT NULL")
    classes = stash(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    total = named.count()
    pairs = links(classes, bits)
    several = named.groupBy("doc_id").agg(F.min("fp").alias("least"), F.max("fp").alias("fp")).filter("least <> fp").select("doc_id", "least")
    same = named.join(several, "doc_id").filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    found = stash(connected_components(pairs.unionByName(same)), "components").withColumnRenamed("node", "fp")
    known = classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = stash(known.join(least, "component").select("fp", "n", "component_id"), "roots")
    out = with_unique(named, of, ["fp"], "n", total).select("doc_id", "fp", "component_id")
    out = out.unionByName(rows.filter("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark, sf_dir) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, bits=4)
