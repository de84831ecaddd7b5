"""Personal data by fixed patterns and by bootstrapped context.

Emails, IP addresses, payment cards and phone numbers that match the base patterns
are spans of their own. They seed a bootstrap: the one or two words before a seed
are lexical patterns. Other identifier-like tokens (with an @ or four digits or
more) with the same words before them are instances of these patterns. On the
graph of patterns and instances, a pattern's score for a kind is the share of its
distinct instances that are known to be of that kind, weighted by their scores,
and an instance's score is the chance that one of its patterns is right; the two
are computed in turn until they stay the same. A pattern counts for a kind once
``SUPPORT`` of its instances are seeds or have reached ``CONFIDENCE``. Instances that
reach it, and have a shape fit for the kind, are spans of that kind wherever they
stand.

Everything is DataFrame expressions and joins; no Python runs on executors. Patterns
and instances that most mentions share are split off where tables meet, so no task gets them whole. Null
texts are empty. Rows with equal doc_id and text get equal results. Offsets are in
code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, stash
from .minhash import with_unique

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with possessive quantifiers and bounds on where a match can begin, so that
#: texts of any length take linear time; they match the same spans as the plain patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Identifier-like tokens of 4 to 64 characters; those without an @ or four digits are dropped, longer runs are none (addresses
#: have 64 characters before the @ at most, and cards, phones and IP addresses are shorter).
TOKEN = r"(?<![A-Za-z0-9._%+@:/-])(?=[A-Za-z._%+:/-]*+[0-9@])[A-Za-z0-9._%+@:/-]{4,64}+(?![A-Za-z0-9._%+@:/-])"
CONFIDENCE = 0.8
#: Distinct instances of a kind, seeds or found ones, that a pattern needs.
SUPPORT = 3
#: Scores are final when none changes by more in a round.
EPSILON = 1e-6
#: Characters in which two words are looked for first; longer ones are taken whole.
CONTEXT = 64
RUN = 256
_SPANS = "array<struct<start:int,end:int,hit:string>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    if kind == "ip":
        part = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(part, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(hit))).otherwise(F.lit(False))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _passes(kind: str):
    return lambda span: valid(kind, span["hit"])


def _is(kind: str):
    return lambda span: span["kind"] == kind


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern with their offsets, which follow from the lengths of matches and of what lies between.

    Lengths are summed by runs of ``RUN`` matches and then over runs, so that many matches in a text stay cheap.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(g.alias("gap"), h.alias("hit")))

    def step(held: Column, x: Column) -> Column:
        start = held["at"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.array_append(held["found"], F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))).alias("found"))

    def moved(run: Column, by: Column) -> Column:
        return F.transform(run["found"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["hit"].alias("hit")))

    def placed(all_pairs: Column) -> Column:
        none = F.array().cast(_SPANS)
        first = F.struct(F.lit(0).alias("at"), none.alias("found"))
        starts = F.sequence(F.lit(1), F.size(all_pairs), F.lit(RUN))
        runs = F.transform(starts, lambda i: F.aggregate(F.slice(all_pairs, i, F.lit(RUN)), first, step))

        def sums(all_runs: Column) -> Column:
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("by"))
            by = F.aggregate(all_runs, zero, lambda held, r: F.struct((held["at"] + r["at"]).alias("at"), F.array_append(held["by"], held["at"]).alias("by")), lambda held: held["by"])
            return F.flatten(F.zip_with(all_runs, by, moved))

        return _with(runs, sums)

    return F.when(F.regexp_count(text, F.lit(pattern)) > 0, _with(pairs, placed)).otherwise(F.array().cast(_SPANS))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def before(text: Column, start: Column) -> Column:
    """The last two words in front of an offset and the white space after each, with what else the last ``CONTEXT`` characters hold."""
    near = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    cut = (start > CONTEXT) & near.rlike(r"\s$") & ~near.rlike(r"\s\S++\s++\S++\s++$")
    return F.lower(F.when(cut, _two_words(F.substring(text, F.lit(1), start))).otherwise(near))


def _two_words(left: Column) -> Column:
    """The end of a text from its last word but one on, in linear time however long the words are."""

    def from_word(x: Column) -> Column:
        return F.length(F.rtrim(x)) - F.length(F.substring_index(F.rtrim(x), " ", -1))

    spaced = F.translate(left, "\t\n\x0b\f\r", " " * 5)
    return _with(spaced, lambda x: F.substring(left, from_word(F.substring(x, F.lit(1), from_word(x))) + 1, F.length(left)))


def masked(text: Column, kind: str) -> Column:
    """The text with spans of a kind overwritten by control characters of the same number."""
    hits = F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0))

    def pair(gap: Column, hit: Column) -> Column:
        return F.array(gap, F.when(valid(kind, hit), F.repeat(F.lit("\x01"), F.length(hit))).otherwise(F.coalesce(hit, F.lit(""))))

    return F.array_join(F.flatten(F.zip_with(F.split(text, BASE[kind], -1), hits, pair)), "")


def fits(kind: str, hit: Column) -> Column:
    """Whether a token's shape allows a kind."""
    n = F.length(_digits(hit))
    plain = hit.rlike(r"^[0-9+().-]+$")
    return {
        "email": hit.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$"),
        "ip": hit.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})$"),
        "card": plain & n.between(13, 19),
        "phone": plain & n.between(6, 15),
    }[kind]


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _row (two hashes of the row), base: spans by kind, and others: identifier-like tokens outside them, all with the text before."""
    rows = docs.select("doc_id", F.struct(F.xxhash64("doc_id", "text").alias("one"), F.xxhash64(F.lit("two"), "text", "doc_id").alias("two")).alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({f"_{k}": matches(F.col("text"), BASE[k]) for k in KINDS})
    rows = rows.withColumns({f"_{k}": F.filter(f"_{k}", _passes(k)) for k in KINDS})
    rows = rows.withColumn("_rest", F.col("text"))
    for k in KINDS:
        rows = rows.withColumn("_rest", F.when(F.size(f"_{k}") > 0, masked(F.col("_rest"), k)).otherwise(F.col("_rest")))
    rows = rows.withColumn("_other", F.when(F.col("_rest").rlike("[0-9]{4}|@|[0-9][.:-][0-9]"), matches(F.col("_rest"), TOKEN)).otherwise(F.array().cast(_SPANS)))

    def seen(spans: Column, kind: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), before(F.col("text"), s["start"]).alias("left")))

    base = F.concat(*[seen(F.col(f"_{k}"), F.lit(k)) for k in KINDS])
    others = F.filter("_other", lambda s: (F.length(_digits(s["hit"])) >= 4) | F.contains(s["hit"], F.lit("@")))
    return rows.select("doc_id", "_row", base.alias("base"), seen(others, F.lit(None).cast("string")).alias("others"))


def scores(edges: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """hit and, by kind, the final score of the instances of a graph (pattern, hit, kind: that of a seed or null).

    A pattern's score t solves t = (seeds + sum of c) / (instances + 1), with c = 1 - (1 - t) r for an unseen instance that
    other patterns leave out with chance r. For given r that is solved at once, so that a pattern's own unseen instances
    need no rounds; scores only rise, from zero, to the least fixed point, the one that plain rounds tend to.
    """
    trust, moved, total = None, 1.0, edges.count()
    open_ = {k: F.col("kind").isNull() & F.col(f"fit_{k}") for k in KINDS}
    edges = edges.withColumns({f"fit_{k}": fits(k, F.col("hit")) for k in KINDS})
    while moved > EPSILON:
        held = edges.withColumns({f"t_{k}": F.lit(0.0) for k in KINDS}) if trust is None else with_unique(edges, trust.select("pattern", "n", *[f"t_{k}" for k in KINDS]), ["pattern"], "n", total).drop("n")
        held = held.withColumns({f"l_{k}": F.log(F.greatest(1 - F.col(f"t_{k}"), F.lit(1e-9))) for k in KINDS})
        chance = held.groupBy("hit").agg(F.count("*").alias("m"), *[F.sum(f"l_{k}").alias(f"all_{k}") for k in KINDS])
        both = with_unique(held, chance, ["hit"], "m", total)
        out, parts = [], []
        for k in KINDS:
            seed = F.col("kind") == k
            left_out = F.exp(F.col(f"all_{k}") - F.col(f"l_{k}"))
            parts += [
                F.count_if(seed | (open_[k] & (1 - F.exp(f"all_{k}") >= confidence))).alias(f"n_{k}"),
                F.sum(F.when(seed, 1.0).when(open_[k], 1 - left_out).otherwise(0.0)).alias(f"sure_{k}"),
                F.sum(F.when(open_[k], left_out).otherwise(0.0)).alias(f"free_{k}"),
                F.max(f"t_{k}").alias(f"was_{k}"),
            ]
            out.append(F.when(F.col(f"n_{k}") >= support, F.col(f"sure_{k}") / (F.col("n") + 1 - F.col(f"free_{k}"))).otherwise(0.0).alias(f"t_{k}"))
        solved = both.groupBy("pattern").agg(F.count("*").alias("n"), *parts).select("pattern", "n", *out, *[f"was_{k}" for k in KINDS])
        old, trust = trust, stash(solved, "pattern-scores")
        if old is not None:
            discard(old)
        moved = trust.agg(F.max(F.greatest(*[F.abs(F.col(f"t_{k}") - F.col(f"was_{k}")) for k in KINDS])).alias("d")).first()["d"] or 0.0
    reach = with_unique(edges, trust, ["pattern"], "n", total).groupBy("hit").agg(F.first("kind").alias("kind"), *[F.first(f"fit_{k}").alias(f"fit_{k}") for k in KINDS], *[(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col(f"t_{k}"), F.lit(1e-9)))))).alias(f"c_{k}") for k in KINDS])
    return reach.select("hit", *[F.when(F.col("kind") == k, 1.0).when(open_[k], F.col(f"c_{k}")).otherwise(0.0).alias(k) for k in KINDS])


def discover(spans: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """_row, kind, start, end of tokens that the bootstrap takes for personal data."""
    mention = spans.select("_row", F.explode(F.concat("base", "others")).alias("m")).select("_row", "m.*")
    words = F.regexp_extract("left", r"(?<!\S)(\S++)\s++$", 1), F.regexp_extract("left", r"(?<!\S)(\S++\s++\S++)\s++$", 1)
    patterns = F.array_distinct(F.filter(F.array(*words), lambda w: w.rlike(r"\p{L}")))
    mention = stash(mention.select("_row", "kind", "start", "end", "hit", patterns.alias("patterns")), "mentions")
    met = stash(mention.select("hit", F.explode("patterns").alias("pattern")).distinct(), "pattern-hits")
    hits = mention.groupBy("hit").agg(F.min("kind").alias("kind"), F.count_if(F.col("kind").isNull()).alias("unseen"))
    kinds = met.groupBy("hit").agg(F.count("*").alias("n")).join(hits.select("hit", "kind"), "hit")
    edges = stash(with_unique(met, kinds, ["hit"], "n", met.count()).select("hit", "pattern", "kind"), "pattern-graph")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("as"), F.col(k).alias("c")) for k in KINDS]))
    sure = scores(edges, confidence, support).select("hit", each.alias("s")).filter(F.col("s.c") >= confidence).select("hit", F.col("s.as").alias("as"))
    fit = F.coalesce(*[F.when(F.col("as") == k, fits(k, F.col("hit"))) for k in KINDS])
    all_sure = sure.groupBy("hit").agg(F.collect_set("as").alias("all")).join(hits.filter("unseen > 0").select("hit", "unseen"), "hit")  # four kinds at most
    unseen = mention.filter("kind IS NULL").select("_row", "start", "end", "hit")
    found = with_unique(unseen, all_sure, ["hit"], "unseen", unseen.count()).withColumn("as", F.explode("all")).filter(fit)
    return found.select("_row", F.col("as").alias("kind"), "start", "end").distinct()


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end by kind and start) of each row.

    The result is a stored table of offsets; tables that hold identifiers in clear are deleted before it is returned.
    """
    with scratch() as kept:
        out = stash(_detected(docs), "pii-spans")
        kept.append(out)
    return out


def _detected(docs: DataFrame) -> DataFrame:
    found = stash(base_spans(docs), "pii")
    added = discover(found).groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    both = found.join(added, "_row", "left").withColumn("base", plain).withColumn("all", F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))))
    ranked = F.array_sort(F.transform("all", lambda s: F.struct(F.element_at(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return both.select("doc_id", "base", F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def op3_pii(spark, sf_dir) -> DataFrame:
    out = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
