"""Loose matches of names for creditor tables of any size, over an index of character grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import settled
from .matching import loose_key
from .skew import join_unique, meet

GRAM = 4
#: A vendor's loose name has this many characters at least.
SHORTEST = 6


def grams(c: Column, size: int = GRAM) -> Column:
    """The distinct substrings of a length; a shorter text is its own gram."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(size))))


def _rarest(names: DataFrame, name: str, counts: DataFrame) -> DataFrame:
    """name and the gram of it that fewest creditors have; none where a gram has no creditor."""
    each = names.select(name, F.explode(grams(F.col(name))).alias("gram"))
    asked = settled(counts.join(each.groupBy("gram").agg(F.count("*").alias("n")), "gram", "right").withColumn("held", F.coalesce("held", F.lit(0))))
    known = join_unique(each, asked, "gram", "n", asked.agg(F.sum("n")).first()[0] or 0)
    found = known.groupBy(name).agg(F.min(F.struct("held", "gram")).alias("g")).filter("g.held > 0").select(name, F.col("g.gram").alias("gram"))
    return settled(found)


def match_loosely(df: DataFrame, creditors: DataFrame, strip_forms: bool = False) -> DataFrame:
    """key, creditor_id: for each row of df (key, vendor_name) the first creditor (by rank) whose loose name holds the vendor's or is held by it.

    A name that holds the vendor's has all grams of it, so it is looked up by the vendor's rarest; a name held by the vendor's has its
    own rarest gram in it, so creditors are listed under that one and all grams of the vendor's name look. Only pairs that
    share such a gram are compared. Equal loose names are one; rows without a match are left out, as are vendors' names under SHORTEST characters.
    """
    mine = df.select("key", loose_key(F.col("vendor_name"), strip_forms).alias("own")).filter(F.length("own") >= SHORTEST)
    names = settled(mine.groupBy("own").agg(F.count("*").alias("rows")))
    theirs = creditors.select("rank", "creditor_id", loose_key(F.col("name"), strip_forms).alias("their")).filter("their <> ''").groupBy("their").agg(F.min(F.struct("rank", "creditor_id")).alias("best"))
    theirs = settled(theirs)
    listed = theirs.select("their", "best", F.explode(grams(F.col("their"))).alias("gram"))
    counts = settled(listed.groupBy("gram").agg(F.count("*").alias("held")))

    holding = meet(_rarest(names.select("own"), "own", counts), listed, "gram", F.contains("their", "own"), "own", "their")
    index = theirs.join(_rarest(theirs.select("their"), "their", counts), "their").select("their", "best", "gram")
    short = [r[0] for r in theirs.filter(F.length("their") < GRAM).select(F.length("their")).distinct().collect()]  # lengths under GRAM
    looks = F.array_distinct(F.flatten(F.array(*[grams(F.col("own"), n) for n in (GRAM, *sorted(short))])))
    held = meet(names.select("own", F.explode(looks).alias("gram")), index, "gram", F.contains("own", "their"), "own", "their")

    found = holding.select("own", "best").unionByName(held.select("own", "best")).groupBy("own").agg(F.min("best").alias("best"))
    return join_unique(mine, found.join(names, "own"), "own", "rows", names.agg(F.sum("rows")).first()[0] or 0).select("key", "best.creditor_id")
