"""Reversible masking of checksum-verified identifiers.

VAT IDs, IBANs, emails and phone numbers are replaced by tokens numbered by kind
within a text, in this order; VAT IDs and IBANs only where their check digits
hold. The map from token to value is a transient column, never to be written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checksum
from ..functions import patterns as P
from ..functions.text import let

KINDS = (("VAT_ID", P.VAT_ID, checksum.vat_id_valid), ("IBAN", P.IBAN, checksum.iban_valid), ("EMAIL", P.EMAIL, None), ("PHONE", P.PHONE, None))
_ENTRIES = "array<struct<token:string,value:string>>"


#: What a token looks like.
TOKEN = "<(?:" + "|".join(kind for kind, _, _ in KINDS) + ")_[0-9]+>"


def _mask(state: Column, kind: str, pattern: str, check) -> Column:
    """The state (text, entries) with one kind replaced; only what passes the check is numbered.

    Text is joined once from slices of pieces and hits, so many hits in a long text take linear time.
    """

    def replaced(hits: Column) -> Column:
        n = F.size(hits)
        places = F.sequence(F.lit(0), n - 1) if check is None else F.filter(F.transform(hits, lambda h, i: F.when(check(h), i)), lambda i: i.isNotNull())
        pieces = F.flatten(F.zip_with(F.split(state["text"], pattern, -1), hits, lambda p, h: F.array(p, F.coalesce(h, F.lit("")))))

        def token(k: Column) -> Column:
            return F.concat(F.lit(f"<{kind}_"), k.cast("string"), F.lit(">"))

        def segment(held: Column):
            """A piece of text up to the next place, with the token before it."""

            def make(at: Column, k: Column) -> Column:
                plain = F.array_join(F.slice(held["pieces"], 2 * at + 3, 2 * (F.get(held["edges"], k + 1) - at) - 1), "")
                return F.when(k == 0, plain).otherwise(F.concat(token(k), plain))

            return make

        def joined(held: Column) -> Column:
            starts = F.slice(held["edges"], F.lit(1), F.size(held["edges"]) - 1)
            entry = lambda i, k: F.struct(token(k + 1).alias("token"), F.get(hits, i).alias("value"))
            found = F.transform(F.slice(starts, F.lit(2), F.size(starts)), entry)
            return F.struct(F.array_join(F.transform(starts, segment(held)), "").alias("text"), F.concat(state["entries"], found).alias("entries"))

        edges = F.concat(F.array(F.lit(-1)), places, F.array(n))
        return F.when(n > 0, let(F.struct(pieces.alias("pieces"), edges.alias("edges")), joined)).otherwise(state)

    return let(F.regexp_extract_all(state["text"], F.lit(pattern), F.lit(0)), replaced)


def sanitize(text: Column) -> Column:
    """struct(text, mapping): the masked text and the map from token to value. A text without what identifiers begin with stays as it is."""
    plain = F.struct(text.alias("text"), F.array().cast(_ENTRIES).alias("entries"))
    state = plain
    for kind, pattern, check in KINDS:
        state = _once(state, kind, pattern, check)
    state = F.when(F.contains(text, F.lit("@")) | text.rlike(P.IDENTIFIER), state).otherwise(plain)
    return let(state, lambda s: F.struct(s["text"].alias("text"), F.map_from_entries(s["entries"]).alias("mapping")))


def _once(state: Column, kind: str, pattern: str, check) -> Column:
    return let(state, lambda s: _mask(s, kind, pattern, check))


def reidentify(text: Column, mapping: Column) -> Column:
    """The text with each token replaced by its value, in one pass."""
    hits = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    back = F.array_join(F.flatten(F.zip_with(F.split(text, TOKEN, -1), hits, lambda p, h: F.array(p, F.coalesce(F.try_element_at(mapping, h), h, F.lit(""))))), "")
    return F.when(F.size(mapping) > 0, back).otherwise(text)


def counts(mapping: Column) -> Column:
    """struct of the number of tokens by kind."""
    keys = F.map_keys(mapping)

    def of(kind: str) -> Column:
        return F.size(F.filter(keys, lambda k: k.startswith(f"<{kind}_"))).cast("long").alias(kind.lower())

    return F.struct(*[of(kind) for kind, _, _ in KINDS])
