"""Creditors and accounts for invoices.

With master data as literals (at most 100 rows) matching is a projection. For
creditor tables of any size, ``match_creditors`` joins on the keys instead, and ``loose`` on parts of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, present, strip
from ..sources.master import VAT_ACCOUNTS, Master

_CREDITOR = "struct<creditor_id:string,account:string>"


def _vat_key(c: Column) -> Column:
    return F.upper(strip(c))


def _iban_key(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit(" "), F.lit("")))


def _name_key(c: Column) -> Column:
    return F.lower(strip(c))


def loose_key(c: Column, strip_forms: bool = False) -> Column:
    """ASCII letters and digits in lower case; with ``strip_forms`` without legal forms."""
    bare = F.regexp_replace(c, r"(?iU)\b(?:gmbh|mbh|ag|kg|ug|co|und)\b", "") if strip_forms else c
    return F.lower(F.regexp_replace(bare, "[^A-Za-z0-9]", ""))


def creditor(master: Master, name: Column, vat_id: Column | None = None, iban: Column | None = None, strip_forms: bool = False) -> Column:
    """struct(creditor_id, account) of the first creditor with an equal key, else of the first that a long enough name part fits.

    The order of creditors decides, not that of keys.
    """
    vat, bank = (F.lit(None).cast("string") if c is None else c for c in (vat_id, iban))
    if not master.creditors:
        return F.lit(None).cast(_CREDITOR)

    def keys(v: Column, b: Column, n: Column) -> list[Column]:
        return [_vat_key(present(v)).alias("vat"), _iban_key(present(b)).alias("iban"), _name_key(present(n)).alias("name"), present(loose_key(n, strip_forms)).alias("loose")]

    # the creditors' keys are constants, the row's are computed once
    texts = [[F.lit(x).cast("string") for x in row] for row in master.creditors]
    every = F.array(*[F.struct(*keys(v, b, n), F.struct(i.alias("creditor_id"), a.alias("account")).alias("creditor")) for i, n, v, a, b in texts])

    def equal(own: Column):
        def test(c: Column) -> Column:
            return F.coalesce(own["vat"] == c["vat"], F.lit(False)) | F.coalesce(own["iban"] == c["iban"], F.lit(False)) | F.coalesce(own["name"] == c["name"], F.lit(False))

        return test

    def near(own: Column):
        return lambda c: F.contains(c["loose"], own["loose"]) | F.contains(own["loose"], c["loose"])

    def found(own: Column) -> Column:
        long = F.length(own["loose"]) >= 6
        return F.coalesce(F.get(F.filter(every, equal(own)), F.lit(0)), F.when(long, F.get(F.filter(every, near(own)), F.lit(0))))["creditor"]

    return let(F.struct(*keys(vat, bank, name)), found).cast(_CREDITOR)


def match_creditors(df: DataFrame, creditors: DataFrame) -> DataFrame:
    """``df`` (vendor_name, vat_id, iban) with creditor_id of the first creditor (by rank) that any key equals.

    Joins once for each kind of key, against keys made unique before, so that no row multiplies.
    """
    out = df
    for name, own, key in (("vat_id", "vat_id", _vat_key), ("iban", "iban", _iban_key), ("name", "vendor_name", _name_key)):
        keys = creditors.filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy(key(F.col(name)).alias("_key")).agg(F.min(F.struct("rank", "creditor_id")).alias(f"_{name}"))
        out = out.withColumn("_key", key(present(F.col(own)))).join(keys, "_key", "left").drop("_key")
    best = F.least("_vat_id", "_iban", "_name")
    return out.withColumn("creditor_id", best["creditor_id"]).drop("_vat_id", "_iban", "_name")


def keyword(master: Master, vendor: Column, description: Column) -> Column:
    """struct(account, keyword) of the first keyword, in the order of rules, that vendor and description contain."""
    hay = F.lower(F.concat(F.coalesce(vendor, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    rules = F.array(*[F.struct(F.lit(a).alias("account"), F.lit(w).alias("keyword")) for a, w in master.keywords])
    return let(hay, lambda h: F.get(F.filter(rules, lambda r: F.contains(h, r["keyword"])), F.lit(0)))


def account_name(master: Master, account: Column) -> Column:
    """The account's name, or the account where it has none."""
    names = F.create_map(*[F.lit(x) for pair in master.accounts for x in pair])
    return F.coalesce(F.try_element_at(names, account), account)


def suggestion(master: Master, vendor: Column, description: Column, matched: Column) -> Column:
    """struct(account, name, source, confidence, creditor_id, keyword): by creditor, else by keyword, else unresolved."""
    by_word = keyword(master, vendor, description)
    none = F.lit(None).cast("string")

    def made(account: Column, source: str, confidence: str, creditor_id: Column, word: Column) -> Column:
        return F.struct(
            account.alias("account"), account_name(master, account).alias("name"), F.lit(source).alias("source"),
            F.lit(confidence).alias("confidence"), creditor_id.alias("creditor_id"), word.alias("keyword"),
        )

    def by_keyword(word: Column) -> Column:
        return F.when(word.isNotNull(), made(word["account"], "keyword_heuristic", "medium", none, word["keyword"])).otherwise(made(none, "unresolved", "low", none, none))

    return F.when(matched.isNotNull(), made(matched["account"], "creditor_master", "high", matched["creditor_id"], none)).otherwise(let(by_word, by_keyword))


def vat_account(rate: Column) -> Column:
    """The input VAT account of the nearest rate; of two as near, the first listed."""
    (best, found), *rest = VAT_ACCOUNTS
    near, account = F.abs(rate - F.lit(best)), F.lit(found)
    for at, name in rest:
        nearer = F.abs(rate - F.lit(at)) < near
        account, near = F.when(nearer, F.lit(name)).otherwise(account), F.least(near, F.abs(rate - F.lit(at)))
    return F.when(rate.isNotNull(), account)


def client_matches(recipient: Column, client_name: Column) -> Column:
    """Whether the recipient contains the client's name, in any case; an empty name is in every recipient."""
    return (F.coalesce(recipient, F.lit("")) != "") & F.coalesce(F.contains(F.lower(strip(recipient)), F.lower(strip(F.coalesce(client_name, F.lit(""))))), F.lit(False))
