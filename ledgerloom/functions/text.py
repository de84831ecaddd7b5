"""Text functions: trimming, first matches, quality of extracted text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: An engine's text of at least this score needs no OCR.
CLEAN_SCORE = 80.0


#: White space in the sense of Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Line breaks besides \n.
BREAKS = r"\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
#: What other line breaks, white space beside blanks and variants of ASCII letters begin with in UTF-8; looked for byte by byte, which takes no pattern.
ODD = tuple(bytes.fromhex(x) for x in ("09", "0b", "0c", "0d", "1c", "1d", "1e", "c285", "c2a0", "e19a80", "e280", "e2819f", "e38080", "c5bf", "e284aa", "c4b0", "c4b1"))


def strip(c: Column) -> Column:
    """Without white space at both ends, in the sense of Unicode."""
    return F.btrim(c, F.lit(SPACE))


def strip_marks(c: Column, marks: str = " ,;:\t-") -> Column:
    """Without any of ``marks`` at both ends."""
    return F.btrim(c, F.lit(marks))


def present(c: Column) -> Column:
    """The value, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def found(c: Column) -> Column:
    """The same for what is costly: ``present`` may run it twice where it is one of several choices."""
    return let(c, lambda x: F.when(x != "", x))


#: Of four characters of two cases, other letters' variants, patterns that ignore case take each for one of these.
LIKE_ASCII = ("\u017f\u212a\u0131\u0130", "skii")


def folded(text: Column, odd: Column) -> Column:
    """The text in lower case, of as many characters: it holds an ASCII letter wherever a pattern that ignores case sees it."""
    return F.lower(F.when(odd, F.translate(text, *LIKE_ASCII)).otherwise(text))


def match_of(text: Column, low: Column, pattern: str) -> Column:
    """The first group of the pattern's first match, as ``regexp_extract`` gives it, or null where the text lacks what every match holds.

    ``low`` is the folded text. The text is searched from the first of the words that a match begins with; the character before it
    stays, so that bounds of words and lines are seen.
    """
    searched = low if pattern in P.FOLDED else text
    if pattern in P.HOLDS:
        searched = F.when(F.contains(low, F.lit(P.HOLDS[pattern])), searched)
    if pattern in P.BEGINS:
        words = P.BEGINS[pattern]
        held = [F.contains(low, F.lit(w)) for w in words]
        at = [F.when(h, F.instr(low, w)) for h, w in zip(held, words, strict=True)]
        searched = F.when(any_of(held), F.substr(searched, (F.least(*at) if len(at) > 1 else F.instr(low, words[0])) - 1))
    return F.regexp_extract(searched, P.FLAGS + pattern, 1)


def first_match(text: Column, low: Column, patterns: list[str]) -> Column:
    """The stripped first group, which is never empty, of the first pattern that matches anywhere; null if none does.

    Each pattern is run once, from the first of its words up to its first match, and only if none before it matched.
    """
    return F.coalesce(*[strip(found(match_of(text, low, p))) for p in patterns])


def is_odd(text: Column) -> Column:
    """Whether a text may have other line breaks than \\n, white space at an end of a line, or variants of ASCII letters."""
    blanks = [F.contains(text, F.lit(" \n")), F.contains(text, F.lit("\n ")), F.startswith(text, F.lit(" ")), F.endswith(text, F.lit(" "))]
    return F.coalesce(any_of([*blanks, *[F.contains(text.cast("binary"), F.lit(x)) for x in ODD]]), F.lit(False))


def lines(text: Column, odd: Column | None = None) -> Column:
    """The lines of a text, as an array without the empty piece behind a final line break; ``odd`` is ``is_odd`` where that is known."""
    even = F.when(is_odd(text) if odd is None else odd, F.regexp_replace(text, rf"\r\n|[{BREAKS}]", "\n")).otherwise(text)
    return let(F.split(even, "\n"), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keyword_hits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.QUALITY_WORDS))


def printable_ratio(text: Column) -> Column:
    """Share of letters, digits, white space and usual marks; 0 for an empty text."""
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, P.UNEXPECTED, "")) / F.length(text))


def quality_score(text: Column) -> Column:
    """How credible an extracted text is; -1 for null and blank ones."""
    score = keyword_hits(text) * 10 + printable_ratio(text) * 5 + F.least(F.length(text), F.lit(2000)) * F.lit(0.001).cast("double")
    return F.when(text.isNull() | (strip(text) == ""), F.lit(-1.0)).otherwise(score)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
