"""The first of any number of keywords that a text contains.

Keywords become automata of states and failure links, with a full table from state and class of
character to state. Texts are cut into chunks that overlap by a keyword's length, and all chunks of a batch step
through a table together, a character at a time. A state knows the least rank of the keywords that end in it.

A table has ``STATES`` states at most; more keywords make more tables, in the order of ranks, of which
a text meets the next only while it has no hit. The keywords of a rule book are read to the driver, up to ``MOST`` characters.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = 200_000
MOST = 20_000_000
CHUNK = 256
#: Characters of texts that are scanned together.
TOGETHER = 1 << 20
NONE = np.iinfo(np.int32).max


class Automaton:
    """Keywords with ranks, as arrays."""

    def __init__(self, words: list[str], ranks: list[int]):
        self.longest = max(map(len, words), default=0)
        letters = sorted(set("".join(words)))
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        own = {c: i for i, c in enumerate(letters, 1)}
        children: list[dict[int, int]] = [{}]
        best = [NONE]
        for word, rank in zip(words, ranks, strict=True):
            state = 0
            for c in word:
                if own[c] not in children[state]:
                    children[state][own[c]] = len(children)
                    children.append({})
                    best.append(NONE)
                state = children[state][own[c]]
            best[state] = min(best[state], rank)
        self.best = np.array(best, np.int32)
        self.next = np.zeros((len(children), len(letters) + 1), np.int32)
        failure = np.zeros(len(children), np.int32)
        queue = deque([0])
        while queue:  # from short to long, so that a state's failure link is complete before the state
            state = queue.popleft()
            if state:
                self.next[state] = self.next[failure[state]]
                self.best[state] = min(self.best[state], self.best[failure[state]])
            for c, child in children[state].items():
                failure[child] = self.next[state, c] if state else 0
                self.next[state, c] = child
                queue.append(child)

    def first(self, texts: list[str]) -> np.ndarray:
        """The least rank of the keywords that each text contains; NONE without one."""
        out = np.full(len(texts), self.best[0], np.int32)
        letters = self.classes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum([len(t) for t in texts])
        sizes = np.diff(ends, prepend=0)
        chunks = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(texts)), chunks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = ends[owner] - sizes[owner] + place * CHUNK
        length = np.minimum(ends[owner], start + CHUNK + max(self.longest - 1, 0)) - start
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        state, found = np.zeros(len(owner), np.int32), np.full(len(owner), NONE, np.int32)
        going = len(owner)
        for j in range(int(length[0]) if len(length) else 0):
            going = int(np.searchsorted(-length[:going], -j, "left"))  # chunks of more than j characters come first
            state[:going] = self.next[state[:going], letters[start[:going] + j]]
            np.minimum(found[:going], self.best[state[:going]], out=found[:going])
        np.minimum.at(out, owner, found)
        return out


def automata(words: list[tuple[int, str]], states: int = STATES) -> list[Automaton]:
    """Automata of at most so many states (a longer keyword has one of its own), in the order of ranks."""
    parts: list[list[tuple[int, str]]] = [[]]
    held = 0
    for rank, word in sorted(words):
        if held and held + len(word) > states:
            parts.append([])
            held = 0
        parts[-1].append((rank, word))
        held += len(word)
    return [Automaton([w for _, w in p], [r for r, _ in p]) for p in parts if p]


def first_ranks(tables: list[Automaton], texts: list[str | None]) -> np.ndarray:
    """The least rank over all automata; NONE for a null text or one without a keyword."""
    out = np.full(len(texts), NONE, np.int32)
    rest = [i for i, t in enumerate(texts) if t is not None]
    for table in tables:
        found, begin = [], 0
        while begin < len(rest):
            end = size = begin
            size = 0
            while end < len(rest) and (size == 0 or size + len(texts[rest[end]]) <= TOGETHER):
                size += len(texts[rest[end]]) + 1
                end += 1
            found.append(table.first([texts[i] for i in rest[begin:end]]))
            begin = end
        if not found:
            break
        hit = np.concatenate(found)
        out[rest] = hit
        rest = [i for i, r in zip(rest, hit.tolist(), strict=True) if r == NONE]
    return out


def keyword_ranks(rules: DataFrame, text: Column) -> Column:
    """The least ``rank`` of the rules (rank int, keyword) whose keyword ``text`` contains; null without one."""
    size = rules.agg(F.sum(F.length("keyword"))).first()[0] or 0
    if size > MOST:
        raise ValueError(f"keywords have {size} characters, more than {MOST}")
    words = [(r["rank"], r["keyword"]) for r in rules.filter("keyword IS NOT NULL AND rank IS NOT NULL").select("rank", "keyword").collect()]  # up to MOST characters
    tables = rules.sparkSession.sparkContext.broadcast(automata(words))

    @F.pandas_udf("int")
    def ranks(texts: pd.Series) -> pd.Series:
        found = first_ranks(tables.value, [None if t is None or t is pd.NA else t for t in texts.tolist()])
        return pd.Series(found).astype("Int32").mask(found == NONE)

    return ranks(text)


def match_keywords(df: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with account and keyword of the first rule (rank, account, keyword) whose keyword the lower-cased text contains; null without one."""
    ranked = df.withColumn("_rank", keyword_ranks(rules, F.lower(F.col(f"`{text}`"))))
    named = rules.groupBy(F.col("rank").alias("_rank")).agg(F.min(F.struct("account", "keyword")).alias("_rule"))
    return ranked.join(named, "_rank", "left").select(*[F.col(f"`{c}`") for c in df.columns], F.col("_rule.account").alias("account"), F.col("_rule.keyword").alias("keyword"))
