"""Byte-level BPE with forced-boundary splitting.

A merge can only ever build a token of the vocabulary, so two neighbouring bytes
that stand next to each other inside no token are never joined: between them lies
a certain cut. The table of such byte pairs comes from the vocabulary alone. A
text is first cut at spaces wherever the table has the byte before and the space
as such a pair and the character before is not white space; what lies between is split by the
vocabulary's own pattern, then at every forced cut, and the fragments are merged
independently and concatenated. Fragments and words recur, so each is merged once
per worker; the caches are bounded.

Null texts are empty and have no tokens. The special token's string, where it
occurs in a text, becomes that token, as the tokenizers library has it.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, with_columns

CACHE_ENTRIES = 150_000
_NONE = 1 << 30
#: Fixed value: the pattern of byte-level vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Cache(dict):
    """Values by key, made on demand. Of the two generations kept, the older goes when the newer is full."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key):
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        value = self[key] = self.older[key] if key in self.older else self.make(key)
        return value


class Bpe:
    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.token_bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.merges, self.made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << 16 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.joinable = np.zeros((256, 256), bool)
        for i in vocab.values():
            b = np.frombuffer(self.token_bytes[i], np.uint8)
            self.joinable[b[:-1], b[1:]] = True
        self.joins = self.joinable.tobytes()
        self.split = regex.compile(PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # bytes after which a space is no forced cut
        self.holds_space = frozenset(np.flatnonzero(self.joinable[:, 0x20]).tolist())
        self.fragments = _Cache(self.merge)
        self.first = _Cache(lambda word: self.word(word))
        self.later = _Cache(lambda word: self.word(" " + word))

    def merge(self, fragment: bytes) -> list[int]:
        """The ids of a fragment: repeatedly join the pair of lowest rank, leftmost first."""
        ids = [self.byte_id[b] for b in fragment]
        if len(ids) > 64:
            return self.merge_long(ids)
        merges, made = self.merges, self.made
        ranks = [merges.get(a << 16 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (rank := min(ranks)) < _NONE:
            i = ranks.index(rank)
            ids[i : i + 2] = [made[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = merges.get(ids[i - 1] << 16 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = merges.get(ids[i] << 16 | ids[i + 1], _NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for fragments of any length."""
        merges, made, n = self.merges, self.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank, i) for i in range(n - 1) if (rank := merges.get(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] is None or j >= n or merges.get(ids[i] << 16 | ids[j]) != rank:
                continue
            ids[i], ids[j] = made[rank], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := merges.get(ids[i] << 16 | ids[k])) is not None:
                    heapq.heappush(queue, (r, i))
            if (h := before[i]) >= 0 and (r := merges.get(ids[h] << 16 | ids[i])) is not None:
                heapq.heappush(queue, (r, h))
        return [x for x in ids if x is not None]

    def cut(self, piece: bytes) -> list[bytes]:
        """A piece split wherever two neighbouring bytes are inside no token."""
        joins = self.joins
        if len(piece) > 256:
            b = np.frombuffer(piece, np.uint8)
            at = (np.flatnonzero(~self.joinable[b[:-1], b[1:]]) + 1).tolist()
        else:
            at = [i for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False), 1) if not joins[a << 8 | b]]
        return [piece[i:j] for i, j in zip([0, *at], [*at, len(piece)], strict=True)] if at else [piece]

    def word(self, text: str) -> bytes | None:
        """Little-endian ids of a word; None where a space behind it would not be a cut."""
        if not text.strip(" ") or self.open_end(text):
            return None
        return self.piece(text)

    def open_end(self, text: str) -> bool:
        """Whether a space behind the text may share a token or a match of the pattern with its end."""
        return text[-1].isspace() or text[-1].encode()[-1] in self.holds_space

    def piece(self, text: str) -> bytes:
        parts = (text,) if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()) else self.split(text)
        return array("I", chain.from_iterable(self.fragments[f] for p in parts for f in self.cut(p.encode()))).tobytes()

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text:
            return b""
        words = text.split(" ")
        out = [self.first[words[0]], *map(self.later.__getitem__, words[1:])]
        if None not in out:
            return b"".join(out)
        held, whole = None, []
        for i, (word, ids) in enumerate(zip(words, out, strict=True)):
            if held is not None:
                held.append(word)
            elif ids is None:
                held = [word] if not i else ["", word]
            else:
                whole.append(ids)
            if held is not None and word and not self.open_end(word):
                whole.append(self.piece(" ".join(held)))
                held = None
        if held is not None and (rest := " ".join(held)):
            whole.append(self.piece(rest))
        return b"".join(whole)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.plain(p) for p in self.at_special.split(text))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[int, Bpe] = {}


def _loaded(vocabulary) -> Bpe:
    """One coder per Python worker and vocabulary, so that its caches last."""
    key = hash(vocabulary.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(vocabulary.value)
    return _LOADED[key]


def _schema(df: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), extra])


def _vocabulary(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """``docs`` with a binary column token_ids: little-endian unsigned 32-bit ids of the whole text.

    If ``decoded``, a column of that name has the text that the ids decode to.
    """
    vocabulary = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary)
        for batch in portions(batches):
            ids = [bpe.encode(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            new = {"token_ids": pa.array(ids, pa.binary())}
            if decoded:
                new["decoded"] = pa.array([bpe.decode(i) for i in ids], pa.string())
            yield with_columns(batch, **new)

    return docs.mapInArrow(run, _schema(docs.drop("token_ids", "decoded"), "token_ids binary" + ", decoded string" * decoded))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with a string column decoded, made from token_ids."""
    vocabulary = _vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary)
        for batch in portions(batches):
            ids = batch.column(batch.schema.get_field_index("token_ids")).to_pylist()
            yield with_columns(batch, decoded=pa.array([bpe.decode(i or b"") for i in ids], pa.string()))

    return encoded.mapInArrow(run, _schema(encoded.drop("decoded"), "decoded string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each row."""
    out = encode(docs.select("doc_id", "text"), path, decoded=True)
    return out.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
