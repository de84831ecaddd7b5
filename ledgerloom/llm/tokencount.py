"""Token counts under a unigram vocabulary, by dynamic programming over a trie.

A text's pre-tokens are its words, each with the mark that the vocabulary puts before
a word. The best segmentation of a prefix doesn't depend on what follows, so
pre-tokens go into a trie whose nodes hold the best forward score of their prefix
and the tokens it takes; a new pre-token computes only the nodes that no other has
reached, and its last node's count is stored for every later occurrence. Each Python
worker keeps one trie of bounded size across the documents that Spark gives it.

Scores are the logarithms of probabilities that fall with a token's rank in the
vocabulary. A character that no token covers counts as its UTF-8 bytes. Equal scores
prefer the longer last token. Null texts and texts of white space have no tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import portions, with_columns

#: Fixed value: what marks the beginning of a word in the vocabulary.
MARK = "▁"
BYTE_SCORE = -20.0
MAX_NODES = 400_000
MAX_WORDS = 250_000
#: Prefixes and words longer than this aren't kept.
SHARED = 64


def unigram_scores(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with rank-based log-probabilities, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / (k + 1) for k in range(len(ids))))
    return {model.id_to_piece(i): -math.log(k + 1) - total for k, i in enumerate(ids)}


class Trie(dict):
    """Token counts by pre-token; one that is new walks the trie of prefixes, which holds their scores and counts."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        #: Ends of tokens: where a text's end is none of them, no token ends with it or with anything longer.
        self.ends = {piece[k:] for piece in scores for k in range(len(piece))}
        self.longest = max(map(len, scores), default=1)
        self.older: dict[str, int] = {}
        self.root: list = [{}, 0.0, 0]
        self.nodes = 1

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.older = dict(self)
            self.clear()
        count = self.older[word] if word in self.older else self.walk(MARK + word)
        if len(word) <= SHARED:
            self[word] = count
        return count

    def walk(self, text: str) -> int:
        """Tokens of the best segmentation, computing the nodes that no text before has reached."""
        if self.nodes > MAX_NODES:
            self.root, self.nodes = [{}, 0.0, 0], 1
        node, path = self.root, [self.root]
        for end, char in enumerate(text, 1):
            child = node[0].get(char)
            if child is None:
                child = self.extend(text, end, path)
                if end <= SHARED:  # what long words share is near their root
                    node[0][char] = child
                    self.nodes += 1
            path.append(child)
            node = child
            if end > 4096 and len(path) > 8192:
                del path[:4096]
        return node[2]

    def extend(self, text: str, end: int, path: list[list]) -> list:
        """The node of text[:end]; ``path`` has those of the prefixes before it, the last one nearest."""
        scores, ends = self.scores, self.ends
        before = path[-1]
        piece = text[end - 1]
        score = scores.get(piece)
        if score is None:
            size = len(piece.encode("utf-8", "surrogatepass"))
            best, tokens = before[1] + BYTE_SCORE * size, before[2] + size
        else:
            best, tokens = before[1] + score, before[2] + 1
        if piece in ends:
            for length in range(2, min(self.longest, end) + 1):
                piece = text[end - length : end]
                if piece not in ends:
                    break
                score = scores.get(piece)
                if score is not None:
                    before = path[-length]
                    if before[1] + score >= best:
                        best, tokens = before[1] + score, before[2] + 1
        return [{}, best, tokens]


_TRIES: dict[int, Trie] = {}


def token_counts(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each row's whole text."""
    held = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(frozenset(held.value.items()))
        if key not in _TRIES:
            _TRIES.clear()
            _TRIES[key] = Trie(held.value)
        count = _TRIES[key].__getitem__
        for batch in portions(batches):
            words = [(t or "").split() for t in batch.column(1).to_pylist()]
            yield with_columns(batch.drop_columns(["text"]), n_pretokens=pa.array(map(len, words), pa.int64()), n_tokens=pa.array([sum(map(count, w)) for w in words], pa.int64()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")


def op6_token_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), unigram_scores(public_tokenizers.path("piece_bpe_32k.model")))
