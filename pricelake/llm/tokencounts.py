"""Token counts by unigram forward scores, shared over the prefixes of a trie.

A text is cut into words; a word with the space mark in front is a pre-token. Each distinct new pre-token of a batch
enters a trie, which is walked in depth: the best forward score of every prefix and its number of pieces are computed
once, from the scores of shorter prefixes, for all pre-tokens below it. Pre-tokens in sorted order visit the trie in just
that way, so only the path from the root is held. The number at a pre-token's end is stored, and a document's
count is the sum over its words. There is no shuffle; a task holds a bounded store of counts, which only saves work.

Pieces come from a public vocabulary file in order of frequency; a piece of rank r has the probability Zipf's law gives
it. A character no piece covers costs its UTF-8 bytes, one byte piece each. Of equally good cuts the shorter counts.

Result cases. Null, empty or blank text: no words, no tokens. Null doc_id, repeated rows: a result row each. Very long
texts and words: whole. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_COST = 10.0
STORED = 1_000_000  # pre-tokens whose counts a Python worker keeps
COUNTS = "doc_id long, n_words long, n_tokens long"


def piece_scores(path: str) -> dict[str, float]:
    """Log-probabilities of the pieces in a SentencePiece vocabulary file, by Zipf's law of their rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {piece: -math.log(r + 1) - total for r, piece in enumerate(pieces)}


class PrefixScores:
    """Forward scores along one path of the trie, and the counts stored at the ends of pre-tokens."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_COST
        self.stored: dict[str, int] = {}

    def add(self, words: set[str]) -> None:
        """Store the counts of words that are new."""
        if len(self.stored) > STORED:
            self.stored.clear()
        get, longest, unknown = self.scores.get, self.longest, self.unknown
        path, best, count = "", [0.0], [0]
        for word in sorted(words.difference(self.stored)):
            node = MARK + word
            shared = len(commonprefix((path, node)))
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(node) + 1):
                top = best[end - 1] + unknown
                n = count[end - 1] + len(node[end - 1].encode("utf-8", "surrogatepass"))
                for start in range(max(0, end - longest), end):
                    score = get(node[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and count[start] + 1 < n:
                            top, n = score, count[start] + 1
                best.append(top)
                count.append(n)
            path = node
            self.stored[word] = count[-1]


_loaded: dict[str, PrefixScores] = {}  # kept while a Python worker is reused


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _loaded:
        _loaded[path] = PrefixScores(piece_scores(path))
    trie = _loaded[path]
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            # bytes split at the ASCII blanks alone
            lists = [[w.decode("utf-8", "surrogatepass") for w in t.encode("utf-8", "surrogatepass").split()] if t and not t.isascii() else (t or "").split() for t in some.column(1).to_pylist()]
            trie.add(set().union(*lists))
            get = trie.stored.__getitem__
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array([sum(map(get, x)) for x in lists], pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens for every row; ``path`` names the vocabulary file on every machine."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _count(batches, path), COUNTS)
