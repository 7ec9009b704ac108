"""Benchmark decontamination by pigeonhole edit matching.

A test item may stand in a document with up to ``rate`` of its characters edited. An item with budget e is cut into
e + 1 pieces; at most e edits leave one piece whole, so every occurrence holds an exact piece. Pieces are found with
one automaton per block of items, and each hit is verified with Myers' bit-parallel edit distance on the stretch of
text around it. A stretch of m pieces may hold m - 1 edits; of two halves that share those, one keeps to its own
budget. So a hit is verified on its piece's small neighbourhood first and on twice as much each time it passes, up to the
whole item: chance hits end after some twenty characters, and nothing within the budget is lost.

Items and documents are compared in lower case with every run of white space as one space, so line breaks do not hide a
passage. ``min_chars`` may leave out items that are too short to be evidence; by default every item counts.

Items come in blocks of bounded size; each block is one pass over the documents, whatever the number of items.

Result cases. Null or empty text on either side: no match. Null doc_id or item_id: reported as null. Repeated items or
documents: a row each. Very long texts are searched whole. Empty tables: no rows. Extra columns are ignored by
``leaks`` and kept by ``clean``, which decides each row by its own text, whatever rows share its id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import row_key, run_folder, running_sum, without
from pricelake.session import cut_lineage

RATE = 0.1
MIN_CHARS = 1
BLOCK_CHARS = 2_000_000
LEAKS = "doc_id long, item_id long, start long, stop long, distance int"
KEYED = f"row_key long, {LEAKS}"


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 parts of near equal length."""
    n = budget + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(s, item[s:e]) for s, e in zip(cuts, cuts[1:])]


def steps_up(n: int, length: int) -> list[list[tuple[int, int, int]]]:
    """For each of n pieces the stretches (start, stop, budget) to verify, from its first neighbours to the whole."""
    chains: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]

    def split(first: int, last: int) -> None:
        if last - first > 1:
            middle = (first + last + 1) // 2
            split(first, middle)
            split(middle, last)
            for k in range(first, last):
                chains[k].append((length * first // n, length * last // n, last - first - 1))

    split(0, n)
    return chains


@lru_cache(maxsize=50_000)
def letter_masks(pattern: str) -> dict[str, int]:
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    return at


def myers(pattern: str, text: str, budget: int, ends: Callable[[int], bool] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the best place in ``text`` that ends a match of the whole pattern within the budget; the
    first such end. One machine word of any length holds a column of the distance matrix. With ``ends`` the match begins
    where ``text`` does and ends where ``ends`` allows."""
    m, first = len(pattern), 0 if ends is None else 1
    mask, top, at = (1 << m) - 1, 1 << (m - 1), letter_masks(pattern)
    plus, minus, score, best = mask, 0, m, None
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & mask, plus & xh
        score += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1 | first) & mask, down << 1 & mask
        plus, minus = down | ~(xv | up) & mask, up & xv
        if score <= budget and (best is None or score < best[0]) and (ends is None or ends(j + 1)):
            best = (score, j + 1)
    return best


def border(text: str, at: int) -> bool:
    """Whether no word goes on across this place."""
    return at <= 0 or at >= len(text) or not (text[at - 1].isalnum() and text[at].isalnum())


class Matcher:
    """The pieces of one block of items; ``find`` gives each item's best place in a text."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick

        self.items, places = [], {}
        for item_id, text in items:
            budget = int(len(text) * rate)
            self.items.append((item_id, text, budget, steps_up(budget + 1, len(text))))
            for k, (offset, piece) in enumerate(pieces(text, budget)):
                places.setdefault(piece, []).append((len(self.items) - 1, k, offset))
        self.machine = ahocorasick.Automaton()
        for piece, where in places.items():
            self.machine.add_word(piece, (len(piece), where))
        if places:
            self.machine.make_automaton()
        self.empty = not places

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item_id, start, stop, distance) of items that stand in the normalised text."""
        if self.empty or not text:
            return []
        hits: dict[int, dict[int, list[int]]] = {}
        for end, (length, where) in self.machine.iter(text):
            for item, k, offset in where:
                hits.setdefault(item, {}).setdefault(end + 1 - length - offset, []).append(k)
        found = []
        for item, starts in hits.items():
            best = self._best(text, item, starts)
            if best:
                found.append((self.items[item][0], *best))
        return found

    def _best(self, text: str, item: int, starts: dict[int, list[int]]) -> tuple[int, int, int] | None:
        _, pattern, budget, chains = self.items[item]
        for start in sorted(starts):
            stop = start + len(pattern)
            if start >= 0 and text.startswith(pattern, start) and border(text, start) and border(text, stop):
                return start, stop, 0  # the commonest case needs no matrix
        best, passed = None, -1
        for start in sorted(starts):
            if start + len(pattern) + budget <= passed:
                continue
            if any(self._passes(text, pattern, start, chains[k]) for k in starts[start]):
                low, passed = max(0, start - budget), start + len(pattern) + 2 * budget
                if myers(pattern, text[low:passed], budget):
                    best = self._whole_words(text, pattern, budget, low, min(len(text), start + 2 * budget), best)
        return best

    @staticmethod
    def _whole_words(text: str, pattern: str, budget: int, low: int, high: int, best: tuple[int, int, int] | None) -> tuple[int, int, int] | None:
        """Best match that begins at a word border from ``low`` to ``high`` and ends at one."""
        for start in range(low, high + 1):
            if border(text, start) and (best is None or best[2]):
                most = budget if best is None else best[2] - 1
                hit = myers(pattern, text[start : start + len(pattern) + budget], most, lambda n: border(text, start + n))  # noqa: B023
                if hit:
                    best = (start, start + hit[1], hit[0])
        return best

    @staticmethod
    def _passes(text: str, pattern: str, start: int, chain: list[tuple[int, int, int]]) -> bool:
        for first, last, budget in chain:
            if not myers(pattern[first:last], text[max(0, start + first - budget) : max(0, start + last + budget)], budget):
                return False
        return True


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[int | None, str]], rate: float) -> Iterator[pa.RecordBatch]:
    matcher, schema = Matcher(items, rate), pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("distance", pa.int32())])
    for batch in batches:
        rows = [
            (key, doc_id, *hit)
            for key, doc_id, text in zip(*(batch.column(c).to_pylist() for c in range(3)))
            for hit in matcher.find(normal(text))
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)


def item_blocks(items: DataFrame, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of bounded size, each fetched when the one before is done with."""
    known = items.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").withColumn("n", F.length("text"))
    lined = cut_lineage(running_sum(known, [], ["item_id", "text"], "n", "upto").withColumn("block", F.floor((F.col("upto") - 1) / block_chars)))
    last = lined.agg(F.max("block")).first()[0]
    for number in range((last if last is not None else -1) + 1):
        rows = [(r["item_id"], normal(r["text"])) for r in lined.where(F.col("block") == number).select("item_id", "text").toLocalIterator()]
        if block := [(i, t) for i, t in rows if len(t) >= min_chars]:
            yield block


def keyed_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``leaks`` and the row_key of the document."""
    rows = docs.select(row_key(docs).alias("row_key"), F.col("doc_id").cast("long"), "text")
    folder = run_folder(docs.sparkSession, "leaks")
    # each block's hits are written before the next block is read: one at a time is on the driver and in a plan
    docs.sparkSession.createDataFrame([], KEYED).write.parquet(folder)
    for block in item_blocks(items, min_chars, block_chars):
        rows.mapInArrow(lambda batches: _search(batches, block, rate), KEYED).write.mode("append").parquet(folder)  # noqa: B023
    return docs.sparkSession.read.schema(KEYED).parquet(folder)


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start, stop, distance: a row for each item that stands in a document, at its best place in
    the normalised text."""
    return keyed_leaks(docs, items, rate, min_chars, block_chars).drop("row_key")


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in which no item stands."""
    bad = keyed_leaks(docs, items, rate).select("doc_id", "row_key")
    return without(docs, bad, row_key(docs))
