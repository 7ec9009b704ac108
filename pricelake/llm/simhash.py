"""SimHash near-duplicates found with pivot distance tables.

Each distinct fingerprint gets a table of Hamming distances to many reference fingerprints. A base reference and the
64 references that differ from it in one bit are laid out in six blocks: the distances to a block's references minus
the one to the base depend on the bits of that block alone. Two fingerprints at most three bits apart therefore agree
in all coordinates of at least three blocks, so the coordinates of each choice of three blocks are a join key that
loses no pair. Fingerprints that meet under a key are compared by their distances to further, spread references;
a pair whose largest coordinate difference is above three is discarded, and the survivors are verified bit by bit.

A key shared by many fingerprints is cut into chunks, and each pair of chunks is a work unit of bounded size; a unit
returns a spanning forest of its links, never all pairs.

Result cases. Null or wordless text: fingerprint zero, linked like any other. Null doc_id: takes part in links, but
names no component unless no member has an id. Repeated rows: one result row each. Empty table: no rows. Extra columns
are ignored by ``near_duplicates`` and kept by ``one_per_group``, where the row with the smallest (doc_id, hash of all
columns) of each component stays, rows without id last; equal rows stay once. Ties: the smallest id or hash wins.
Very long texts: one row's fingerprint at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import all_columns, components, only, row_key, without
from pricelake.session import cut_lineage

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCKS = (11, 11, 11, 11, 10, 10)
BASE = 0x5DA1B3C96E27F084
CHUNK = 4096
# spread references: one multiplicative sequence, fixed by its step
SPREAD = [(k * 0x9E3779B97F4A7C15) & (2**64 - 1) for k in range(1, 17)]


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint of one text."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, ASCII spaces split
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE:
        hashes = digest(b" ".join(words), SEED)
    else:
        hashes = b"".join([digest(b" ".join(s), SEED) for s in zip(words, words[1:], words[2:])])
    n = len(hashes) // 8
    bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8), axis=1)
    over = bits.sum(axis=0, dtype=np.int64) * 2 > n
    return _signed(int.from_bytes(np.packbits(over).tobytes(), "big"))


def fingerprints(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(doc_id, row_key, fp) for every row; ``key`` takes the place of the hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "row_key", "fp"])

    return docs.select("doc_id", (row_key(docs) if key is None else key).alias("row_key"), "text").mapInArrow(run, "doc_id long, row_key long, fp long")


def pivot_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): one row for each choice of half of the blocks."""
    far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(BASE))))
    distances = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(BASE ^ (1 << i))))) for i in range(64)]
    rows = fps.select("fp", far.alias("d0"), F.array(*distances).alias("d"))
    blocks, first = [], 0
    for width in BLOCKS:
        total: Column = F.lit(0).cast("bigint")
        for i in range(width):
            nearer = (F.col("d")[first + i] < F.col("d0")).cast("bigint")  # coordinate difference is -1 or +1
            total = total + F.shiftleft(nearer, i)
        blocks.append(total)
        first += width
    rows = rows.select("fp", *[b.alias(f"b{i}") for i, b in enumerate(blocks)])
    keys = []
    for number, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)):
        key = F.lit(number).cast("bigint")
        for i in chosen:
            key = F.shiftleft(key, BLOCKS[i]) + F.col(f"b{i}")
        keys.append(key)
    return rows.select(F.explode(F.array(*keys)).alias("key"), "fp")


def forest(fps):
    """Links of a spanning forest over the fingerprints of one unit, as two int64 arrays."""
    import numpy as np

    fps = np.unique(np.asarray(fps, dtype=np.int64)).view(np.uint64)
    table = np.bitwise_count(fps[:, None] ^ np.array(SPREAD, dtype=np.uint64)[None, :]).astype(np.int8)
    left, sources, targets, queue = np.arange(len(fps)), [], [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            continue
        at = queue.pop()
        apart = np.abs(table[left] - table[at]).max(axis=1) if len(left) else np.empty(0)
        close = left[apart <= RADIUS]
        close = close[np.bitwise_count(fps[close] ^ fps[at]) <= RADIUS]
        if len(close):
            sources += [at] * len(close)
            targets += close.tolist()
            queue += close.tolist()
            left = np.setdiff1d(left, close, assume_unique=True)
    return fps[sources].view(np.int64), fps[targets].view(np.int64)


def links(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b) fingerprint pairs at most three bits apart, enough of them to connect all that are linked."""
    keyed = pivot_keys(fps)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, "key").withColumn("chunks", F.ceil(F.col("n") / chunk))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.array_remove(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1), mine)
    )
    units = met.select("key", "fp", mine.alias("mine"), F.explode(others).alias("other")).select(
        "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def out(pairs):
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held = np.empty((4, 0), np.int64)  # the unit that may go on in the next batch
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in range(4)])], axis=1)
            if not rows.shape[1]:
                continue
            new = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            starts = np.concatenate([[0], new, [rows.shape[1]]])
            yield out([forest(rows[3, s:e]) for s, e in zip(starts[:-2], starts[1:-1]) if e - s > 1])
            held = rows[:, starts[-2]:]
        if held.shape[1] > 1:
            yield out([forest(held[3])])

    return units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def rooted_fingerprints(rows: DataFrame, first: Column, chunk: int) -> DataFrame:
    """(fp, first, root) for every distinct fingerprint of ``rows``; ``first`` is an aggregate over its rows."""
    distinct = cut_lineage(rows.groupBy("fp").agg(first.alias("first")))
    groups = components(links(distinct.select("fp"), chunk))
    return distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest id among all reachable over links of three bits."""
    rows = cut_lineage(fingerprints(docs).select("doc_id", "fp"))
    rooted = rooted_fingerprints(rows, F.min("doc_id"), chunk)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each group: the row with the smallest id, then the smallest hash of all
    columns, stays; of rows equal in everything one does."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    rows = cut_lineage(fingerprints(docs, all_columns(docs)))
    rooted = rooted_fingerprints(rows, first, CHUNK)
    stay = rooted.groupBy("root").agg(F.min("first").alias("s")).select(F.col("s.doc_id").alias("__stay"), F.col("s.row_key").alias("__key"))
    counted = rows.groupBy("doc_id", "row_key").agg(F.count("*").alias("n"))
    chosen = counted["doc_id"].eqNullSafe(stay["__stay"]) & (counted["row_key"] == stay["__key"])
    judged = counted.join(stay, chosen, "left").select("doc_id", "row_key", "n", stay["__key"].isNotNull().alias("stays"))
    # those that go are few: they are sent to the documents, whose texts then stay where they are
    gone = judged.where("NOT stays OR n > 1").select("doc_id", "row_key")
    kept = without(docs, gone, all_columns(docs))
    equal = only(docs, judged.where("stays AND n > 1").select("doc_id", "row_key"), all_columns(docs))
    return kept.unionByName(equal.dropDuplicates())


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
