"""Removal of repeated passages through prefix-free parsing.

A text is cut into phrases at triggers: the places whose rolling hash of eight bytes is the least (leftmost) of some
``REACH`` neighbouring ones. Whether a place is a trigger depends on the bytes around it alone, so equal passages are
cut alike, and every string of 400 bytes holds a trigger in its first ``REACH`` bytes. It is enough to order the
suffixes that start at triggers:

* **Parse.** A parse suffix is known by the hash of the 400 - REACH + 1 bytes from its trigger on, which any repeat
  through it shares. Suffixes that stand once in the corpus leave by an aggregation, without moving texts. Suffixes
  whose whole surroundings stand twice are repeats at once.
* **Dictionary.** What remains is decided by two pieces: the bytes before the trigger, read backwards, and the bytes
  after the shared ones. A task sorts both lists of pieces of its parse suffixes with the lengths of their common
  prefixes: the suffix arrays of left and right dictionary pieces.
* **Corpus order.** For each offset of a 400-byte string from its trigger, left classes (equal so many bytes back) and
  right classes (equal so many bytes on) are read off the two arrays; a pair of classes that holds two suffixes is a
  400-byte string that starts twice. The first and the last offset of a trigger give the bytes that it removes.

A parse suffix with very many different surroundings is never one group: its rows go on to narrower ranges of offsets,
which share more bytes, and at single offsets equal rows are counted by aggregation. Copies of whole texts are found by
their hash and moved once.

Result cases. Null text: empty, nothing removed. Texts under 400 bytes: nothing removed. Equal texts of 400 bytes or
more, repeated rows too: each other's copies, removed whole in all rows. A string that overlaps itself counts. Null
or repeated doc_id: rows are judged by their text alone. Very long texts: hashed in bounded runs. Ties of the hash: the
leftmost place. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import whole_text
from pricelake.session import BROADCAST_BYTES, cut_lineage, measured_bytes, small_side

LENGTH = 400
REACH = 128  # offsets from a string's start to its trigger
WINDOW = 8
RUN = 1 << 22  # positions hashed at once
CROWD = 20_000  # rows of one parse suffix that a task orders together
FREQUENT = 1_000  # places of a suffix from which on it is joined apart from the others
RANGES = (REACH, 16, 1)  # offsets that rows of a crowded suffix share, step by step


def triggers(data: bytes, length: int = LENGTH, reach: int = REACH):
    """Trigger positions of one text, ascending: the first trigger of every string of ``length`` bytes."""
    import numpy as np

    starts, found = len(data) - length + 1, []
    for first in range(0, max(0, starts), RUN):
        places = min(RUN, starts - first) + reach - 1
        raw = np.ndarray((places,), "<u8", data, first, (1,))
        rolling = raw * np.uint64(0x9E3779B97F4A7C15)
        rolling ^= rolling >> np.uint64(29)
        rolling *= np.uint64(0xBF58476D1CE4E5B9)
        least = (rolling & np.uint64(0xFFFFFFFF00000000)) | np.arange(places, dtype=np.uint64)
        span = 1
        while span < reach:  # least of twice as many places each time
            step = min(span, reach - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + first
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        found.append(at[1:] if found and at[0] == found[-1][-1] else at)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def text_rows(docs: DataFrame) -> DataFrame:
    """(text_key, data): hash and bytes of every text."""
    return docs.select(F.unhex(F.md5(whole_text())).alias("text_key"), whole_text().cast("binary").alias("data"))


def parse(texts: DataFrame, length: int, reach: int) -> DataFrame:
    """(text_key, pos, suffix, around, places, place): every trigger, the hash of its shared bytes and that of all its
    surroundings. Triggers of one text with equal surroundings are one row, with all ``places``; else those are null."""
    shared = length - reach + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows, firsts, suffixes, around, places = [], [], [], [], []
            for row, data in enumerate(batch.column(1)):
                data = data.as_py()
                at = triggers(data, length, reach)
                hashes = [digest(data[max(0, t - reach + 1) : t + length], min(t, reach - 1)) for t in at.tolist()]
                lists: list = [None] * len(at)
                if len(set(hashes)) < len(hashes):
                    hashes, first, which = np.unique(np.array(hashes, np.uint64), return_index=True, return_inverse=True)
                    order = np.argsort(which, kind="stable")
                    runs = np.split(at[order], np.flatnonzero(np.diff(which[order])) + 1)
                    lists = [r.tolist() if len(r) > 1 else None for r in runs]
                    hashes, at = hashes.tolist(), at[first]
                rows.append(np.full(len(at), row))
                firsts += at.tolist()
                suffixes += [digest(data[t : t + shared]) for t in at.tolist()]
                around += hashes
                places += lists
            rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(firsts, pa.int32()), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (suffixes, around)],
                 pa.array(places, pa.list_(pa.int32()))],
                ["text_key", "pos", "suffix", "around", "places"],
            )

    found = texts.mapInArrow(run, "text_key binary, pos int, suffix long, around long, places array<int>")
    return found.withColumn("place", F.xxhash64("text_key", "pos"))


def pieces(texts: DataFrame, length: int, reach: int) -> DataFrame:
    """(bucket, first, text_key, pos, crowded, left, right) for the wanted places of each text: left reads backwards."""
    shared = length - reach + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, data, wanted in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                for one in wanted:
                    at = one["pos"]
                    out.append((one["suffix"], 0, key, at, one["crowded"], data[max(0, at - reach + 1) : at][::-1], data[at + shared : at + length]))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    names = ["bucket", "first", "text_key", "pos", "crowded", "left", "right"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    return texts.mapInArrow(run, "bucket long, first int, text_key binary, pos int, crowded boolean, left binary, right binary")


def sorted_pieces(buckets, parts: list[bytes], width: int):
    """Order of byte strings within their buckets, as (order, common): ``common[i]`` is the common prefix of the i-th
    string in order and the one before it, -1 at the start of a bucket."""
    import numpy as np

    padded = np.zeros((len(parts), 8 + width), np.uint8)
    padded[:, :8] = np.ascontiguousarray(buckets).astype(">i8")[:, None].view(np.uint8)
    flat = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8)
    padded[:, 8:] = flat.reshape(len(parts), width)
    order = np.argsort(padded.view(f"S{8 + width}").ravel(), kind="stable")
    here = padded[order]
    differ = here[1:] != here[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), 8 + width) - 8
    return order, np.concatenate([[-1], np.maximum(common, -1)])


def repeated_offsets(buckets, first, left: list[bytes], right: list[bytes], width: int, reach: int):
    """(least, most) offset of each row at which its string stands at another row of the bucket; most is -1 for none.

    Offsets run over ``width`` numbers from ``first`` on: ``offset`` bytes of left and the other ``reach - 1 - offset``
    bytes of right make up the string with what the bucket shares.
    """
    import numpy as np

    n, whole = len(buckets), reach - 1
    arrays = [sorted_pieces(buckets, side, whole) for side in (left, right)]
    lengths = [np.array([len(p) for p in side]) for side in (left, right)]
    least, most = np.full(n, whole + 1), np.full(n, -1)
    for step in range(width):
        offset = first + step
        classes, fits = [], np.ones(n, bool)
        for (order, common), size, need in zip(arrays, lengths, (offset, whole - offset)):
            number = np.empty(n, np.int64)
            number[order] = np.cumsum(common < np.maximum(need[order], 0))
            classes.append(number)
            fits &= size >= need
        rows = np.flatnonzero(fits & (offset <= whole))
        both = classes[0][rows] * (n + 1) + classes[1][rows]
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        twice = rows[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(rows) else rows
        least[twice] = np.minimum(least[twice], offset[twice])
        most[twice] = np.maximum(most[twice], offset[twice])
    return least, most


def ordered(rows: DataFrame, width: int, reach: int) -> DataFrame:
    """(text_key, pos, least, most) for the rows of whole buckets that have a repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def solve(table: pa.Table) -> pa.RecordBatch:
            column = lambda name: table.column(name).to_numpy()
            least, most = repeated_offsets(
                column("bucket"), column("first").astype(np.int64), table.column("left").to_pylist(), table.column("right").to_pylist(), width, reach
            )
            found = pa.array(np.flatnonzero(most >= 0))
            keys = table.column("text_key").combine_chunks()
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.take(found).to_pylist(), pa.binary()), pa.array(column("pos")[found], pa.int32()), *[pa.array(x[found], pa.int32()) for x in (least, most)]],
                ["text_key", "pos", "least", "most"],
            )

        held = None  # the bucket that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            buckets = table.column("bucket").to_numpy()
            last = int(np.searchsorted(buckets, buckets[-1]))  # ascending within the task
            held = table.slice(last)
            if last:
                yield solve(table.slice(0, last))
        if held is not None:
            yield solve(held)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "text_key binary, pos int, least int, most int")


def narrower(rows: DataFrame, width: int, reach: int) -> DataFrame:
    """Rows once for each range of ``width`` offsets inside their range; a new bucket shares all that the range needs."""
    wider = RANGES[RANGES.index(width) - 1] if width in RANGES else reach
    lows = rows.withColumn("low", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + wider, F.lit(reach)) - 1, F.lit(width))))
    need = F.greatest(F.lit(reach - 1) - F.col("low") - (width - 1), F.lit(0))
    fits = lows.where((F.octet_length("left") >= F.col("low")) & (F.octet_length("right") >= need))
    bucket = F.xxhash64("bucket", "low", F.substring(F.col("left"), F.lit(1), F.col("low")), F.substring(F.col("right"), F.lit(1), need))
    return fits.select(bucket.alias("bucket"), F.col("low").alias("first"), "text_key", "pos", "left", "right")


def crowds(rows: DataFrame) -> DataFrame:
    """(bucket, n): the places in each bucket that has two or more."""
    return rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")


def of_texts(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose text is wanted, the others): while the list of wanted keys is small it is sent to the rows, so that only
    texts that matter are moved; otherwise all rows are given back to be joined."""
    keys = cut_lineage(wanted.select("text_key"))
    if measured_bytes(keys) > BROADCAST_BYTES:
        return rows, None
    return rows.join(F.broadcast(keys), "text_key", "left_semi"), rows.join(F.broadcast(keys), "text_key", "left_anti")


def repeated_spans(docs: DataFrame, length: int = LENGTH, reach: int = REACH, crowd: int = CROWD) -> DataFrame:
    """(text_key, start, stop): byte ranges, overlapping ones included, whose strings of ``length`` bytes stand twice.

    ``text_key`` is the md5 of the text; texts that stand in several rows have one range over everything.
    """
    texts = text_rows(docs)
    suffixes = parse(texts, length, reach)
    several = F.max(F.col("places").isNotNull())
    again = suffixes.groupBy("suffix").agg(F.min("place").alias("a"), F.max("place").alias("b"), several.alias("inside")).where("a <> b OR inside")
    # written first, so that both sides of the join are plain shuffles and a frequent suffix can be split
    some = cut_lineage(suffixes.join(cut_lineage(again.select("suffix")), "suffix", "left_semi"))

    # surroundings that stand twice are decided; the others need the pieces of all that share their parse suffix
    first = F.min(F.struct("text_key", "pos")).alias("at")
    known = some.groupBy("suffix", "around").agg(F.min("place").alias("a"), F.max("place").alias("b"), several.alias("inside"), first)
    known = cut_lineage(known.select("suffix", "around", F.expr("a <> b OR inside").alias("twice"), "at.text_key", "at.pos"))
    full = some.join(known.where("twice").select("suffix", "around"), ["suffix", "around"], "left_semi")
    full = full.select("text_key", F.explode(F.coalesce("places", F.array("pos"))).alias("pos"))
    results = [full.select("text_key", (F.col("pos") - (reach - 1)).alias("start"), (F.col("pos") + length).alias("stop"))]

    sizes = cut_lineage(known.groupBy("suffix").agg(F.count("*").alias("n"), F.max(~F.col("twice")).alias("open")).where("open AND n > 1"))
    sizes = sizes.select("suffix", "n", (F.col("n") > crowd).alias("crowded"))
    # a frequent suffix meets its row where its places lie; there is at most one such row for FREQUENT places
    frequent = small_side(sizes.where(F.col("n") > FREQUENT))
    rare = known.join(frequent.select("suffix"), "suffix", "left_anti").join(sizes.where(F.col("n") <= FREQUENT), "suffix")
    asked = known.join(frequent, "suffix").unionByName(rare)
    wanted = cut_lineage(asked.groupBy("text_key").agg(F.collect_list(F.struct("suffix", "pos", "crowded")).alias("wanted")))
    once = of_texts(texts, wanted)[0].groupBy("text_key").agg(F.first("data").alias("data"))  # equal texts combine before they move
    cut = cut_lineage(pieces(once.join(wanted, "text_key"), length, reach))

    def found(rows: DataFrame) -> DataFrame:
        return rows.select("text_key", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") + (length - F.col("least"))).alias("stop"))

    results.append(found(ordered(cut.where("NOT crowded"), reach, reach)))
    rows = cut.where("crowded")
    for width in (w for w in RANGES if w < reach):
        if rows.isEmpty():
            break
        rows = cut_lineage(narrower(rows, width, reach))
        n = cut_lineage(crowds(rows))
        if width == 1:  # all rows of a bucket are one string
            alike = rows.join(n, "bucket", "left_semi")
            results.append(found(alike.withColumns({"least": F.col("first"), "most": F.col("first")})))
            break
        results.append(found(ordered(rows.join(n.where(F.col("n") <= crowd), "bucket", "left_semi"), width, reach)))
        rows = cut_lineage(rows.join(n.where(F.col("n") > crowd), "bucket", "left_semi"))
    whole = texts.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1")
    results.append(whole.select("text_key", F.lit(0).alias("start"), F.lit(2**31 - 1).alias("stop")))
    everything = results[0]
    for part in results[1:]:
        everything = everything.union(part)
    return everything


def removal_report(docs: DataFrame, length: int = LENGTH, reach: int = REACH, kept: bool = False, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; with ``kept`` also the remaining bytes."""
    spans = repeated_spans(docs, length, reach, crowd).groupBy("text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = cut_lineage(spans)
    key: Column = F.unhex(F.md5(whole_text()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), whole_text().cast("binary").alias("data"))
    touched, others = of_texts(rows, spans)
    touched = touched.join(spans, "text_key", "left")
    if others is not None:
        touched = touched.unionByName(others.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))
    rows = touched.select("doc_id", "data", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            n_bytes, removed, n_spans, digests, rest = [], [], [], [], []
            for data, ranges in zip(batch.column(1), batch.column(2)):
                data = data.as_py()
                left, gone, count = data, 0, 0
                if ranges.is_valid and len(data) >= length:
                    fields = ranges.values
                    start, stop = (np.asarray(fields.field(c), dtype=np.int64) for c in (0, 1))
                    order = np.argsort(start, kind="stable")
                    start, stop = np.maximum(start[order], 0), np.minimum(np.maximum.accumulate(stop[order]), len(data))
                    opens = np.concatenate([[True], start[1:] > stop[:-1]])
                    begins, ends = start[opens], stop[np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(stop) - 1]])]
                    gone, count = int((ends - begins).sum()), len(begins)
                    borders = [0, *np.stack([begins, ends], 1).ravel().tolist(), len(data)]
                    left = b"".join([data[a:b] for a, b in zip(borders[::2], borders[1::2])])
                n_bytes.append(len(data))
                removed.append(gone)
                n_spans.append(count)
                digests.append(hashlib.sha256(left).hexdigest())
                rest.append(left)
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_bytes, removed, n_spans)], pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(rest, pa.binary())] * kept, names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * kept
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept)
