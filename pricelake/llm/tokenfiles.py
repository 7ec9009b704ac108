"""Token ids in binary files with Elias-Fano encoded document boundaries.

A file holds the ids of consecutive documents in one array of 2- or 4-byte numbers, followed by two monotone lists in
Elias-Fano form: the position where each document ends, and the document ids. A list of n numbers below u takes
about 2 + log2(u / n) bits a number: the low bits are packed, the high bits are a unary bit vector. Every 512th set
bit is sampled, so a select reads a few bytes from the sample on; there is no table of 64-bit offsets.

    ids | ends.low | ends.high | ends.sample | docs.low | docs.high | docs.sample | trailer

Documents go to files by ranges of doc_id; one manifest row per file is all that leaves the tasks, and a file counts
only if its task ended well (names hold the attempt). Slices of a file are read back by separate tasks.

Result cases. Null text: as empty, the end id alone. Null doc_id: first of all, the ids read back as null. Repeated
ids or rows: each is a document; ties stand by the hash of the text, so rows without id make many files and reruns
agree. Very long texts: encoded one at a time. Empty table: no file, no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import file_system, run_folder, running_sum, spread
from pricelake.session import cut_lineage

END_ID = 0
SAMPLE = 512
CACHED_WORDS = 1_000_000  # some 30 MB in a Python worker
LEARN_WORDS = 1000
BATCH_ROWS = 4000
SLICE_DOCS = 4096
READ_IDS = 4_000_000
TRAILER = struct.Struct("<8sQQQqBBB5x")
MAGIC = b"TOKEF001"


# ---- Elias-Fano lists

def low_bits(n: int, top: int) -> int:
    return max(0, (max(1, top) // max(1, n)).bit_length() - 1)


def ef_encode(values, top: int) -> tuple[bytes, bytes, bytes]:
    """Low bits, high bits and select samples of a non-decreasing list of numbers up to ``top``."""
    import numpy as np

    v = np.asarray(values, dtype=np.int64)
    n, width = len(v), low_bits(len(v), top)
    low = ((v[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    at = (v >> width) + np.arange(n)
    high = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
    high[at] = 1
    return (
        np.packbits(low.ravel(), bitorder="little").tobytes(),
        np.packbits(high, bitorder="little").tobytes(),
        at[::SAMPLE].astype("<u4" if n == 0 or at[-1] < 2**32 else "<u8").tobytes(),
    )


def ef_select(read, parts: list[tuple[int, int]], n: int, top: int, first: int, last: int):
    """Numbers ``first`` to ``last`` (exclusive) of a list; ``read(offset, length)`` gives bytes of the file."""
    import numpy as np

    (low_at, _), (high_at, high_len), (sample_at, sample_len) = parts
    if last <= first:
        return np.empty(0, np.int64)
    step = sample_len // -(-n // SAMPLE)
    block, end_block = first // SAMPLE, min(-(-n // SAMPLE), (last - 1) // SAMPLE + 2)
    samples = np.frombuffer(read(sample_at + block * step, (end_block - block) * step), dtype=f"<u{step}").astype(np.int64)
    from_byte = int(samples[0]) // 8
    to_byte = int(samples[-1]) // 8 + 1 if (last - 1) // SAMPLE + 1 < end_block else high_len
    bits = np.unpackbits(np.frombuffer(read(high_at + from_byte, to_byte - from_byte), np.uint8), bitorder="little")
    ones = np.flatnonzero(bits) + from_byte * 8
    ones = ones[ones >= samples[0]][first - block * SAMPLE : last - block * SAMPLE]
    high = ones - np.arange(first, last)
    width = low_bits(n, top)
    if not width:
        return high
    start, stop = first * width, last * width
    raw = np.unpackbits(np.frombuffer(read(low_at + start // 8, -(-stop // 8) - start // 8), np.uint8), bitorder="little")
    low = raw[start % 8 : start % 8 + (last - first) * width].reshape(-1, width).astype(np.int64)
    return (high << width) | (low << np.arange(width)).sum(axis=1)


# ---- encoding with a cache of words

class WordEncoder:
    """Ids of whole texts by the tokenizers library, as one array of ``width``-byte numbers.

    A byte-level tokenizer cuts a text before every single space and line feed, whatever stands around them, so ids of
    such pieces can be kept and joined. Other texts (runs of spaces, other blanks, added tokens) and other
    tokenizers are encoded whole. The cache is bounded and only saves work. Words, ids and places are Arrow arrays, so
    a kept word takes some thirty bytes and a batch is looked up and joined without a step of Python per word.
    """

    BLANKS = "\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    ODD = rf"[ \n][ \n]|\A[ \n]|[ \n]\z|[{BLANKS}]"
    STOPPED = r"\pL[.,]\z"

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel units
        self.np, self.tokenizer = np, Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not spec.get("normalizer") and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        vocab = self.tokenizer.get_vocab()
        self.width = 2 if max(vocab.values(), default=0) < 2**16 else 4
        self.kind = f"<u{self.width}"
        if self.by_piece:
            self.starts = np.zeros(max(vocab.values()) + 1, bool)
            for piece, number in vocab.items():
                self.starts[number] = piece.startswith("Ġ")
            self.feed = self.encode("\n")
            self._forget()

    def encode(self, text: str):
        return self.np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def _forget(self) -> None:
        # the first two are no pieces, which hold no space: ids of a stop behind a word
        self.known, self.lists = pa.array([" .", " ,"]), self._lists([self.encode("."), self.encode(",")])

    def _lists(self, parts: list) -> pa.ListArray:
        """Id arrays as one list array."""
        np = self.np
        return self._cut(np.concatenate([np.empty(0, self.kind), *parts]), np.fromiter(map(len, parts), np.int64, len(parts)))

    def _cut(self, ids, lengths) -> pa.ListArray:
        ends = self.np.concatenate([[0], self.np.cumsum(lengths)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))

    def _plain(self, texts: pa.StringArray):
        """Which texts can be cut into pieces."""
        odd = pc.or_kleene(pc.match_substring_regex(texts, self.ODD), pc.equal(texts, ""))
        for token in self.added:
            odd = pc.or_kleene(odd, pc.match_substring(texts, token))
        return pc.invert(odd).fill_null(False).to_numpy(zero_copy_only=False)

    def _learn(self, words: list[str], mark: str) -> pa.ListArray:
        """Ids of words that each stand behind ``mark``."""
        np, ids, lengths = self.np, [], []
        parts = [words[at : at + LEARN_WORDS] for at in range(0, len(words), LEARN_WORDS)]
        lines = self.tokenizer.encode_batch_fast([mark + mark.join(some) for some in parts], add_special_tokens=False)
        for some, line in zip(parts, lines):
            found = np.array(line.ids, dtype=self.kind)
            begin = np.flatnonzero(self.starts[found] if mark == " " else found == self.feed[0])
            if len(begin) != len(some):  # not expected; then word by word
                each = [self.encode(mark + w) for w in some]
                found, begin = np.concatenate(each), np.cumsum([0, *map(len, each)])[:-1]
            ids.append(found)
            lengths.append(np.diff(begin, append=len(found)))
        return self._cut(np.concatenate([np.empty(0, self.kind), *ids]), np.concatenate([np.empty(0, np.int64), *lengths]))

    def _places(self, words: pa.StringArray):
        """Places of distinct words in the cache; new ones are learnt."""
        np = self.np
        if len(self.known) > CACHED_WORDS:
            self._forget()
        at = pc.index_in(self.known, value_set=words)  # words of a batch are fewer than those kept
        kept = at.is_valid().to_numpy(zero_copy_only=False)
        places = np.full(len(words), -1, np.int32)
        places[at.drop_null().to_numpy()] = np.flatnonzero(kept)
        is_line = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        for lines, mark in ((False, " "), (True, "\n")):
            new = np.flatnonzero((places < 0) & (is_line == lines))
            if len(new):
                some = words.take(pa.array(new))
                learnt = self._learn((pc.utf8_slice_codeunits(some, 1) if lines else some).to_pylist(), mark)
                places[new] = len(self.known) + np.arange(len(new))
                self.known, self.lists = pa.concat_arrays([self.known, some]), pa.concat_arrays([self.lists, learnt])
        return places

    def _pieces(self, pieces: pa.StringArray) -> pa.ListArray:
        """Ids of distinct pieces; a stop behind a letter is a piece of its own."""
        np = self.np
        stopped = pc.match_substring_regex(pieces, self.STOPPED)
        ends, whole = pieces.filter(stopped), pc.invert(stopped)
        bases = pa.concat_arrays([pieces.filter(whole), pc.utf8_slice_codeunits(ends, 0, -1)]).dictionary_encode()
        whole = whole.to_numpy(zero_copy_only=False)
        places = self._places(bases.dictionary)[bases.indices.to_numpy()]
        steps = np.where(whole, 1, 2)
        first = np.cumsum(steps) - steps
        order = np.empty(int(steps.sum()), np.int32)
        order[first[whole]], order[first[~whole]] = np.split(places, [len(pieces) - len(ends)])
        order[first[~whole] + 1] = pc.ends_with(ends, ",").to_numpy(zero_copy_only=False)
        ids = self.lists.take(pa.array(order))
        return pa.ListArray.from_arrays(ids.offsets.take(pa.array(np.append(first, len(order)))), ids.values)

    def encode_all(self, texts: pa.Array, end_id: int):
        """(ids, counts): ids of all texts one after another, ``end_id`` behind each, and how many each has. Null: empty."""
        np = self.np
        if not len(texts):
            return np.empty(0, self.kind), np.empty(0, np.int64)
        texts = texts.cast(pa.string())
        plain = self._plain(texts) if self.by_piece else np.zeros(len(texts), bool)
        odd = np.flatnonzero(~plain & pc.not_equal(texts, "").fill_null(False).to_numpy(zero_copy_only=False))
        lists = self._lists([np.array([end_id], self.kind), *(self.encode(t) for t in texts.take(pa.array(odd)).to_pylist())])
        steps = np.ones(len(texts), np.int64)
        steps[odd] += 1
        if plain.any():
            # every piece begins after a space or with a line feed; the first gets one that is taken off below
            some = texts.filter(pa.array(plain))
            split = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(some, "\n", " \n"), ""), " ")
            pieces = split.flatten().dictionary_encode()
            steps[plain] += pc.list_value_length(split).to_numpy()
            codes = pieces.indices.to_numpy() + len(lists)
            lists = pa.concat_arrays([lists, self._pieces(pieces.dictionary)])
        last = np.cumsum(steps) - 1
        order = np.full(int(steps.sum()), -1, np.int32)
        order[last], order[last[odd] - 1] = 0, 1 + np.arange(len(odd))
        if plain.any():
            order[order < 0] = codes
        joined = lists.take(pa.array(order))
        at, ids = joined.offsets.to_numpy().astype(np.int64), joined.values.to_numpy()
        counts = at[last + 1] - at[last - steps + 1]
        if plain.any():
            kept = np.ones(len(ids), bool)
            for k in range(len(self.feed)):
                kept[at[(last - steps + 1)[plain]] + k] = False
            ids, counts = ids[kept], counts - plain * len(self.feed)
        return ids, counts


_encoders: dict[str, WordEncoder] = {}  # kept while a Python worker is reused


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ---- files

MANIFEST = "shard int, path string, n_docs long, n_ids long"


def _write(batches: Iterator[pa.RecordBatch], path: str, folder: str, end_id: int) -> Iterator[pa.RecordBatch]:
    import numpy as np
    from pyspark import TaskContext

    task = TaskContext.get()
    words, out, ends, docs_seen, nulls, total = encoder(path), None, [], [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            some = batch.slice(at, BATCH_ROWS)
            if out is None:
                fs, base = file_system(folder)
                name = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(name)
            ids, counts = words.encode_all(some.column(1), end_id)
            out.write(memoryview(ids).cast("B"))
            ends.append(total + np.cumsum(counts))
            total = int(ends[-1][-1])
            docs_seen.append(np.array(some.column(0).drop_null()))  # a copy: a part of the batch would hold its texts
            nulls += some.column(0).null_count
    if out is None:
        return
    ids = np.concatenate(docs_seen)
    low = int(ids[0]) if len(ids) else 0
    numbers, n = ids - low, sum(map(len, ends))
    sizes = [*ef_encode(np.concatenate(ends), total), *ef_encode(numbers, int(numbers[-1]) if len(numbers) else 0)]
    for part in sizes:
        out.write(part)
    out.write(struct.pack("<7Q", int(numbers[-1]) if len(numbers) else 0, *map(len, sizes)))
    out.write(TRAILER.pack(MAGIC, n, total, nulls, low, words.width, 0, 0))
    out.close()
    pa.default_memory_pool().release_unused()  # the worker waits for other tasks
    yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "n_docs": [n], "n_ids": [total]})


def write_files(docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids in ascending doc_id order; the manifest, one row per file."""
    folder = folder or run_folder(docs.sparkSession, "tokens")
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return cut_lineage(ordered.mapInArrow(lambda batches: _write(batches, path, folder, end_id), MANIFEST))


class TokenFile:
    """One file of ``write_files``: ``docs(a, b)``, ``ends(a, b)`` and ``ids(from, to)`` read only what they need."""

    def __init__(self, address: str):
        fs, name = file_system(address)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        tail = self.read(size - TRAILER.size - 56, TRAILER.size + 56)
        magic, self.n, self.total, self.nulls, self.low, self.width, _, _ = TRAILER.unpack(tail[56:])
        if magic != MAGIC:
            raise ValueError(f"not a token file: {address}")
        self.top, *lengths = struct.unpack("<7Q", tail[:56])
        at, self.parts = self.total * self.width, []
        for length in lengths:
            self.parts.append((at, length))
            at += length

    def read(self, at: int, length: int) -> bytes:
        return self.file.read_at(length, at) if length else b""

    def ends(self, first: int, last: int):
        return ef_select(self.read, self.parts[:3], self.n, self.total, first, last)

    def docs(self, first: int, last: int) -> list[int | None]:
        known = self.n - self.nulls
        a, b = max(0, first - self.nulls), max(0, last - self.nulls)
        return [None] * max(0, min(last, self.nulls) - first) + (ef_select(self.read, self.parts[3:], known, self.top, a, b) + self.low).tolist()

    def ids(self, start: int, stop: int):
        import numpy as np

        return np.frombuffer(self.read(start * self.width, (stop - start) * self.width), dtype=f"<u{self.width}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        for row in batch.to_pylist():
            file, first, last = TokenFile(row["path"]), row["first"], row["last"]
            ends = file.ends(max(0, first - 1), last)
            if first == 0:
                ends = np.concatenate([[0], ends])
            crcs, k = [], 0
            while k < last - first:  # a bounded number of ids at once
                stop = max(k + 1, int(np.searchsorted(ends, ends[k] + READ_IDS, side="right")) - 1)
                ids = file.ids(int(ends[k]), int(ends[stop])).astype("<u4")
                crcs += [zlib.crc32(ids[ends[i] - ends[k] : ends[i + 1] - ends[k]].tobytes()) for i in range(k, stop)]
                k = stop
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(file.docs(first, last), pa.int64()), "start": pa.array(ends[:-1] + row["before"], pa.int64()),
                "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
            })


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, all from the files; start counts over all files."""
    placed = running_sum(manifest, [], ["shard"], "n_ids", "upto")
    firsts = F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(SLICE_DOCS).cast("long"))
    slices = placed.select("path", (F.col("upto") - F.col("n_ids")).alias("before"), F.explode(firsts).alias("first"), "n_docs")
    slices = slices.select("path", "before", "first", F.least(F.col("first") + SLICE_DOCS, "n_docs").alias("last"))

    return spread(slices, "path", "first").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Write the documents' token files and read them back."""
    return read_documents(write_files(docs, path))
