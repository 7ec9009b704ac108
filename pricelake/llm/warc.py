"""WARC archives written and read as Spark jobs.

Every record is a gzip member of its own. The reader splits archives into byte ranges: a task looks for gzip magic in
its range, takes a candidate for a member only if its first bytes decode to a WARC record header, and owns the records
whose member starts inside the range; it reads on behind the range to finish the last one. From one member's end the
next begins, so nothing inside a member is looked at again.

Records with equal payloads of at least ``min_bytes`` are written once: the one with the largest page_id is a response,
the others are revisits that name it and keep its HTTP header, so the full payload's size and digest are known.

Result cases. Null html: empty payload. Null url: none is named. Null page_id: smaller than any id. Repeated rows: all
rows that share the largest page_id are responses. Very long payloads pass in one record. Empty table: no archive, no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import file_system, run_folder, spread
from pricelake.session import cut_lineage

MAGIC = b"\x1f\x8b\x08"
MIN_BYTES = 1000
RANGE_BYTES = 4 << 20
ARCHIVE_BYTES = 256 << 20
DATE = "2020-01-01T00:00:00Z"
PAGE_URN = "urn:page:"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = "path string, n_bytes long"
RECORDS = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "payload binary, path string, offset long"
)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, digest and, for repeats of a payload, ``refers_to``."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    long = rows.where(F.octet_length("html") >= min_bytes)
    shared = long.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1").drop("n")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "html", "digest", first.alias("refers_to"))


def record_bytes(page_id, url, html: str, digest: str, refers_to) -> bytes:
    """One gzip member with a response or revisit record."""
    payload = html.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "" if page_id is None else page_id
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", f"<{PAGE_URN}{name}>"), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{PAGE_URN}{refers_to}>"), ("WARC-Profile", IDENTICAL)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + pack.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, out, done, number = TaskContext.get(), None, 0, 0

    def closed():
        out.close()
        return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_bytes": [done]})

    for batch in batches:
        for row in batch.to_pylist():
            if out is None:
                fs, base = file_system(folder)
                fs.create_dir(base, recursive=True)
                name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                out, done = fs.open_output_stream(f"{base}/{name}", compression=None), 0
            done += out.write(record_bytes(**row))
            if done >= ARCHIVE_BYTES:
                yield closed()
                out, number = None, number + 1
    if out is not None:
        yield closed()


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages as archives; (path, n_bytes) of each. An archive counts only if its task ended well."""
    folder = folder or run_folder(pages.sparkSession, "warc")
    return cut_lineage(with_revisits(pages, min_bytes).mapInArrow(lambda batches: _write(batches, folder), ARCHIVES))


def _header(start: bytes) -> bool:
    """Whether a candidate's first bytes decode to a WARC record header."""
    try:
        return zlib.decompressobj(31).decompress(start, 8).startswith(b"WARC/1.")
    except zlib.error:
        return False


class _Window:
    """Forward reading of a file from ``at`` on, holding what is needed."""

    STEP = 1 << 20

    def __init__(self, file, at: int):
        self.file, self.at, self.held = file, at, b""

    def need(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.file.read_at(max(self.STEP, n - len(self.held)), self.at + len(self.held))):
            self.held += more
        return self.held

    def skip(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def _member(window: _Window) -> bytes:
    """Decode the member at the window's start and move behind it."""
    unpack, out, used = zlib.decompressobj(31), [], 0
    while not unpack.eof:
        data = window.need(used + 1)[used:]
        if not data:
            raise ValueError(f"archive ends inside the record at {window.at}")
        out.append(unpack.decompress(data))
        used += len(data)
    window.skip(used - len(unpack.unused_data))
    return b"".join(out)


def parse_record(data: bytes) -> dict:
    """Fields of one decoded record; digest and size of its full payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")

    def page(field: str):
        number = fields.get(field, "").strip("<>").removeprefix(PAGE_URN)
        return int(number) if number else None

    revisit = fields["warc-type"] == "revisit"
    if revisit:  # the payload itself is elsewhere
        lines = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
        size, digest = int(lines["Content-Length"]), base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return {
        "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": page("warc-refers-to"), "payload": None if revisit else payload,
    }


def records_in(file, first: int, last: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of the records that start in [first, last)."""
    window = _Window(file, first)
    while window.at < last:
        data = window.need(1024)
        if not data:
            return
        if data.startswith(MAGIC) and _header(data):
            at = window.at
            yield at, _member(window)
            continue
        found = data.find(MAGIC, 1)  # a magic cut by the window's end is found after the skip
        window.skip(found if found > 0 else max(1, len(data) - len(MAGIC) + 1))


def _read(batches: Iterator[pa.RecordBatch], columns: list[str], schema: pa.Schema, flush: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.to_pylist():
            fs, name = file_system(part["path"])
            rows, size = [], 0
            with fs.open_input_file(name) as file:
                for at, data in records_in(file, part["first"], part["last"]):
                    row = parse_record(data) | {"path": part["path"], "offset": at}
                    rows.append({c: row[c] for c in columns})
                    size += len(data)
                    if size >= flush:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(archives: DataFrame, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the archives (path, n_bytes), with only the columns wanted; one task reads about one byte range."""
    kinds = dict(x.strip().split(" ") for x in RECORDS.split(","))
    columns = columns or list(kinds)
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c, arrow[kinds[c]]) for c in columns])
    firsts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = archives.where("n_bytes > 0").select("path", F.explode(firsts).alias("first"), "n_bytes")
    ranges = ranges.select("path", "first", F.least(F.col("first") + range_bytes, "n_bytes").alias("last"))
    return spread(ranges, "path", "first").mapInArrow(lambda batches: _read(batches, columns, schema), ", ".join(f"{c} {kinds[c]}" for c in columns))
