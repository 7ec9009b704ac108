"""Secret scans: fixed patterns, and strings in a sensitive context that a primed compressor finds new.

A candidate is a long unbroken string in the same block of lines as a sensitive word, or near it on either side. Its
marginal size is what it adds to a zstandard frame whose dictionary holds common identifiers and the text around it:
names, paths and values repeated in the line are found in the dictionary and cost a few bytes. The yardstick is what a
random string of the same alphabet and length adds to the same frame, so keys of few symbols count like others.
Candidates of at least ``NOVELTY`` of it are reported with kind ``novel``. Copies of the candidate on other lines are
blanked first. Strings whose letters mostly come in pairs common in words are names, not keys.

Result cases. Null or empty text: no spans. Null doc_id, repeated rows: a result row each. Very long texts: whole, with a
bounded context for each candidate. Ties: spans are ordered by start, then kind. Empty table: no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: base patterns
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"(?ai:password|passwd|secret|token|(?:api|access|private)[_ -]?key|credential|authorization|bearer|passphrase|signature)")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}=*")
REACH = 64
AROUND = 512
NOVELTY = 0.75
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")
# from the narrowest; a candidate is measured against the first that holds it
ALPHABETS = (
    string.digits, "0123456789abcdef", "0123456789ABCDEF", "0123456789abcdef-", string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase,
    string.digits + string.ascii_uppercase, string.digits + string.ascii_letters, string.digits + string.ascii_letters + "-_", string.digits + string.ascii_letters + "+/",
    string.digits + string.ascii_letters + "+/-_",
)
# pairs of letters that make up most of the words of European languages, and one pair in six of random letters
PAIRS = frozenset(
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ch ei ie un da be ge "
    "ic sc ue qu io em co me ma do ro os no ta la el lo ne li ri ec ce ac ct om il us ut ss di pr tr ad am id ab ig gh ke ck ns rs ts ll ee "
    "oo ec pe pa po so su ul im ir ol ay ow wo we wi ag eg iz ig rt rd ty ly fi fo fr un ap op up au bl pl".split()
)
LEAST_PAIRS, NAME_PART = 8, 0.5
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key credential authorization bearer username "
    "user_id session_id request_id client_id client_secret config configuration environment variable parameter default "
    "example placeholder changeme your_api_key_here your_password_here localhost database connection string "
    "https://www.example.com/ http://localhost:8080/ /usr/local/bin/ /home/user/ application/json text/plain "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 xxxxxxxx import export function "
    "return public static final private protected class interface implements extends boolean integer undefined "
    "getElementById addEventListener toString valueOf length index offset buffer encode decode base64 sha256 md5 uuid"
).encode()

SPAN = "struct<kind: string, start: int, end: int, value: string, novelty: double>"


def marginal_bytes(candidate: bytes, around: bytes) -> int:
    """Bytes the candidate adds to a frame primed with identifiers and its surroundings."""
    return _marginal([candidate], around)[0]


def _marginal(candidates: list[bytes], around: bytes) -> list[int]:
    """``marginal_bytes`` of candidates of one length."""
    import zstandard as z

    primed = z.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=z.DICT_TYPE_RAWCONTENT)
    params = z.ZstdCompressionParameters.from_level(
        19, source_size=len(candidates[0]), dict_size=len(IDENTIFIERS) + len(around) + 1, format=z.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    pack = z.ZstdCompressor(dict_data=primed, compression_params=params)
    empty = len(pack.compress(b""))
    return [len(pack.compress(c)) - empty for c in candidates]


def _alphabet(value: str) -> str:
    letters = set(value.rstrip("="))
    return next((a for a in ALPHABETS if letters <= set(a)), ALPHABETS[-1])


@lru_cache(maxsize=4096)
def _yardstick(alphabet: str, length: int) -> bytes:
    """A random string, the same in every run."""
    return "".join(random.Random(f"{alphabet}:{length}").choices(alphabet, k=length)).encode()


def is_name(value: str) -> bool:
    """Whether the letters read like words; too few letters say nothing."""
    if len(_alphabet(value)) < 26:
        return False
    low = value.lower()
    pairs = [low[i : i + 2] for i in range(len(low) - 1) if low[i].isalpha() and low[i + 1].isalpha()]
    return len(pairs) >= LEAST_PAIRS and sum(p in PAIRS for p in pairs) >= NAME_PART * len(pairs)


def novelty(text: str, start: int, end: int) -> float:
    """Marginal bytes of text[start:end] as a part of those of a random string of its alphabet and length."""
    value = text[start:end]
    line, stop = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    stop = len(text) if stop < 0 else stop
    low, high = start - AROUND, end + AROUND
    # far enough out that a copy that the window cuts is seen whole
    first, last = max(0, low - len(value)), high + len(value)
    blank = "\n" * len(value)
    before = text[min(first, line) : line].replace(value, blank) + text[line:start]
    after = text[end : min(stop, last)] + text[stop:last].replace(value, blank)
    around = before[-AROUND:] + "\n" + after[:AROUND]
    mine, random_one = _marginal([value.encode(), _yardstick(_alphabet(value), len(value))], around.encode("utf-8", "surrogatepass"))
    return mine / random_one


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Places of long strings in a sensitive context; sensitive words inside a string cut it."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return
    cuts = [m.end() for m in BLANK_LINE.finditer(text)]
    blocks = {bisect_right(cuts, s) for s, _ in words}
    ends, starts = [e for _, e in words], [s for s, _ in words]
    for m in CANDIDATE.finditer(text):
        k = bisect_right(ends, m.start())
        near = (k and m.start() - ends[k - 1] <= REACH) or (k < len(starts) and starts[k] - m.end() <= REACH)
        if not near and bisect_right(cuts, m.start()) not in blocks:
            continue
        at = m.start()
        while k < len(words) and starts[k] < m.end():
            yield from (p.span() for p in CANDIDATE.finditer(text, at, max(at, starts[k])))
            at, k = max(at, ends[k]), k + 1
        if at < m.end():
            yield from (p.span() for p in CANDIDATE.finditer(text, at, m.end()))


def _places(text: str) -> list[tuple[int, str]]:
    """(position, word) of assignment words in either case; positions of lower() hold only if it keeps the length."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
    found = []
    for word in ASSIGN_WORDS:
        at = low.find(word)
        while at >= 0:
            found.append((at, word))
            at = low.find(word, at + 1)
    return sorted(found)


def find_secrets(text: str | None) -> list[dict]:
    """All spans of one text, in order."""
    if not text:
        return []
    spans, places, done = [], _places(text), 0
    for at, _ in places:  # leftmost first; a match that is too short uses up its text as well
        if at >= done and (m := ASSIGN.match(text, at)):
            done = m.end()
            if len(m[2]) >= ASSIGN_LEAST:
                spans.append(("assign", m.start(), m.end(), None))
    spans += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST] if "AKIA" in text else []
    spans += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    for start, end in candidates(text):
        if not is_name(text[start:end]) and (part := novelty(text, start, end)) >= NOVELTY:
            spans.append(("novel", start, end, min(1.0, part)))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return [{"kind": k, "start": s, "end": e, "value": text[s:e], "novelty": v} for k, s, e, v in spans]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("novelty", pa.float64())])
    for batch in batches:
        found = [find_secrets(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the array of its spans (kind, start, end, value, novelty) for every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, f"doc_id long, spans array<{SPAN}>")


def named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
