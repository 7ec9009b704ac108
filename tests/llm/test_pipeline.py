"""The pipeline against a plain version of every stage, on the smallest tables and a planted fixture."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from pricelake.llm import decontaminate, mixing, quality, simhash
from tests.conftest import SMALL

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(docs):
    fps = {d: plain_fingerprint(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in docs}


def edits(pattern, text):
    """Least edits of the whole pattern in any part of the text."""
    col = np.arange(len(pattern) + 1)
    p = np.array([ord(c) for c in pattern])
    best = col[-1]
    for c in text:
        first = np.minimum(col[:-1] + (p != ord(c)), col[1:] + 1)
        new = np.concatenate([[0], first])
        new = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        col, best = new, min(best, new[-1])
    return best


def plain_copies(docs):
    size = {d: len(SPACE.findall(t)) for d, (t, _) in docs.items()}
    per = Counter()
    for d, (_, s) in docs.items():
        per[s] += size[d]
    order = sorted(per)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    whole, full = 1.5 * sum(per.values()), set()
    while True:
        level = (whole - sum(2 * per[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and 2 * per[s] <= level * weight[s]}
        if not more or len(more | full) == len(order):
            full |= more
            break
        full |= more
    rate = {s: (2.0 if s in full else level * weight[s] / per[s]) if per[s] else 0 for s in order}
    out = {}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for d, (t, s) in docs.items():
        u = int(md5(f"{d}:{md5(s)}{md5(t)}:1:mix")[:13], 16) / 2**52
        out[d] = int(rate[s]) + (u < rate[s] - int(rate[s]))
    return out


def test_run_matches_plain_stages(spark):
    raw = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    verdict = quality.verdicts(spark.read.parquet(f"{SMALL}/documents.parquet")).toPandas().set_index("doc_id")
    docs = {int(r.doc_id): (r.text, r.source) for r in raw.itertuples() if verdict.kept[r.doc_id]}
    groups = plain_groups({d: t for d, (t, _) in docs.items()})
    docs = {d: x for d, x in docs.items() if groups[d] == d}
    items = [" ".join(t.lower().split()) for t in spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas().text]

    def holds(text, item):
        budget = int(len(item) * 0.1)
        n = budget + 1
        parts = [item[len(item) * k // n : len(item) * (k + 1) // n] for k in range(n)]
        return any(p in text for p in parts) and edits(item, text) <= budget

    docs = {d: x for d, x in docs.items() if not any(holds(" ".join(x[0].lower().split()), i) for i in items if len(i) >= 40)}
    copies = plain_copies(docs)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for d in sorted(docs):
        ids = tokenizer.encode(docs[d][0], add_special_tokens=False).ids + [0]
        for _ in range(copies[d]):
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(want) and len(got) > 50


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumnRenamed("n_chars", "n_chars")
    assert len(corpus_pipeline.STAGES) == 5
    none = docs.limit(0)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none, SMALL)
        assert out.count() == 0
        if number < 4:
            assert out.columns == docs.columns


def test_stages_decide_each_row(spark):
    """Rows without id and rows that share one are judged one by one."""
    words = [f"{w}{i}" for i, w in enumerate("river stone cloud maple candle window garden bridge silver market".split() * 6)]
    texts = [" ".join(words[i:] + words[:i]) for i in (0, 7, 19)]
    texts = [t + f" tail{i} more{i} end{i}" * 5 for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string"

    def left(stage, rows, *more):
        return sorted(((r.doc_id, r.text) for r in stage(spark.createDataFrame(rows, schema), *more).collect()), key=str)

    bad = "no good"
    rows = [(i, t, "en", "a") for i in (None, 5) for t in (texts[0], texts[1], bad)]
    got = left(quality.good_documents, rows)
    assert got == sorted(((i, t) for i, t, *_ in rows if t != bad), key=str)

    items = spark.createDataFrame([(1, " ".join(words[:20]))], "item_id long, text string")
    rows = [(i, t, "en", "a") for i in (None, 5) for t in ("before " + " ".join(words[:20]) + " after", texts[1][300:], None)]
    got = left(decontaminate.clean, rows, items)
    assert got == sorted(((i, t) for i, t, *_ in rows if not t or not t.startswith("before")), key=str)

    clashing = "row", "number", "identity", "rate", "known", "content", "__bad", "__key", "__stay", "__one", "__n", "__rate", "__source", "row_key"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "length(text) AS n_chars", *[f"'x' AS `{c}`" for c in clashing])
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        assert out.count() > 0 and (number == 4 or out.columns == docs.columns)

    # near copies without id, one group; a repeated id names one group and has a later row in another
    near = [" ".join(SPACE.findall(t.upper())) for t in texts]
    rows = [(None, texts[0], "en", "a"), (None, near[0], "en", "a"), (None, near[0], "en", "a"), (None, texts[2], "en", "a"), (3, texts[1], "en", "a"), (5, near[1], "en", "a"), (5, "one other text stands here alone", "en", "a")]
    got = left(simhash.one_per_group, rows)
    assert len(got) == 4 and (3, texts[1]) in got and (5, "one other text stands here alone") in got and (None, texts[2]) in got
    assert left(simhash.one_per_group, rows[::-1]) == got


def test_mixing_draws_rows_without_id_one_by_one(spark):
    rows = [(None, f"word {'w ' * (i % 9)}{i if i % 3 else ''}", f"s{i % 3}") for i in range(4000)]  # a third of them repeat others
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix_rates(docs).collect():
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - t) < 0.1 * t for s, t in target.items())
    once = Counter((r.text, r.source) for r in mixing.mixed(docs).collect())
    assert once == Counter((r.text, r.source) for r in mixing.mixed(docs.repartition(5)).collect())
    got = Counter()
    for (t, s), n in once.items():
        got[s] += n * len(t.split())
    assert got == taken


def test_one_row_stays_whatever_the_order(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, "a"), (1, text, "b"), (1, text, "b"), (2, text, "a"), (None, text, "z"), (3, "another text that stands alone here", "c"), (3, "another text that stands alone here", "c")]
    left = [sorted(tuple(r) for r in simhash.one_per_group(spark.createDataFrame(x, "doc_id long, text string, source string")).collect()) for x in (rows, rows[::-1])]
    assert left[0] == left[1] and [r[0] for r in left[0]] == [1, 3]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
