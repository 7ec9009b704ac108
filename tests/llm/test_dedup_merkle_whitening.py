"""Suffix dedup, Merkle manifest and whitening on messy rows, and against plain versions of the same rules."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pricelake.llm import merkle, suffixdedup, whitening
from pricelake.llm.queries import QUERIES
from tests.conftest import SMALL


def plain_removal(texts, length):
    stands, data = defaultdict(int), [(t or "").encode() for t in texts]
    for b in data:
        for i in range(len(b) - length + 1):
            stands[b[i : i + length]] += 1
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if stands[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(b)]
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        yield len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()


def messy_texts(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(5, 700))) for _ in range(12)]
    texts = ["".join(rng.choice(pool)[rng.randint(0, 9) :] for _ in range(rng.randint(0, 4))) for _ in range(50)]
    return texts + ["a" * 1000, "ab" * 450, "a" * 399, "a" * 400, "", None, texts[0], texts[0], "\0" * 500, "é" * 250]


@pytest.mark.parametrize("crowd", [20_000, 3])  # with three rows a crowd, the narrower ranges do the work
def test_suffix_dedup(spark, crowd, monkeypatch):
    monkeypatch.setattr(suffixdedup, "FREQUENT", min(crowd, 1_000))
    texts = messy_texts(crowd)
    ids = [None if i % 17 == 5 else i // 2 for i in range(len(texts))]
    names = ("text_key", "spans", "data", "start", "place", "suffix")
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", *[f"'x' AS `{n}`" for n in names])
    got = sorted((tuple(r) for r in suffixdedup.removal_report(docs, crowd=crowd).collect()), key=str)
    assert got == sorted(((d, *r) for d, r in zip(ids, plain_removal(texts, 400))), key=str)
    assert sum(r[2] for r in got) > 1000


def test_suffix_dedup_other_lengths(spark):
    texts = messy_texts(9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffixdedup.removal_report(docs, length=60, reach=20, kept=True).collect()}
    want = dict(enumerate(plain_removal(texts, 60)))
    assert {d: r[:4] for d, r in got.items()} == want
    assert all(hashlib.sha256(r[4]).hexdigest() == r[3] for r in got.values())
    assert suffixdedup.removal_report(docs.limit(0)).count() == 0


def test_triggers_are_local_and_dense():
    rng = random.Random(4)
    data = bytes(rng.choice(b"abc ") for _ in range(6000))
    at = suffixdedup.triggers(data, 400, 128)
    for i in range(0, len(data) - 399, 7):
        here = at[(at >= i) & (at < i + 128)]
        assert len(here)  # a trigger in the first 128 bytes of every string
        inner = suffixdedup.triggers(data[i : i + 400], 400, 128)
        assert len(inner) == 1 and inner[0] + i in here  # known from the string alone
    run, suffixdedup.RUN = suffixdedup.RUN, 1000
    try:
        assert (suffixdedup.triggers(data, 400, 128) == at).all()
    finally:
        suffixdedup.RUN = run


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([hashed("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_proof(levels, i):
    for level in levels[:-1]:
        start = i - i % 8
        yield "".join(level[start:i]), "".join(level[i + 1 : start + 8])
        i //= 8


def plain_manifest(rows):
    def leaf(r, text):
        values = [None if v is None else str(v) for v in (r[0], r[1], r[2], r[3], text)]
        return hashed("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))

    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(by_lang, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: plain_tree([x[2] for x in sorted(by_lang[k], key=lambda x: x[:3])]) for k in order}
    top = plain_tree([trees[k][-1][0] for k in order])
    for number, k in enumerate(order):
        for i, (known, doc_id, digest, r) in enumerate(sorted(by_lang[k], key=lambda x: x[:3])):
            proof = [*plain_proof(trees[k], i), *plain_proof(top, number)]
            text = r[4]
            if text is not None and known and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for before, after in proof:
                node = hashed(before + node + after)
            yield r[0], digest, trees[k][-1][0], top[-1][0], hashed("".join(a + b for a, b in proof)), node, node == top[-1][0]


@pytest.mark.parametrize("n", [1, 9, 1500])
def test_merkle(spark, n):
    rng = random.Random(n)
    langs = ["en"] * 20 + ["de", "fr", None, "é"] + [f"l{k}" for k in range(12)]
    rows = [(rng.choice([None, 3]) if rng.random() < 0.05 else i, rng.choice([None, "a"]), rng.choice(langs), rng.choice([None, 5]),
             rng.choice([None, "", "abc", "ABC é İ", "Z" * 5000])) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.selectExpr("*", *[f"'x' AS `{c}`" for c in ("pos", "digest", "row", "block", "levels", "path", "top", "root")])
    got = sorted((tuple(r) for r in merkle.tamper_report(docs).collect()), key=str)
    assert got == sorted(plain_manifest(rows), key=str)


def test_merkle_proofs_prove(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = merkle.manifest(docs, fan=4, depth=2)
    assert rows.where(merkle.folded(rows["leaf"], rows["proof"]) != rows["root"]).count() == 0
    assert rows.select("root").distinct().count() == 1
    assert merkle.tamper_report(docs.limit(0)).count() == 0


def plain_whitening(vectors):
    xs = [None if v is None or not v or any(c is None or not np.isfinite(c) for c in v) else tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors]
    fit = np.array(sorted({x for x in xs if x is not None}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return xs, n, sums, values[::-1], basis[:, ::-1]


def against_plain(rows, got, components=4):
    xs, n, sums, values, basis = plain_whitening([r[1] for r in rows])
    assert len(got) == components * sum(x is not None for x in xs)
    by_id = {r[0]: np.array(x) for r, x in zip(rows, xs) if x is not None}
    signs = {}
    for r in got:
        x, k = by_id[r.vec_id], r.component - 1
        assert (r.n, r.deviation) == (n, int(((n * x - sums) ** 2).sum()))
        want = (x - sums / n) @ basis[:, k] / np.sqrt(values[k])
        if abs(want) > 1e-6:
            assert signs.setdefault(k, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(want) - abs(r.whitened)) < 1e-8 and abs(r.explained - values[k] / values.sum()) < 1e-9 and r.identity_error < 1e-9


def test_whitening(spark):
    docs = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    against_plain([(r.vec_id, r.embedding) for r in docs.collect()], QUERIES["op13_whitening"](spark, SMALL).collect())


def test_whitening_messy(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in v]) for i, v in enumerate((rng.standard_normal((60, 6)) * [5, 4, 3, 2, 1, 1]).astype(np.float32))]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6), (104, [float("inf")] * 6)]
    rows = [*good, (60, good[3][1]), (61, good[3][1]), *bad]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS x", "'x' AS n", "'x' AS i")
    against_plain(rows, whitening.whitened(vectors).collect())
    short = vectors.unionByName(spark.createDataFrame([(105, [1.0, 2.0])], "vec_id long, embedding array<float>").selectExpr("*", "'x' AS x", "'x' AS n", "'x' AS i"))
    assert {r.vec_id for r in whitening.whitened(short).collect()} == {*range(62)}
    line = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(line).collect()} == {1}
    assert whitening.whitened(line.limit(0)).count() == 0 and whitening.whitened(line.limit(1)).count() == 0
    big = spark.createDataFrame([(i, [float(i) * 2e6, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whitened(big).collect()} == {sum((9 * x - 36 * 512_000_000) ** 2 for x in [i * 512_000_000]) if (9 * i * 512_000_000 - 36 * 512_000_000) ** 2 < 2**63 else None for i in range(9)}
