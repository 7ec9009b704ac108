"""Operators against brute force on small data, and properties that must always hold."""

from __future__ import annotations

import difflib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelake.functions import prices, urls
from pricelake.operators import candidates, frontier, metrics, offers, ordered, relevance, serp, store, textsearch, vectorsearch
from tests.conftest import SMALL


def make_offers(n, seed):
    rnd = random.Random(seed)
    words = ["plancha", "vapor", "philips", "oster", "1200w", "azul", "roja", "mini", "pro", "2000w", "acero"]
    rows = []
    for pos in range(n):
        name = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))
        rows.append((rnd.randint(1, 3), f"u{pos}", pos, name, float(rnd.randint(1, 40)), rnd.choice(["UYU", "USD", "EUR"]), rnd.choice([0.8, 0.9, 0.95, 1.0])))
    return rows


def dedupe_by_hand(rows):
    kept = {}
    for q, url, pos, name, price, cur, conf in sorted(rows, key=lambda r: r[2]):
        leaders = kept.setdefault(q, [])
        norm = " ".join(t for t in name.split() if len(t) > 2)
        item = (price, cur, conf, pos)
        hit = None
        if norm:
            for entry in leaders:
                if entry[0] and difflib.SequenceMatcher(None, norm, entry[0]).ratio() >= 0.85:
                    hit = entry
                    break
        if hit is None:
            leaders.append([norm, item])
        elif cur == hit[1][1]:
            if price < hit[1][0]:
                hit[1] = item
        elif conf > hit[1][2]:
            hit[1] = item
    return {(q, e[1][3]) for q, es in kept.items() for e in es}


def test_large_clusters_are_merged_in_a_tree(spark, monkeypatch):
    """One cluster of a third of all rows at sparse positions, and small ones, against the fold in order."""
    monkeypatch.setattr(offers, "_SMALL_CLUSTER", 0)
    monkeypatch.setattr(offers, "_RUN", 50)
    monkeypatch.setattr(offers, "_FAN", 3)
    rng, rows = random.Random(8), []
    for i in range(2400):
        cluster = 0 if i % 3 == 0 else rng.randint(1, 30)
        rows.append((1, cluster, i * 1_000_003 + rng.randint(0, 99), float(rng.randint(1, 3000)), rng.choice(["UYU", "USD", None]), rng.choice([None, 0.5, 0.8, 0.9, 0.95])))
    held = {}
    for q, cluster, pos, price, currency, confidence in sorted(rows, key=lambda r: r[2]):
        new, was = (pos, price, currency or "", confidence or 0.0), held.get(cluster)
        if was is None or (new[1] < was[1] if new[2] == was[2] else new[3] > was[3]):
            held[cluster] = new
    members = spark.createDataFrame(rows, "query_id int, leader bigint, pos bigint, price double, currency string, confidence double")
    assert {(r.leader, r.winner) for r in offers.cluster_winners(members).collect()} == {(c, h[0]) for c, h in held.items()}


def test_name_dedupe_reads_no_large_clusters_where_there_are_none(spark, monkeypatch):
    """Repeated rows and equal positions; the ranked tree of large clusters is not planned, and places are numbered without a join."""

    def never(rows):
        raise AssertionError("no cluster is large")

    monkeypatch.setattr(offers, "_large_winners", never)
    rows = [(1, "u2", 5, "azul mini", 3.0, "UYU", 0.5), (1, "u1", 5, "azul mini", 2.0, "USD", 0.9), (1, "u1", 5, "azul mini", 2.0, "USD", 0.9), (1, "u3", 1, "azul minis", 9.0, "UYU", 0.6), (1, "u4", 2, "x", 1.0, "UYU", 0.1), (2, "u1", 7, "azul mini", 4.0, "UYU", 0.1)]
    df = spark.createDataFrame(rows, "query_id int, url string, pos int, product_name string, price double, currency string, confidence double")
    shaped = df.select("query_id", "url", "pos", "product_name", prices.result(F.col("price"), F.col("currency"), F.lit(""), F.col("confidence")).alias("price_extraction"))
    got = sorted((r.query_id, r.url, r.pos, r.leader) for r in offers.dedupe_names(shaped).collect())
    assert got == [(1, "u1", 5, 1), (1, "u4", 2, 2), (2, "u1", 7, 7)]
    numbered = ordered.placed(shaped, ["query_id"], ["pos", "url"], "n")
    assert "Join" not in numbered._jdf.queryExecution().executedPlan().toString()
    seen = [(r.query_id, r.n) for r in numbered.orderBy("query_id", "pos", "url").collect()]
    assert seen == sorted(seen) and len({n for _, n in seen}) == len(rows)


@pytest.mark.parametrize("small, run", [(1000, 4096), (0, 7)])
def test_name_dedupe(spark, monkeypatch, small, run):
    """Both the in-row fold and the merged summaries of large mixed clusters."""
    monkeypatch.setattr(offers, "_SMALL_CLUSTER", small)
    monkeypatch.setattr(offers, "_RUN", run)
    rows = make_offers(300, 11)
    df = spark.createDataFrame(rows, "query_id int, url string, pos int, product_name string, price double, currency string, confidence double")
    shaped = df.select(
        "query_id", "url", "pos", "product_name", prices.result(F.col("price"), F.col("currency"), F.lit(""), F.col("confidence")).alias("price_extraction")
    )
    got = {(r.query_id, r.pos) for r in offers.dedupe_names(shaped).collect()}
    assert got == dedupe_by_hand(rows)


def test_similar_names_misses_nothing(spark):
    rnd = random.Random(5)
    names = sorted({"".join(rnd.choice("abc 12") for _ in range(rnd.randint(3, 14))).strip() for _ in range(260)})
    names = [n for n in names if len(n) >= 3]
    df = spark.createDataFrame([(1, n, i) for i, n in enumerate(names)], "query_id int, name string, pos bigint")
    got = {(r.later, r.earlier) for r in offers.similar_names(df).collect()}
    want = {
        (i, j) for i, a in enumerate(names) for j, b in enumerate(names[:i])
        if difflib.SequenceMatcher(None, a, b).ratio() >= 0.85
    }
    assert got == want and want


def test_similar_names_of_longer_names_and_few_candidates(spark):
    """Names of 8 to 40 letters with up to six edits, in several searches; random names have few candidates."""
    rnd, rows, letters = random.Random(6), [], "abcdefghij 0123456789"
    for base in range(60):
        first = "".join(rnd.choice(letters) for _ in range(rnd.randint(8, 40)))
        for _ in range(4):
            name = list(first)
            for _ in range(rnd.randint(0, 6)):
                at = rnd.randrange(len(name))
                name[at : at + rnd.randint(0, 1)] = rnd.choice(["", rnd.choice(letters)])
            rows.append("".join(name))
    named = sorted({(q, n) for i, n in enumerate(rows) for q in (1, 2 + i % 3)})
    rnd.shuffle(named)
    df = spark.createDataFrame([(q, n, i) for i, (q, n) in enumerate(named)], "query_id int, name string, pos bigint")
    for threshold in (0.85, 0.7):
        got = {(r.later, r.earlier) for r in offers.similar_names(df, threshold).collect()}
        assert got == {
            (i, j) for i, (q, a) in enumerate(named) for j, (p, b) in enumerate(named[:i])
            if p == q and difflib.SequenceMatcher(None, a, b).ratio() >= threshold
        } and got
    coded = spark.range(4000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 12).alias("name"))
    assert offers.candidate_names(coded).distinct().count() < 10 * 4000


def test_ranked_splits_a_hot_key(spark):
    rows = [(1 if i % 3 else 2, (i * 37) % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int, i int").repartition(7)
    got = {(r.k, r.i): r.rank for r in ordered.ranked(df, ["k"], ["v", "i"]).collect()}
    for key in (1, 2):
        order = sorted([r for r in rows if r[0] == key], key=lambda r: (r[1], r[2]))
        assert all(got[(key, r[2])] == n + 1 for n, r in enumerate(order))


def test_chunked_order_operators(spark):
    rnd = random.Random(3)
    rows = sorted((rnd.choice("xy"), rnd.randint(0, 500000), i, rnd.choice([None, 1.0, 2.0, 5.0])) for i in range(400))
    df = spark.createDataFrame(rows, "k string, s bigint, i int, v double").withColumn("ts", F.timestamp_seconds("s")).repartition(5)
    prev = {r.i: r.p and r.p.v for r in ordered.with_previous(df, ["k"], "ts", F.struct("v"), "p", "i").collect()}
    fill = {r.i: r.f for r in ordered.with_last_mark(df, ["k"], "ts", F.col("v"), "f", "i").collect()}
    run = {r.i: r.t for r in ordered.running_total(df, ["k"], "ts", F.coalesce("v", F.lit(0.0)), "t", "i").collect()}
    for k in "xy":
        last, held, total = None, None, 0.0
        for _, _, i, v in [r for r in rows if r[0] == k]:
            assert prev[i] == last
            held = v if v is not None else held
            total += v or 0.0
            assert fill[i] == held and run[i] == total
            last = v


def test_frontier_with_limits(spark):
    edges = [(f"https://h{i % 3}.com/{i}", f"https://h{(i * 7 + j) % 3}.com/{(i * 7 + j) % 40}", j) for i in range(40) for j in range(3)]
    e = spark.createDataFrame(edges, "src string, dst string, pos int").repartition(3)
    seeds = spark.createDataFrame([("https://h1.com/1", 0), ("https://h2.com/2", 1), ("https://h1.com/1", 2), ("ftp://x.com/", 3)], "url string, pos int")
    got = [(r.url, r.depth) for r in frontier.crawl_frontier(seeds, e, 3, max_pages=12, exclude=["*/13"]).collect()]

    by_src = {}
    for s, d, p in edges:
        by_src.setdefault(s, []).append((p, d))
    level, seen, want, depth = ["https://h1.com/1", "https://h2.com/2"], set(), [], 0
    while level and depth <= 3 and len(want) < 12:
        level = level[: 12 - len(want)]
        want += [(u, depth) for u in level]
        seen |= set(level)
        nxt = []
        for u in level:
            for _, d in sorted(by_src.get(u, [])):
                if d not in seen and d not in nxt and not d.endswith("/13"):
                    nxt.append(d)
        level, depth = nxt, depth + 1
    assert sorted(got) == sorted(want)


def test_host_cap_and_gate_are_stable(spark):
    rows = [(i % 3, i, f"https://{'www.' if i % 2 else ''}h{i % 5}.com/p{i // 15}?ref={i}", "red gear", "gear", "") for i in range(600)]
    df = spark.createDataFrame(rows, "query_id int, pos int, url string, query string, original_title string, original_snippet string")

    def outcome(parts):
        capped = candidates.host_cap(df.repartition(parts), 4)
        gated = relevance.relevance_gate(relevance.score_candidates(capped), top=10)
        return sorted((r.query_id, r.pos) for r in capped.collect()), sorted((r.query_id, r.rank, r.url) for r in gated.collect())

    first = outcome(1)
    assert first == outcome(4) == outcome(64)
    counts = {}
    for q, p in first[0]:
        key = (q, rows[p][2].replace("www.", "").split("/")[2])
        counts[key] = counts.get(key, 0) + 1
    assert max(counts.values()) <= 4


def test_gate_falls_back_when_nothing_passes(spark):
    df = spark.createDataFrame([(1, 0, "a", 0.1, 0.1), (1, 1, "b", 0.1, 0.15), (2, 0, "c", 0.5, 0.5), (2, 1, "d", 0.1, 0.9)],
                               "query_id int, pos int, url string, relevance_score double, combined_score double")
    got = sorted((r.query_id, r.rank, r.url) for r in relevance.relevance_gate(df, top=10).collect())
    assert got == [(1, 1, "b"), (1, 2, "a"), (2, 1, "c")]


def test_url_steps_are_idempotent(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("url")
    dirty = pages.select(F.explode(F.array("url", F.concat("url", F.lit(" › x")), F.concat("url", "url"), F.concat("url", F.lit("/a/b/a")))).alias("u"))
    for step in (urls.sanitize, urls.normalize, urls.drop_repeated_segments):
        once = dirty.select(step(F.col("u")).alias("a"))
        assert once.withColumn("b", step(F.col("a"))).filter("NOT (a <=> b)").count() == 0


def plain_nearest(rows, queries, k):
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows.collect()}
    out = set()
    for q in queries.collect():
        v = np.array(q.vector, dtype=float)
        best = sorted((round(1 - float(v @ x) / (np.linalg.norm(v) * np.linalg.norm(x)), 9), i) for i, x in vectors.items())[:k]
        out |= {(q.query_id, i, rank) for rank, (_, i) in enumerate(best, 1)}
    return out


def test_chunks_and_blocks_do_not_change_the_answer(spark, monkeypatch):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    queries = rows.select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector")).limit(50)
    want = plain_nearest(rows, queries, 3)
    for chunk, block in ((vectorsearch.CHUNK_ROWS, vectorsearch.BLOCK_QUERIES), (40, 9)):
        monkeypatch.setattr(vectorsearch, "CHUNK_ROWS", chunk)
        monkeypatch.setattr(vectorsearch, "BLOCK_QUERIES", block)
        assert {(r.query_id, r.vec_id, r["rank"]) for r in vectorsearch.semantic_search(rows, "vec_id", "embedding", queries, 3).collect()} == want


def test_searches_without_queries_or_direction(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    model = vectorsearch.fit_cells(rows, "embedding", 6)
    indexed = vectorsearch.assign_cells(rows, "embedding", model)
    odd = spark.createDataFrame([("zero", [0.0] * 64), ("null", None), ("empty", [])], "query_id string, vector array<double>")
    for queries in (odd, odd.limit(0)):
        assert vectorsearch.semantic_search(rows, "vec_id", "embedding", queries, 3).count() == 0
        assert vectorsearch.approximate_search(indexed, "vec_id", "embedding", model, queries, 3).count() == 0
        assert vectorsearch.cell_search(indexed, "vec_id", "embedding", model, queries, 3).count() == 0
    few = rows.filter("vec_id < 2")
    queries = rows.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert vectorsearch.semantic_search(few, "vec_id", "embedding", queries, 5).count() == 2


def test_exact_stop_reads_few_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((16, 24))
    vectors = [(i, [float(c) for c in centers[i % 16] + 0.05 * rng.standard_normal(24)]) for i in range(800)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    model = vectorsearch.fit_cells(rows, "embedding", 16)
    indexed = vectorsearch.assign_cells(rows, "embedding", model)
    got = vectorsearch.cell_search(indexed, "vec_id", "embedding", model, queries, 10).collect()
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == plain_nearest(rows, queries, 10)
    assert sum(r.cells for r in got) / len(got) < 4


def test_position_lists_round_trip(spark, tmp_path):
    texts = [(1, "b k b the k  k"), (2, None), (3, ""), (4, "the"), (5, "k"), (None, "z k")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    vectors = textsearch.text_vectors(docs, "doc_id", F.col("text"))
    for part in ("doc_id <= 3", "doc_id > 3 OR doc_id IS NULL"):
        textsearch.write_index(vectors.filter(part), "doc_id", str(tmp_path / "index"), buckets=4)
    lists = textsearch.read_index(spark, str(tmp_path / "index"), "lists")
    got = {(r.doc_id, r.term, tuple(r.p)) for r in lists.select("doc_id", "term", textsearch.positions(F.col("gaps")).alias("p")).collect()}
    assert got == {(1, "b", (1, 3)), (1, "k", (2, 5, 6)), (5, "k", (1,)), (None, "z", (1,)), (None, "k", (2,))}
    counts = textsearch.read_index(spark, str(tmp_path / "index"), "counts").groupBy("term").agg(F.sum("docs").alias("n"))
    assert {(r.term, r.n) for r in counts.collect()} == {("k", 3), ("b", 1), ("z", 1)}
    some = textsearch.read_index(spark, str(tmp_path / "index"), "lists", [1, 2]).select("term")
    assert "PartitionFilters: [bucket" in some._jdf.queryExecution().executedPlan().toString()


def test_position_lists_of_long_and_repeated_rows(spark):
    """Batches smaller than the table, null places and one term 30,000 times, against a plain count; rows are neither sorted nor folded in place."""
    rng = random.Random(9)
    rows = [(i % 7, [rng.choice(["a", "b", "", None, "ñ"]) for _ in range(rng.randint(0, 40))]) for i in range(60)]
    rows += [(7, None), (8, []), (None, ["", "c"]), (9, ["x"] * 30_000)]
    want = Counter()
    for doc, tokens in rows:
        for term in {t for t in tokens or [] if t}:
            want[doc, term, tuple(i + 1 for i, t in enumerate(tokens) if t == term)] += 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        lists = textsearch.position_lists(spark.createDataFrame(rows, "doc_id long, tokens array<string>"), "doc_id")
        read = lists.select("doc_id", "term", textsearch.positions(F.col("gaps")).alias("p"))
        assert Counter((r.doc_id, r.term, tuple(r.p)) for r in read.collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [4, 1])], "i int, gaps array<int>").select("i", textsearch.positions(F.col("gaps")).alias("p"))
    assert [r.p for r in odd.orderBy("i").collect()] == [None, [], [4, 5]]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "array_sort" not in plan and "aggregate(" not in plan


def plain_cover_rank(terms, tokens):
    """All windows that hold every term and lose one with either end."""
    hits = [i for i, t in enumerate(tokens) if t in terms]
    total = 0.0
    for a, left in enumerate(hits):
        for b in range(a, len(hits)):
            inside = [tokens[i] for i in hits[a : b + 1]]
            if set(inside) == set(terms):
                if tokens[left] not in inside[1:] and inside[-1] not in inside[:-1]:
                    total += 0.1 / (1 + (hits[b] - left) - (b - a))
                break
    return total


def test_cover_rank_against_all_windows(spark):
    rng = random.Random(6)
    rows = [(list(dict.fromkeys(rng.choices("abcd", k=rng.randint(1, 4)))), rng.choices("abcdxy", k=rng.randint(0, 40))) for _ in range(300)]
    rows = [(terms, tokens) for terms, tokens in rows if set(terms) <= set(tokens)]
    df = spark.createDataFrame(rows, "terms array<string>, tokens array<string>")
    plan = df.select(textsearch.cover_density_rank().alias("s"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    for (terms, tokens), r in zip(rows, plan.collect()):
        assert abs(r.s - plain_cover_rank(terms, tokens)) < 1e-9, (terms, tokens)


def test_all_cells_give_the_exact_answer(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    queries = vectorsearch.label_centroids(rows, "label", "embedding")
    model = vectorsearch.fit_cells(rows, "embedding", 6)
    near = vectorsearch.approximate_search(vectorsearch.assign_cells(rows, "embedding", model), "vec_id", "embedding", model, queries, 5, probes=6)
    exact = vectorsearch.semantic_search(rows, "vec_id", "embedding", queries, 5)
    assert {tuple(r) for r in near.collect()} == {tuple(r) for r in exact.collect()}


def test_upsert_keeps_first_crawl_and_vector(spark):
    base = spark.createDataFrame([("u", "old", "2024-01-01", None, [1.0]), ("w", "same", "2024-01-01", None, [2.0])],
                                 "url string, full_text string, crawled_at string, last_updated timestamp, embedding array<float>")
    base = base.withColumn("crawled_at", F.to_timestamp("crawled_at"))
    delta = spark.createDataFrame([("u", "new", "2024-02-01"), ("w", "same", "2024-02-01"), ("x", "first", "2024-02-01")], "url string, full_text string, f string")
    got = {r.url: r for r in store.upsert_pages(base, delta.withColumn("fetched_at", F.to_timestamp("f"))).collect()}
    assert got["u"].full_text == "new" and got["u"].crawled_at.month == 1 and got["u"].last_updated.month == 2 and got["u"].embedding is None
    assert got["w"].embedding == [2.0] and got["x"].last_updated is None and got["x"].crawled_at.month == 2


def test_clear_and_write_table(spark, tmp_path):
    from pricelake.sources import pages as source

    row = spark.range(3).select(F.concat(F.lit("https://a.com/"), "id").alias("url"), F.lit("2024-01-02").cast("timestamp").alias("crawled_at"))
    source.write_pages(row, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("crawl_date = '2024-01-02'").count() == 3
    store.clear_table(row, str(tmp_path / "t2"))
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 0


def test_retention_by_folder(spark, tmp_path):
    """Older folders go unread, the cutoff's day is written again, all other files stay as they are."""
    from datetime import datetime

    from pricelake.sources import pages as source

    folder = str(tmp_path / "pages")
    hour = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))
    rows = spark.range(240).select(F.concat(F.lit("u"), "id").alias("url"), hour.alias("crawled_at"))
    undated = spark.range(2).select(F.concat(F.lit("v"), "id").alias("url"), F.lit(None).cast("timestamp").alias("crawled_at"))
    source.write_pages(rows.unionByName(undated).repartition(3), folder)
    files = lambda: {p.relative_to(folder) for p in (tmp_path / "pages").rglob("*.parquet")}
    before, as_of = files(), datetime(2024, 1, 10, 12)
    counts = store.folder_retention_counts(spark, folder, as_of, 5)
    assert tuple(counts.first()) == (108, 134)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan and "PartitionFilters: []" not in plan
    assert store.delete_old_folders(spark, folder, as_of, 5) == (108, 134)
    left = spark.read.parquet(folder)
    assert left.count() == 134 and left.agg(F.min("crawled_at")).first()[0] == datetime(2024, 1, 5, 12)
    border = "crawl_date=2024-01-05"
    assert {p for p in files() if p.parts[0] != border} == {p for p in before if p.parts[0] > border}
    after = files()
    assert store.delete_old_folders(spark, folder, as_of, 5) == (0, 134) and files() == after  # run again: nothing to do
    assert store.delete_old_folders(spark, folder, datetime(2024, 1, 11), 5) == (12, 122)  # the border day goes whole
    assert not any(p.parts[0] == border for p in files())
    source.write_pages(rows.limit(0), str(tmp_path / "none"))
    assert store.delete_old_folders(spark, str(tmp_path / "none"), as_of, 5) == (0, 0)


def test_prices_are_stored_and_reused(spark):
    """Prices found in one job answer the next one, until they are too old."""
    from pricelake.operators import pricing

    at = lambda s: F.lit(s).cast("timestamp")
    pages = spark.createDataFrame([(1, 0, "a", "Lamp"), (2, 1, "a", "Lamp two"), (1, 2, "b", None), (1, 3, "c", "Chair")], "query_id int, pos long, url string, identified_product_name string").withColumn("page_type", F.lit("PRODUCT"))
    content = spark.createDataFrame([("a", "Oferta de lampara en la tienda, con entrega en el dia: U$S 1.234,50"), ("b", "x")], "url string, text string").withColumns(
        {"meta_tags": F.lit(None).cast("map<string,string>"), "structured_data": F.lit(None).cast("array<string>")}
    )
    none = spark.createDataFrame([("price", store_key(spark, "b"), "no json", "2024-01-01")], "kind string, key string, value string, d string").select("kind", "key", "value", at("2024-01-01").alias("decided_at"))
    first = pricing.extract_prices(pages, content, pricing.stored_prices(pages, none, at("2024-01-01 00:10:00")))
    got = {(r.query_id, r.url): (r.source, r.price_extraction.price) for r in first.collect()}
    assert got == {(1, "a"): ("text", 1234.5), (2, "a"): ("text", 1234.5), (1, "b"): ("insufficient", None), (1, "c"): ("no_content", None)}
    kept = store.record_decisions(none, pricing.price_decisions(first, at("2024-01-01 00:10:00")))
    assert kept.count() == 2  # one for "a", and the old one of "b"
    for moment, source, name in (("2024-01-01 01:00:00", "cached", "Lamp"), ("2024-01-01 03:00:00", "text", "Lamp two")):
        again = pricing.extract_prices(pages, content, pricing.stored_prices(pages, kept, at(moment)))
        row = again.filter("query_id = 2").first()
        assert (row.source, row.price_extraction.price, row.product_name) == (source, 1234.5, name)
        assert pricing.price_decisions(again, at(moment)).count() == (source == "text")


def store_key(spark, url):
    return spark.range(1).select(store.decision_key(F.lit(url))).first()[0]


def test_stored_types_settle_only_what_no_rule_does(spark):
    from pricelake.operators import pagetypes

    at = F.lit("2024-01-01 06:00:00").cast("timestamp")
    sites = ["https://a.com.uy/x", "https://a.com.uy/producto/1", "https://b.example.org/x", "https://a.com.uy/y"]
    rows = spark.createDataFrame([(u, "q") for u in sites], "url string, query string")
    said = spark.createDataFrame(
        [(sites[0], "q", "PRODUCT", "2024-01-01 05:00:00"), (sites[1], "q", "CATEGORY", "2024-01-01 05:00:00"), (sites[2], "q", "PRODUCT", "2024-01-01 05:00:00"), (sites[3], "q", "PRODUCT", "2023-12-31"), (sites[3], "other", "PRODUCT", "2024-01-01 05:00:00")],
        "url string, query string, value string, d string",
    )
    decisions = said.select(F.lit("page_type").alias("kind"), store.decision_key("url", "query").alias("key"), "value", F.to_timestamp("d").alias("decided_at"))
    got = {r.url: (r.page_type, r.type_source) for r in pagetypes.stored_types(pagetypes.page_type(rows), decisions, at).collect()}
    assert got == {sites[0]: ("PRODUCT", "stored"), sites[1]: ("CATEGORY", "stored"), sites[2]: ("EXCLUDE_NON_URUGUAY", "rule"), sites[3]: ("UNRESOLVED", "none")}


def test_alert_rules_with_history(spark):
    """Memory above the limit for six minutes fires; a restart counter and an error counter stay quiet."""
    rows = []
    for i in range(20):
        t = 1704067200 + i * 30
        rows.append((t, "node_memory_MemTotal_bytes", {"instance": "n1"}, 100.0))
        rows.append((t, "node_memory_MemAvailable_bytes", {"instance": "n1"}, 10.0 if 2 <= i < 15 else 50.0))
        rows.append((t, "up", {"job": "applications", "instance": "a"}, 0.0 if 5 <= i < 9 else 1.0))
        rows.append((t, "up", {"job": "other", "instance": "a"}, 0.0))
        rows.append((t, "promhttp_metric_handler_requests_total", {"code": "500"}, float(i * 20 if i < 10 else (i - 10) * 20)))
        rows.append((t, "promhttp_metric_handler_requests_total", {"code": "200"}, float(i * 900)))
    df = spark.createDataFrame(rows, "s bigint, metric string, labels map<string,string>, value double").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.alert, r.state, r.evaluations) for r in metrics.fire_alerts(df).collect()}
    assert ("HighMemoryUsage", "firing", 13) in got and ("ApplicationDown", "firing", 4) in got
    assert any(a == "HighErrorRate" and s == "firing" for a, s, _ in got)
    assert not any(a == "PodRestartingFrequently" for a, _, _ in got)


def test_default_probes_find_nine_of_ten(spark):
    from checks.search import cell_recall

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    model = vectorsearch.fit_cells(rows, "embedding", 8)
    indexed = vectorsearch.assign_cells(rows, "embedding", model)
    recall = cell_recall(rows, indexed, model)
    print("recall", recall, "at three probes", cell_recall(rows, indexed, model, 3))
    assert recall >= 0.9


def test_sliding_rates(spark):
    """Against sums over each range; sparse, dense and single steps, a range that is no multiple of the step."""
    rnd = random.Random(9)
    rows = sorted({(k, rnd.randrange(0, 400 if k == "a" else 9000) * 30) for k in "abc" for _ in range(150)} | {("d", 600)})
    steps = [(k, at, float(rnd.randint(0, 9))) for k, at in rows]
    df = spark.createDataFrame(steps, "k string, at bigint, d double").repartition(4)
    for span in (300, 310, 3600):
        want = {}
        for k, at, d in steps:
            for e in range(at, at + span - 29, 30):
                want[k, e] = want.get((k, e), 0.0) + d
        got = metrics.sliding_rates(df, ["k"], span, 30).select("k", F.unix_seconds("eval_ts"), "value").collect()
        assert {(k, e): round(v * span, 6) for k, e, v in got} == want and len(got) == len(want)


def test_bounds_of_text_hits(spark):
    """Descriptions of text hits keep to the bounds that are asked for, and to the usual ones of result pages."""
    link = "https://www.tienda1.com.uy/p/1"
    body = f"Oferta de prueba\n{link}\n{' ' * 40}Envio a todo el pais sin cargo\n"
    df = spark.createDataFrame([(1, "other", body)], "query_id long, engine string, text string")
    described = lambda **bounds: [r["description"] for r in serp.text_hits(df, "text", 1, **bounds).collect()]
    assert described() == [f"{link}"] and described(longest=12) == [link[:13]]
    page = df.select("query_id", "engine", F.concat(F.lit("<html><body><p>"), F.replace("text", F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>")).alias("html"))
    assert [(r["title"], r["url"]) for r in serp.parse_result_pages(page, 1).collect()] == [("Oferta de prueba", link)]


def test_alert_conditions_grow_with_samples_not_evaluations(spark):
    """Two samples a series, an hour apart: a few rows hold all evaluations, and runs count each of them."""
    rows = [(1704067200 + 3600 * i, m, {"job": "applications", "instance": str(k)}, v)
            for k in range(5) for i in range(2) for m, v in (("up", 0.0), ("node_memory_MemTotal_bytes", 100.0), ("node_memory_MemAvailable_bytes", 1.0))]
    rows += [(1704067200 + 600, "node_memory_MemAvailable_bytes", {"job": "applications", "instance": "0"}, 1.0)]  # total is not seen any more
    df = spark.createDataFrame(rows, "s bigint, metric string, labels map<string,string>, value double").withColumn("ts", F.timestamp_seconds("s"))
    assert metrics.alert_conditions(df).count() <= len(rows)
    got = sorted((r.alert, r.state, r.evaluations) for r in metrics.fire_alerts(df).collect())
    # ten evaluations see a sample, the newest one ends at the last step of all
    assert got == sorted([(a, s, n) for a, firing in (("ApplicationDown", 60), ("HighMemoryUsage", 300)) for _ in range(5)
                          for s, n in (("firing" if 270 >= firing else "pending", 10), ("pending", 1))])


def test_short_way_for_plain_urls(spark):
    """URLs of scheme, host and path alone take a shorter way to the same result."""
    cases = {
        "https://h/a/b/a/c": "https://h/a/b/c", "https://h/a/a/": "https://h/a/", "https://h//a//a": "https://h/a", "http://h/b/a": "http://h/b/a",
        "https:///a/a": "https:///a", "https://h": "https://h", "https://h/a/a?q=/a/a": "https://h/a?q=/a/a", "https://h/a/a;x": "https://h/a;x",
        "HTTPS://h/a/a": "https://h/a", "https://h/a/a#f": "https://h/a#f",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.drop_repeated_segments(F.col("u")).alias("v"), urls.netloc(F.col("u")).alias("n"))
    assert {r["u"]: r["v"] for r in df.collect()} == cases
    found = df.select("u", urls.contains_any(F.col("u"), ["/b", "/c", "/d", "?q=", "#f"]).alias("x")).collect()
    assert {r["u"] for r in found if r["x"]} == {u for u in cases if any(t in u for t in ("/b", "/c", "/d", "?q=", "#f"))}


def test_merged_links_are_expanded_once(spark):
    from checks import QUERIES

    plan = QUERIES["category_merge"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan


def test_answer_fields_are_read_once(spark):
    """The price of an outside answer, its found flag and the type of that are each read once a row."""
    df = spark.createDataFrame([('{"found": "0", "price": "3.5"}',), ('{"found": 0, "price": 3}',), ('{"found": true, "price": true}',)], "a string")
    out = df.select(prices.response_price(F.col("a")).alias("p"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("$.price") == 1 and plan.count("$.found") == 1 and plan.count("schema_of_variant") == 1
    assert [(r.p.success, r.p.price, r.p.error) for r in out.collect()] == [
        (True, 3.5, None), (False, None, "No price found in content"), (False, None, "Invalid price value")
    ]
