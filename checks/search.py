"""Checks: full-text and vector search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.common import query, sql_in, table
from pricelake.functions import rules, text
from pricelake.operators import textsearch, vectorsearch
from pricelake.session import shared_folder

_WORDS = r"[x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> '']"
_STOP = sql_in(rules.ENGLISH_STOP_WORDS)
_DOCS = f"""docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
    pos AS (SELECT doc_id, unnest(words) AS term, unnest(range(1, len(words) + 1)) AS p FROM docs),
    terms AS (SELECT doc_id, term, p FROM pos WHERE term NOT IN {_STOP})"""


def vectors(spark, sf):
    return textsearch.text_vectors(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query("term_index", f"""WITH {_DOCS} SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences, sum(p)::BIGINT AS position_sum FROM terms GROUP BY term""")
def term_index(spark, sf):
    index = textsearch.inverted_index(vectors(spark, sf), "doc_id")
    per_doc = index.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("p"))
    return per_doc.groupBy("term").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("occurrences"), F.sum("p").alias("position_sum")
    )


@query("term_counts", f"WITH {_DOCS} SELECT term, count(DISTINCT doc_id) AS docs FROM terms GROUP BY term")
def term_counts(spark, sf):
    return textsearch.term_counts(vectors(spark, sf))


def search_queries(spark, sf):
    """All different words of every benchmark text."""
    words = F.array_distinct(text.search_tokens(F.col("text")))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("terms"))


_QUERIES = f"""bw AS (SELECT item_id, [x FOR x IN {_WORDS} IF x NOT IN {_STOP}] AS w FROM benchmark),
    q AS (SELECT item_id AS query_id, list_distinct(w) AS asked FROM bw),
    qt AS (SELECT query_id, len(asked) AS n, unnest(asked) AS term FROM q),
    full_hits AS (SELECT query_id, doc_id FROM qt JOIN (SELECT DISTINCT doc_id, term FROM terms) USING (term) GROUP BY query_id, doc_id, n HAVING count(*) = n),
    hits AS (SELECT query_id, n, doc_id, term, p FROM full_hits JOIN qt USING (query_id) JOIN terms USING (doc_id, term))"""


@query("fulltext_search", f"""WITH {_DOCS}, {_QUERIES},
    s AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM hits GROUP BY ALL)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s
    QUALIFY rank <= 10""")
def fulltext_search(spark, sf):
    return textsearch.search_pages(search_queries(spark, sf), vectors(spark, sf), "doc_id", 10, rank="frequency")


# a hit ends a minimal cover when its own term was not seen since the oldest last hit of the others
_COVER = f"""{_DOCS}, {_QUERIES},
    h AS (SELECT *, row_number() OVER d AS i FROM hits WINDOW d AS (PARTITION BY query_id, doc_id ORDER BY p)),
    b AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY query_id, doc_id, term ORDER BY i), 0) AS before FROM h),
    x AS (SELECT b.query_id, b.doc_id, b.n, b.i, b.p, b.before, max(CASE WHEN b.term = qt.term THEN b.i END) OVER (PARTITION BY b.query_id, b.doc_id, qt.term ORDER BY b.i) AS seen
      FROM b JOIN qt ON qt.query_id = b.query_id),
    e AS (SELECT query_id, doc_id, i, any_value(p) AS p, CASE WHEN count(seen) = any_value(n) AND min(seen) > any_value(before) THEN min(seen) END AS l FROM x GROUP BY query_id, doc_id, i),
    s AS (SELECT e.query_id, e.doc_id, round(coalesce(sum(0.1 / (1 + (e.p - h.p) - (e.i - e.l))), 0), 6) AS score
      FROM e LEFT JOIN h ON h.query_id = e.query_id AND h.doc_id = e.doc_id AND h.i = e.l GROUP BY e.query_id, e.doc_id)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10"""


@query("fulltext_cover_rank", f"WITH {_COVER}")
def fulltext_cover_rank(spark, sf):
    return textsearch.search_pages(search_queries(spark, sf), vectors(spark, sf), "doc_id", 10, rank="cover")


@query("fulltext_index_search", f"WITH {_COVER}")
def fulltext_index_search(spark, sf):
    """The same from a stored index to which the documents of one source after the other were added."""
    docs, folder = table(spark, sf, "documents"), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    first = F.coalesce(F.col("source") <= "src1", F.lit(True))
    for part in (docs.filter(first), docs.filter(~first)):
        textsearch.write_index(textsearch.text_vectors(part, "doc_id", F.col("text")), "doc_id", folder)
    return textsearch.search_index(search_queries(spark, sf), folder, vectors(spark, sf), "doc_id", 10, rank="cover")


@query("stored_positions", f"""WITH {_DOCS} SELECT doc_id, term, list(p ORDER BY p) AS places FROM terms GROUP BY doc_id, term""".replace("list(p ORDER BY p) AS places", "string_agg(p::VARCHAR, ',' ORDER BY p) AS places"))
def stored_positions(spark, sf):
    """Position lists as they are read from the index."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    textsearch.write_index(vectors(spark, sf), "doc_id", folder)
    rows = textsearch.read_index(spark, folder, "lists")
    return rows.select("doc_id", "term", F.array_join(textsearch.positions(F.col("gaps")).cast("array<string>"), ",").alias("places"))


# every row whose id is divisible by 20 is a query
_NEAR = """WITH d AS (SELECT q.vec_id::VARCHAR AS query_id, e.vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS distance
      FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)"""


def asked_vectors(rows):
    return rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("semantic_topk", f"""{_NEAR} SELECT query_id, vec_id, round(distance, 6) AS distance,
    row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 10""")
def semantic_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    found = vectorsearch.semantic_search(rows, "vec_id", "embedding", asked_vectors(rows), 10)
    return found.withColumn("distance", F.round("distance", 6))


@query("semantic_threshold", f"""{_NEAR} SELECT query_id, vec_id, round(distance, 6) AS distance,
    row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d WHERE distance < 0.8 QUALIFY rank <= 5""")
def semantic_threshold(spark, sf):
    rows = table(spark, sf, "embeddings")
    found = vectorsearch.semantic_search(rows, "vec_id", "embedding", asked_vectors(rows), 5, max_distance=0.8)
    return found.withColumn("distance", F.round("distance", 6))


@query("semantic_centroids", """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
    m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL),
    c AS (SELECT label::VARCHAR AS query_id, list(m ORDER BY i) AS vector FROM m GROUP BY label),
    d AS (SELECT query_id, vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], vector), 9) AS distance FROM embeddings, c)
    SELECT query_id, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 10""")
def semantic_centroids(spark, sf):
    rows = table(spark, sf, "embeddings")
    found = vectorsearch.semantic_search(rows, "vec_id", "embedding", vectorsearch.label_centroids(rows, "label", "embedding"), 10)
    return found.withColumn("distance", F.round("distance", 6))


@query("semantic_cells", f"""{_NEAR} SELECT query_id, vec_id, round(distance, 6) AS distance,
    row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 10""")
def semantic_cells(spark, sf):
    """From the cell index with its exact stop: two cells first, then those that can hold something nearer."""
    rows = table(spark, sf, "embeddings")
    model = vectorsearch.fit_cells(rows, "embedding", 8)
    indexed = vectorsearch.assign_cells(rows, "embedding", model)
    found = vectorsearch.cell_search(indexed, "vec_id", "embedding", model, asked_vectors(rows), 10, probes=2)
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def cell_recall(rows, indexed, model, probes=None):
    """Part of the true ten nearest that the partial probe finds, over all rows whose id is divisible by 20."""
    queries = asked_vectors(rows)
    exact = vectorsearch.semantic_search(rows, "vec_id", "embedding", queries, 10)
    near = vectorsearch.approximate_search(indexed, "vec_id", "embedding", model, queries, 10, probes=probes)
    hits = near.select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(hits, ["query_id", "vec_id"], "left").agg(F.count("hit") / F.count("*")).first()[0]


@query("stored_text_vector", """WITH w AS (SELECT doc_id, source || ' ' || lang || ' ' || text || ' ' || CASE WHEN lang = 'en' THEN '' ELSE text END || ' ' || source AS text FROM documents)
    SELECT 'https://docs.example.com/' || doc_id AS url, len([x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF x <> '']) AS words FROM w""")
def stored_text_vector(spark, sf):
    from checks.store import document_pages

    rows = textsearch.text_vectors(document_pages(spark, sf), "url", textsearch.page_text())
    return rows.select("url", F.size("tokens").alias("words"))
