"""Full-text search over stored pages: text vector, inverted index, all-terms search, cover rank."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pricelake.functions.expr import let
from pricelake.functions.text import positioned_tokens
from pricelake.session import cut_lineage, small_side


def page_text() -> Column:
    """Everything searchable of a stored page in one string."""
    return F.concat_ws(
        " ",
        *[F.coalesce(c, F.lit("")) for c in ("title", "description", "main_content", "full_text")],
        F.array_join(F.flatten(F.map_values("headers")), " "),
    )


def english_stem(words: Column) -> Column:
    """Light suffix folding (plural and -ing/-ed forms), optional on both sides of a search."""
    return F.transform(
        words,
        lambda w: F.when(
            F.length(w) > 4, F.regexp_replace(F.regexp_replace(w, "(ies|ing|edly|ed|es|s|ly)$", ""), "(.)\\1$", "$1")
        ).otherwise(w),
    )


def text_vectors(docs: DataFrame, doc_id: str, text: Column, stem: bool = False) -> DataFrame:
    """(doc_id, tokens): array places are word positions, stop words leave an empty place."""
    tokens = positioned_tokens(text)
    return docs.select(doc_id, (english_stem(tokens) if stem else tokens).alias("tokens"))


def distinct_terms() -> Column:
    return F.array_remove(F.array_distinct("tokens"), "")


def inverted_index(vectors: DataFrame, doc_id: str) -> DataFrame:
    """(term, doc_id, position), one row per occurrence; narrow, so no term is gathered anywhere."""
    return vectors.select(doc_id, F.posexplode("tokens").alias("place", "term")).filter(F.col("term") != "").select(
        "term", doc_id, (F.col("place") + 1).alias("position")
    )


def postings(vectors: DataFrame, doc_id: str) -> DataFrame:
    """(term, doc_id), each pair once; repeats are removed inside the row."""
    return vectors.select(F.explode(distinct_terms()).alias("term"), doc_id)


def term_counts(vectors: DataFrame) -> DataFrame:
    return postings(vectors, vectors.columns[0]).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))


def all_term_candidates(queries: DataFrame, vectors: DataFrame, doc_id: str) -> DataFrame:
    """Documents holding every term of a query: (query_id, terms, doc_id, tokens).

    A match must hold the query's rarest term, so only the postings of that term are joined; frequent
    terms are checked inside the document row and never multiply rows.
    """
    asked = queries.filter(F.size("terms") > 0).select("query_id", F.array_distinct("terms").alias("terms"))
    by_term = asked.select("query_id", "terms", F.explode("terms").alias("term"))
    pairs = postings(vectors, doc_id)
    counts = (
        pairs.join(by_term.select("term").distinct(), "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("docs"))
    )
    rarest = small_side(
        by_term.join(counts, "term")
        .groupBy("query_id", "terms")
        .agg(F.min_by("term", F.struct("docs", "term")).alias("term"), F.count(F.lit(1)).alias("known"))
        .filter(F.col("known") == F.size("terms"))
        .select("query_id", "terms", "term")
    )
    holders = small_side(pairs.join(rarest, "term").select("query_id", "terms", doc_id))
    return (
        vectors.select(doc_id, "tokens")
        .join(holders, doc_id)
        .filter(F.size(F.array_except("terms", "tokens")) == 0)
        .select("query_id", "terms", doc_id, "tokens")
    )


def term_frequency_rank() -> Column:
    """Occurrences of the query terms; each term costs one pass over the row's tokens."""
    hits = lambda t: F.size("tokens") - F.size(F.array_remove("tokens", t))
    return F.aggregate("terms", F.lit(0), lambda total, t: total + hits(t)).cast("double")


def cover_density_rank() -> Column:
    """Sum over minimal covers of 0.1 / (1 + other words inside the cover), in one sweep over the row's hits.

    The state keeps the number of the last hit of each term. A hit ends a minimal cover when all terms have been seen and
    its own term was not seen since the oldest of the others; that oldest one is the cover's left end.
    """
    places = F.sequence(F.lit(1), F.size("tokens"))
    numbered = F.transform(F.arrays_zip(F.col("tokens").alias("w"), places.alias("p")), lambda x: F.struct(
        F.array_position(F.col("terms"), x["w"]).cast("int").alias("t"), x["p"].alias("p")
    ))
    hits = F.when(F.size("tokens") > 0, F.filter(numbered, lambda h: h["t"] > 0)).otherwise(F.array().cast("array<struct<t:int,p:int>>"))
    start = F.struct(F.array_repeat(F.lit(0), F.size("terms")).alias("last"), F.lit(0).alias("i"), F.lit(0.0).alias("total"))

    def sweep(hits: Column) -> Column:
        def step(state: Column, h: Column) -> Column:
            i = state["i"] + 1
            last = F.transform(state["last"], lambda seen, j: F.when(j + 1 == h["t"], i).otherwise(seen))

            def add(both: Column) -> Column:
                left = both["left"]
                minimal = (left > 0) & (F.element_at(state["last"], h["t"]) < left)
                # a term asked once is a cover by itself
                noise = h["p"] - F.element_at(hits, F.greatest(left, F.lit(1)))["p"] - (i - left)
                return F.struct(both["last"].alias("last"), i.alias("i"), (state["total"] + F.when(minimal, 0.1 / (1 + noise)).otherwise(0.0)).alias("total"))

            return let(F.struct(last.alias("last"), F.array_min(last).alias("left")), add)

        return F.aggregate(hits, start, step)["total"]

    return let(hits, sweep)


def search_pages(
    queries: DataFrame, vectors: DataFrame, doc_id: str, limit: int = 10, rank: str = "cover"
) -> DataFrame:
    """Best ``limit`` documents per query that hold all its terms."""
    return _ranked(all_term_candidates(queries, vectors, doc_id), doc_id, limit, rank)


def _ranked(candidates: DataFrame, doc_id: str, limit: int, rank: str) -> DataFrame:
    score = cover_density_rank() if rank == "cover" else term_frequency_rank()
    scored = candidates.select("query_id", doc_id, F.round(score, 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(doc_id))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


# -- stored index ----------------------------------------------------------------------------
BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def position_lists(vectors: DataFrame, doc_id: str) -> DataFrame:
    """(term, doc_id, gaps), one row per term of a document: its positions, each as the distance from the one before.

    A batch of rows is sorted at once by row and number of the term; no token leaves its batch alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            lists = batch.column(1)
            row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            words = lists.flatten().dictionary_encode()
            sizes = np.bincount(row, minlength=batch.num_rows)
            place = np.arange(1, len(row) + 1) - (np.cumsum(sizes) - sizes)[row]
            used = np.flatnonzero(pc.fill_null(pc.not_equal(words.dictionary.take(words.indices), ""), False).to_numpy(zero_copy_only=False))
            term = words.indices.take(pa.array(used)).to_numpy().astype(np.int64)
            run_of = row[used] * (len(words.dictionary) + 1) + term
            order = np.argsort(run_of, kind="stable")
            place, run_of = place[used][order], run_of[order]
            opens = np.concatenate([[True], run_of[1:] != run_of[:-1]])[: len(order)]
            gaps = np.where(opens, place, np.diff(place, prepend=0))
            first = np.flatnonzero(opens)
            yield pa.RecordBatch.from_arrays(
                [
                    words.dictionary.take(pa.array(term[order][first])),
                    batch.column(0).take(pa.array(row[used][order][first])),
                    pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(gaps, pa.int32())),
                ],
                ["term", doc_id, "gaps"],
            )

    shape = T.StructType([T.StructField("term", T.StringType()), vectors.schema[doc_id], T.StructField("gaps", T.ArrayType(T.IntegerType()))])
    return vectors.select(doc_id, "tokens").mapInArrow(run, shape)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def positions(gaps: pa.Array) -> pa.Array:
    """Positions of a stored list: running sums of all lists of a batch at once."""
    import numpy as np

    sizes = pc.fill_null(pc.list_value_length(gaps), 0).to_numpy().astype(np.int64)
    total = np.cumsum(gaps.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    ends = np.cumsum(sizes)
    before = np.concatenate([[0], total])[ends - sizes]
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(total - np.repeat(before, sizes), pa.int32()), mask=gaps.is_null())


def write_index(vectors: DataFrame, doc_id: str, location: str, buckets: int = BUCKETS, mode: str = "append") -> None:
    """Add documents to the index at ``location``: position lists and the number of documents of each term, both in folders
    by hash of the term. Further documents are appended; counts of the parts are summed when read."""
    lists = cut_lineage(position_lists(vectors, doc_id).withColumn("bucket", _bucket(buckets)))
    counts = lists.groupBy("bucket", "term").agg(F.count("*").alias("docs"))
    # a frequent term is spread over several files of its folder
    lists.repartition("bucket", F.pmod(F.xxhash64(doc_id), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(f"{location}/lists")
    counts.repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(f"{location}/counts")


def read_index(spark: SparkSession, location: str, kind: str, buckets: list[int] | None = None) -> DataFrame:
    """``lists`` or ``counts`` of the index; of the folders ``buckets`` alone where given."""
    rows = spark.read.parquet(f"{location}/{kind}")
    return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))


def search_index(
    queries: DataFrame, location: str, vectors: DataFrame, doc_id: str, limit: int = 10, rank: str = "cover", buckets: int = BUCKETS
) -> DataFrame:
    """``search_pages`` with the stored index: counts of the asked terms choose each query's rarest one, the folders of
    those terms give the candidates, and one pass over the documents checks and ranks them."""
    spark = queries.sparkSession
    asked = queries.filter(F.size("terms") > 0).select("query_id", F.array_distinct("terms").alias("terms"))
    by_term = cut_lineage(asked.select("query_id", "terms", F.explode("terms").alias("term")).withColumn("bucket", _bucket(buckets)))
    folders = lambda rows: sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # noqa: E731  at most ``buckets``
    counts = read_index(spark, location, "counts", folders(by_term)).groupBy("bucket", "term").agg(F.sum("docs").alias("docs"))
    rarest = small_side(
        by_term.join(counts, ["bucket", "term"]).groupBy("query_id", "terms")
        .agg(F.min_by(F.struct("bucket", "term"), F.struct("docs", "term")).alias("r"), F.count(F.lit(1)).alias("known"))
        .filter(F.col("known") == F.size("terms"))
        .select("query_id", "terms", "r.bucket", "r.term")
    )
    lists = read_index(spark, location, "lists", folders(rarest))
    holders = small_side(lists.join(rarest, ["bucket", "term"]).select("query_id", "terms", doc_id))
    found = vectors.select(doc_id, "tokens").join(holders, doc_id).filter(F.size(F.array_except("terms", "tokens")) == 0)
    return _ranked(found.select("query_id", "terms", doc_id, "tokens"), doc_id, limit, rank)
