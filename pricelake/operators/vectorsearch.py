"""Semantic search: exact cosine top-k, threshold variant, and a cell index with an exact stop.

A search is a join of chunks of the table with blocks of queries: the table is cut into chunks of bounded size (a cell may
make many chunks), query rows are sent to the chunks they ask, and one matrix product per pair keeps the best ``k``. Queries
are rows from start to end; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelake.functions.vectors import nearest, unit_rows
from pricelake.session import cut_lineage, small_side

CHUNK_ROWS = 20_000  # table rows that meet a block of queries at once
BLOCK_QUERIES = 100_000  # query rows that meet a chunk at once; the table is read once for as many


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, row, vector): rows may share an id, ``row`` tells them apart."""
    vector = F.col("vector").cast("array<double>")
    return queries.select(F.col("query_id").cast("string").alias("query_id"), F.xxhash64("query_id", vector).alias("row"), vector.alias("vector"))


def _best(found: DataFrame, id_col: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "distance", "rank")


def _join(rows: DataFrame, asked: DataFrame, k: int, max_distance: float | None = None) -> DataFrame:
    """(query_id, row, id, distance): each query's best ``k`` of every chunk of the cells that it asks.

    ``rows(id, vec, cell)``, ``asked(query_id, row, vector, cell)``.
    """
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
    plan = small_side(sizes.join(blocks, "cell"))  # one row for each cell
    number = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(plan, "cell").withColumn("chunk", number("id", "chunks")).withColumn("block", every("blocks"))
    right = asked.join(plan, "cell").withColumn("block", number("row", "blocks")).withColumn("chunk", every("chunks"))
    keys, kind = ["cell", "chunk", "block"], rows.schema["id"].dataType.simpleString()
    left, right = left.select(*keys, "id", "vec"), right.select(*keys, "query_id", "row", "vector")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        nearest(k, max_distance), f"query_id string, row long, id {kind}, distance double"
    )


def semantic_search(
    table: DataFrame, id_col: str, vec_col: str, queries: DataFrame, k: int = 10, max_distance: float | None = None
) -> DataFrame:
    """``k`` nearest rows per query (query_id, vector) as (query_id, <id_col>, distance, rank); ``max_distance`` filters
    before the cut, ties are broken by id. Vectors without a direction find nothing and are not found."""
    # one cell; as a plain constant it would drop out of the joins as their key
    whole = lambda key: F.pmod(F.xxhash64(key), F.lit(1)).cast("int").alias("cell")
    rows = table.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), whole(id_col))
    return _best(_join(rows, _asked(queries).withColumn("cell", whole("row")), k, max_distance), id_col, k)


def label_centroids(table: DataFrame, label: str, vec_col: str) -> DataFrame:
    """Mean vector per label as query rows; whole vectors are summed before the shuffle."""
    vectors = table.select(label, array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("v"))
    return vectors.groupBy(label).agg(Summarizer.mean(F.col("v")).alias("m")).select(
        F.col(label).cast("string").alias("query_id"), vector_to_array("m").alias("vector")
    )


# -- cells -----------------------------------------------------------------------------------
def fit_cells(table: DataFrame, vec_col: str, cells: int, seed: int = 7, iterations: int = 10) -> KMeansModel:
    """Cells of the index, clustered on unit vectors."""
    unit = _unit(table, vec_col)
    return KMeans(k=cells, seed=seed, maxIter=iterations, featuresCol="features", predictionCol="cell").fit(unit)


def _unit(table: DataFrame, vec_col: str) -> DataFrame:
    norm = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda a, x: a + x * x))
    return table.withColumn("__norm", norm).filter(F.col("__norm") > 0).withColumn(
        "features", array_to_vector(F.transform(vec_col, lambda x: x.cast("double") / F.col("__norm")))
    ).drop("__norm")


def assign_cells(table: DataFrame, vec_col: str, model: KMeansModel) -> DataFrame:
    """Table with its cell; write it ``partitionBy('cell')`` so a search reads the probed cells only."""
    return model.transform(_unit(table, vec_col)).drop("features")


def _centers(model: KMeansModel) -> np.ndarray:
    return np.array(model.clusterCenters())


def cell_radii(indexed: DataFrame, vec_col: str, model: KMeansModel) -> DataFrame:
    """(cell, radius): largest distance of a cell's unit vectors from its centre. Kept beside the index."""
    centers = _centers(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = unit_rows(batch.column("vec"))
            if len(at):
                cells = batch.column("cell").to_numpy()[at]
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(np.linalg.norm(rows - centers[cells], axis=1))], ["cell", "gap"])

    gaps = indexed.select("cell", F.col(vec_col).alias("vec")).mapInArrow(run, "cell int, gap double")
    return gaps.groupBy("cell").agg(F.max("gap").alias("radius"))


def _gaps(asked: DataFrame, model: KMeansModel) -> DataFrame:
    """Query rows with ``near``: struct(gap, cell) of every cell, nearest centre first."""
    centers = _centers(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = unit_rows(batch.column("vector"))
            near = []
            for row in rows:
                gap = np.linalg.norm(centers - row, axis=1)
                near.append([{"gap": gap[c], "cell": int(c)} for c in np.argsort(gap, kind="stable")])
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(near, pa.list_(pa.struct([("gap", pa.float64()), ("cell", pa.int32())])))], ["query_id", "row", "vector", "near"]
            )

    return asked.mapInArrow(run, "query_id string, row long, vector array<double>, near array<struct<gap:double,cell:int>>")


def approximate_search(
    indexed: DataFrame, id_col: str, vec_col: str, model: KMeansModel, queries: DataFrame, k: int = 10, probes: int | None = None
) -> DataFrame:
    """Cosine top-k inside the ``probes`` nearest cells of each query, by default three of four cells."""
    cells = len(_centers(model))
    probes = -(-3 * cells // 4) if probes is None else probes
    rows = indexed.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), "cell")
    near = _gaps(_asked(queries), model)
    return _best(_join(rows, cut_lineage(_probed(near, F.slice("near", 1, probes))), k), id_col, k)


def _probed(near: DataFrame, cells: Column) -> DataFrame:
    return near.select("query_id", "row", "vector", F.explode(F.transform(cells, lambda c: c["cell"])).alias("cell"))


def cell_search(
    indexed: DataFrame, id_col: str, vec_col: str, model: KMeansModel, queries: DataFrame, k: int = 10, probes: int = 1, radii: DataFrame | None = None
) -> DataFrame:
    """Exact cosine top-k that leaves out cells: (query_id, <id_col>, distance, rank, cells).

    The ``probes`` nearest cells give each query a k-th distance. By the triangle inequality no vector of a cell is nearer
    than the gap to its centre less its radius, so only cells whose bound is below the k-th distance are read in
    the second step, and all others hold nothing better. ``cells`` is the number of cells that the query read.
    """
    radii = small_side(cell_radii(indexed, vec_col, model) if radii is None else radii)  # one row for each cell
    rows = indexed.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), "cell")
    near = cut_lineage(_gaps(_asked(queries).distinct(), model))
    first = cut_lineage(_join(rows, _probed(near, F.slice("near", 1, probes)), k))
    last = F.row_number().over(Window.partitionBy("row").orderBy("distance", "id"))
    kth = first.withColumn("n", last).filter(F.col("n") == k).select("row", F.sqrt(2 * F.greatest("distance", F.lit(0.0))).alias("reach"))
    rest = near.select("query_id", "row", "vector", F.explode(F.slice("near", probes + 1, max(1, len(_centers(model))))).alias("c"))
    rest = rest.select("query_id", "row", "vector", F.col("c.cell").alias("cell"), F.col("c.gap").alias("gap")).join(radii, "cell").join(kth, "row", "left")
    open_cells = cut_lineage(rest.filter(F.col("reach").isNull() | (F.col("gap") - F.col("radius") <= F.col("reach") + 1e-4)).select("query_id", "row", "vector", "cell"))
    found = first.union(_join(rows, open_cells, k))
    read = open_cells.groupBy("query_id").agg(F.count("*").alias("more"))
    best = _best(found, id_col, k).join(read, "query_id", "left")
    return best.withColumn("cells", (F.coalesce("more", F.lit(0)) + probes).cast("int")).drop("more")
