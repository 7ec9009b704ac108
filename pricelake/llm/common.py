"""Small helpers of the corpus operators: reading, global running sums, connected components, shared files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelake.session import cut_lineage, shared_folder, small_side

WAVES = 8  # tasks per core
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def row_key(df: DataFrame, *names: str) -> Column:
    """Narrow key of a row: hash of its text and of the named columns, a null apart from every value. It stands beside
    the id, so rows whose id is null or repeated are told apart without moving texts."""
    values = [x for name in ("text", *names) for x in (df[name].isNull(), df[name])]
    return F.xxhash64(*values)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        return name if name.lower() not in taken else free(f"{name}_")

    return [free(name) for name in names]


def all_columns(docs: DataFrame) -> Column:
    """Hash of everything in a row; maps count by their text, and a null apart from every value."""
    values = [F.to_json(F.struct(docs[name])) if "map<" in kind or kind == "variant" else docs[name] for name, kind in docs.dtypes]
    return F.xxhash64(*[x for value in values for x in (value.isNull(), value)])


def without(docs: DataFrame, bad: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` whose id and key are not a row of ``bad`` (id, key)."""
    return docs.join(*_same_row(docs, bad, key), "left_anti")


def only(docs: DataFrame, good: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` whose id and key are a row of ``good`` (id, key)."""
    return docs.join(*_same_row(docs, good, key), "left_semi")


def _same_row(docs: DataFrame, keys: DataFrame, key: Column) -> tuple[DataFrame, Column]:
    theirs, own = fresh(docs, "their_id", "their_key")
    side = small_side(keys.distinct().toDF(theirs, own))
    return side, F.col("doc_id").eqNullSafe(F.col(theirs)) & (key == F.col(own))


def space_words(text: Column) -> Column:
    """Words between spaces and the controls tab to carriage return."""
    return F.array_remove(F.split(text, r"[ \x09-\x0d]+", -1), "")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: sum of ``value`` over the rows of the key up to and including this one, in ``order``.

    Works for keys of any size: rows go to range partitions on (keys, order), which the checkpoint pins;
    sums run inside a partition, and one row per (key, partition) carries what lies before it.
    """
    at, part, inside, total, before = fresh(df, "__id", "__part", "__inside", "__sum", "__before")
    pinned = cut_lineage(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn(at, F.monotonically_increasing_id())
    ).withColumn(part, F.shiftright(at, 33))
    parts = pinned.groupBy(*keys, part).agg(F.sum(value).alias(total))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn(before, F.coalesce(F.sum(total).over(earlier), F.lit(0))).drop(total)
    so_far = Window.partitionBy(*keys, part).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = pinned.withColumn(inside, F.sum(value).over(so_far))
    same = [rows[k].eqNullSafe(parts[k]) for k in [*keys, part]]
    return rows.join(parts, same).select(*[rows[c] for c in df.columns], (rows[inside] + parts[before]).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it can reach.

    Large-star and small-star rounds: every node points its larger neighbours, then itself and its smaller
    ones, at the smallest node it knows. Each round is two aggregations and joins and ends in a checkpoint;
    the number of edges never grows. Self loops and repeated edges do no harm; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = cut_lineage(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi").distinct())
    seen = None
    while (sign := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())) != seen:
        seen = sign
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(smallest, "hi").where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .union(smallest.select("m", "hi")).distinct()
        )
        now = cut_lineage(small)
    roots = now.select("lo").distinct().join(now.select(F.col("hi").alias("lo")), "lo", "left_anti")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots.select("lo", "lo"))


def run_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's address in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def file_system(address: str):
    """(Arrow file system, path in it) of a shared address; inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("file:") else f"file://{address}")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Short rows that stand for long work, dealt over tasks: a number of partitions is given, since by their size
    alone Spark would merge them into one."""
    return rows.repartition(max(1, min(rows.count(), WAVES * rows.sparkSession.sparkContext.defaultParallelism)), *keys)
