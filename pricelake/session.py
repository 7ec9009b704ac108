"""Session helpers: a tuned builder for tests and benches, checkpointing, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark 4 reads the checkpoint folder from this key; a cluster sets it to shared storage.
CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", app: str = "pricelake", shuffle: int = 8, **conf: str) -> SparkSession:
    """Local session for tests and benches. On a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach: the one the session names in ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode, where the session names none (tests).
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get(CHECKPOINT_KEY, None)
        if not shared:
            if not sc.master.startswith("local"):
                raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="pricelake-ckpt-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20  # texts differ in length: a batch for a Python worker is bounded by bytes, not by rows alone


def ship_code(spark: SparkSession) -> None:
    """Python workers need the package; executors get it as one zip, once per application. Batches for workers are bounded."""
    batch = spark.conf.get(BATCH_KEY).rstrip("b")
    if batch.isdigit() and int(batch) > BATCH_BYTES:  # Spark's default; a size set in another unit is the user's
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="pricelake-"), "pricelake.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(os.path.join(root, "pricelake")):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def collect_bounded(df: DataFrame, limit: int) -> list | None:
    """Rows of ``df`` when there are at most ``limit`` of them, else ``None``.

    The check itself never brings more than ``limit + 1`` rows to the driver.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


BROADCAST_BYTES = 8 << 20


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows of a table that is written down: numbers as eight, all else by its text."""
    fixed = ("int", "bigint", "double", "float", "boolean", "timestamp", "date", "smallint", "tinyint")
    parts = [
        F.lit(8) if kind in fixed else F.coalesce(F.octet_length(F.col(f"`{name}`") if kind == "string" else F.to_json(F.struct(f"`{name}`"))), F.lit(0))
        for name, kind in df.dtypes
    ]
    return df.agg(F.sum(sum(parts, F.lit(8)))).first()[0] or 0


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Side of a join, written down and measured: broadcast while its rows have at most ``max_bytes``.

    A larger side is returned as it is, and the join shuffles.
    """
    pinned = cut_lineage(df)
    return F.broadcast(pinned) if measured_bytes(pinned) <= max_bytes else pinned


def among(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of a large table whose key the ``wanted`` rows have; these are broadcast while they are few.

    A predicate moves below the steps that build other columns or gather rows by key, where a join would stay above them.
    """
    return table.filter(F.col(key).isin(small_side(wanted.select(key).distinct())))
