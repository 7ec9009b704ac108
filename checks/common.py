"""Registry of check queries: a Spark callable, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.session import shared_folder
from pricelake.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool | None = None) -> DataFrame:
    """Texts and pages cost much per row and are spread over the cores unless told otherwise."""
    heavy = name in ("documents", "pages", "conversations") if spread is None else spread
    return read_table(spark, f"{sf_dir}/{name}.parquet", heavy)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Rows written once as Parquet, for tables that many steps read."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def stamp(col: str | Column, name: str | None = None) -> Column:
    """Timestamps are compared as text."""
    out = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    return out.alias(name or (col if isinstance(col, str) else "ts"))


def sql_stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_any_contains(col: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in tokens) + ")"
