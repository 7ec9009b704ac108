"""The stored page table: schema, Parquet/JDBC readers, JSON export and import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.functions.text import blank_to_null

PAGE_SCHEMA = """
    url string, status_code int, content_type string,
    html string, title string, description string, main_content string, full_text string,
    headers map<string, array<string>>, meta_tags map<string, string>, structured_data array<string>,
    links array<string>, images array<struct<src: string, alt: string, title: string>>,
    content_language string, last_modified timestamp, crawled_at timestamp, last_updated timestamp,
    embedding array<float>
"""
# JSON-LD is kept as text in Parquet, so that readers without VARIANT can still use the table;
# ``parsed_structured_data`` gives the variant form.

EXPORT_SCHEMA = """
    url string, status_code int, content_type string, html string, title string, description string,
    main_content string, full_text string, headers map<string, array<string>>,
    meta_tags map<string, string>, structured_data array<string>, links array<string>,
    images array<struct<src: string, alt: string, title: string>>, content_language string,
    last_modified string, crawled_at string, last_updated string, embedding array<float>, text string
"""


def read_pages(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).parquet(location)


def read_pages_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Page table in a database; give partitionColumn/lowerBound/upperBound for a split read."""
    return spark.read.format("jdbc").options(**options).load()


def write_pages(pages: DataFrame, location: str, mode: str = "overwrite") -> None:
    """Partitioned by crawl date, so retention and time filters prune whole folders."""
    (
        pages.withColumn("crawl_date", F.to_date("crawled_at"))
        .write.mode(mode)
        .partitionBy("crawl_date")
        .parquet(location)
    )


def parsed_structured_data(pages: DataFrame) -> DataFrame:
    return pages.withColumn(
        "structured_data",
        F.filter(F.transform("structured_data", F.try_parse_json), lambda v: v.isNotNull()),
    )


def _iso(col: str):
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def export_records(pages: DataFrame) -> DataFrame:
    """Export shape: ISO timestamps, ``text`` fallback chain, nested ``metadata``."""
    stamped = pages
    for name in ("last_modified", "crawled_at", "last_updated"):
        stamped = stamped.withColumn(name, _iso(name))
    text = F.coalesce(blank_to_null(F.col("full_text")), blank_to_null(F.col("main_content")), F.lit(""))
    metadata = F.struct(
        "status_code", "content_type", "last_modified", "content_language", "meta_tags",
        F.col("headers").alias("headers_hierarchy"), "images", "structured_data", "main_content",
    )
    return stamped.withColumn("text", text).withColumn("metadata", metadata)


def export_json(pages: DataFrame) -> DataFrame:
    records = export_records(pages)
    return records.select("url", F.to_json(F.struct(*records.columns)).alias("record"))


def import_json(records: DataFrame, column: str = "record") -> DataFrame:
    """Rows of an export back into the page schema."""
    row = F.from_json(F.col(column), EXPORT_SCHEMA)
    flat = records.select(row.alias("r")).select("r.*").drop("text")
    for name in ("last_modified", "crawled_at", "last_updated"):
        flat = flat.withColumn(name, F.try_to_timestamp(F.col(name)))
    return flat
