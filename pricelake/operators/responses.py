"""Recovery of answers stored as text: ``responses(id, raw_text)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.functions import jsonfix, rules
from pricelake.functions.expr import let


# whole text is one JSON value; a parser alone would stop after the first value
_WHOLE = r'(?s)^\s*(?:\{.*\}|\[.*\]|"(?:[^"\\]++|\\.)*+")\s*$'


def _attempt(method: str, text: Column) -> Column:
    """struct(method, recovered) when the text is JSON, else null."""
    return let(
        text,
        lambda t: F.when(
            t.rlike(_WHOLE) & F.try_parse_json(t).isNotNull(),
            F.struct(F.lit(method).alias("method"), t.alias("recovered")),
        ),
    )


def recover_json(responses: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``recovered`` (JSON text) and the ``method`` that produced it, in one narrow pass.

    The balanced scan needs Python; it is handed null for rows the native steps already solved.
    """
    raw, fenced = F.col(text), F.col("__fenced")
    native = responses.withColumn("__fenced", jsonfix.strip_fence(raw)).withColumn(
        "__native",
        F.coalesce(
            _attempt("direct", jsonfix.strip(raw)),
            _attempt("fence", fenced),
            _attempt("comments", jsonfix.drop_trailing_commas(jsonfix.drop_comments(fenced))),
        ),
    )
    block = native.withColumn("__block", jsonfix.first_balanced(F.when(F.col("__native").isNull(), fenced)))
    best = F.coalesce(
        F.col("__native"),
        _attempt("balanced", F.col("__block")),
        _attempt("balanced_comments", jsonfix.drop_trailing_commas(jsonfix.drop_comments(F.col("__block")))),
        _attempt("closed", jsonfix.close_truncated(jsonfix.drop_comments(fenced))),
    )
    return block.withColumn("__best", best).select(
        *responses.columns,
        F.coalesce("__best.method", F.lit("error_parsing_json")).alias("method"),
        F.col("__best.recovered").alias("recovered"),
    )


def response_queries(responses: DataFrame, text: str = "raw_text") -> DataFrame:
    """Query lists: a JSON array, ``{"queries": [...]}`` or either inside a JSON string; else by pattern."""
    rows = recover_json(responses, text)
    inner = F.when(
        F.col("recovered").rlike(r'^\s*"'), F.try_variant_get(F.try_parse_json("recovered"), "$", "string")
    ).otherwise(F.col("recovered"))
    listed = F.coalesce(
        F.from_json(F.when(inner.rlike(r"^\s*\["), inner), "array<string>"),
        F.from_json(F.get_json_object(inner, "$.queries"), "array<string>"),
    )
    kept = F.filter(listed, lambda q: q.isNotNull())
    by_pattern = jsonfix.recover_queries(F.col(text))
    found = (
        F.when(F.size(kept) > 0, kept).when(F.size(by_pattern) > 0, by_pattern).otherwise(F.array().cast("array<string>"))
    )
    method = (
        F.when(F.size(kept) > 0, F.col("method")).when(F.size(by_pattern) > 0, "pattern").otherwise("failed")
    )
    return rows.withColumn("queries", found).withColumn("method", method)


def response_fields(responses: DataFrame, text: str = "raw_text", fields: list[str] | None = None) -> DataFrame:
    """Typed page fields; unparsable answers fall back to field recovery, then to an error type."""
    wanted = fields or rules.RESPONSE_FIELDS
    rows = recover_json(responses, text)
    parsed = F.try_parse_json("recovered")
    by_pattern = {f: jsonfix.recover_field(F.col(text), f) for f in wanted}
    good = F.col("recovered").isNotNull()
    out = rows
    for f in wanted:
        out = out.withColumn(
            f, F.when(good, F.try_variant_get(parsed, f"$.{f}", "string")).otherwise(by_pattern[f])
        )
    if "page_type" in wanted:
        recovered = ~good & F.col("page_type").isNotNull()
        out = out.withColumn("method", F.when(recovered, "fields").otherwise(F.col("method"))).withColumn(
            "page_type",
            F.coalesce("page_type", F.when(good, "ERROR_LLM_NULL_PAGE_TYPE").otherwise("ERROR_PARSING_JSON")),
        )
    return out


def chosen_indices(responses: DataFrame, items: DataFrame, text: str = "raw_text") -> DataFrame:
    """Items picked by 1-based index lists; an unparsable answer keeps all its items.

    ``items(id, index, ...)`` holds the list each answer was about.
    """
    rows = recover_json(responses, text)
    picked = F.from_json(
        F.coalesce(F.get_json_object("recovered", "$.product_url_indices"), F.when(F.col("recovered").rlike(r"^\s*\["), F.col("recovered"))),
        "array<bigint>",
    )
    answers = rows.select("id", F.col("recovered").isNull().alias("__all"), picked.alias("__picked"))
    return (
        items.join(answers, "id")
        .filter(F.col("__all") | F.coalesce(F.array_contains("__picked", F.col("index").cast("bigint")), F.lit(False)))
        .drop("__all", "__picked")
    )


def recovery_report(recovered: DataFrame) -> DataFrame:
    return recovered.groupBy("method").agg(F.count(F.lit(1)).alias("responses"))
