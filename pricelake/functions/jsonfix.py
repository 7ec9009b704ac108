"""Repair of JSON texts returned by outside models: Column expressions plus one balanced scan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelake.functions import rules


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_fence(text: Column) -> Column:
    inner = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    return strip(F.when(text.rlike(r"```(?:json)?\s*[\s\S]*?\s*```"), inner).otherwise(text))


@F.pandas_udf(T.StringType())
def first_balanced(texts: pd.Series) -> pd.Series:
    """First balanced ``{...}`` or ``[...]`` of each text, or the trimmed text."""

    def scan(text):
        if text is None:
            return None
        depth, start = 0, None
        for i, c in enumerate(text):
            if c in "{[":
                start = i if start is None else start
                depth += 1
            elif c in "}]" and depth:
                depth -= 1
                if depth == 0:
                    return text[start : i + 1]
        return text.strip()

    return texts.map(scan, na_action="ignore")


def drop_comments(text: Column, compat: bool = False) -> Column:
    """Remove // and /* */ comments. Only ``compat`` also eats what follows ``https:``."""
    line = r"//[^\n]*" if compat else r"(?<!:)//[^\n]*"
    return F.regexp_replace(F.regexp_replace(text, line, ""), r"(?s)/\*.*?\*/", "")


def drop_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def outer_object(text: Column) -> Column:
    """Widest ``{...}`` without line comments and trailing commas."""
    bare = F.regexp_replace(F.regexp_replace(strip(text), r"```json\s*", ""), r"```\s*$", "")
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(body != "", drop_trailing_commas(F.regexp_replace(body, r"(?<!:)//[^\n]*", ""))).otherwise(bare)


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def close_truncated(text: Column) -> Column:
    """Append missing closers; a half-written last string is cut with its comma."""
    body = strip(text)
    need_list = F.greatest(_count(body, "[") - _count(body, "]"), F.lit(0))
    need_map = F.greatest(_count(body, "{") - _count(body, "}"), F.lit(0))
    cut = F.regexp_replace(body, r",+$", "")
    half = F.regexp_extract(cut, r'(?s)^(.+),[^,]*"[^"]*"[^"]*$', 1)
    whole = F.when((_count(cut, '"') % 2 == 1) & (half != ""), half).otherwise(cut)
    fixed = F.concat(whole, F.repeat(F.lit("]"), need_list), F.repeat(F.lit("}"), need_map))
    return F.when((need_list > 0) | (need_map > 0), fixed).otherwise(body)


def recover_field(text: Column, name: str) -> Column:
    """Value of a quoted field; marked as truncated only when its closing quote is missing."""
    hit = F.regexp_extract(text, rf'(?i)"{name}"\s*:\s*"([^"]*)', 1)
    closed = text.rlike(rf'(?i)"{name}"\s*:\s*"[^"]*"')
    found = text.rlike(rf'(?i)"{name}"\s*:\s*"')
    return F.when(found & closed, hit).when(found, F.concat(F.rtrim(hit), F.lit("... (truncated)")))


def recover_queries(text: Column, shortest: int = 5, longest: int = 200) -> Column:
    """Quoted strings of ``shortest`` to ``longest`` characters that look like search queries."""
    quoted = F.regexp_extract_all(text, F.lit(r'"([^"\\]*(?:\\.[^"\\]*)*)"'), 1)
    return F.filter(
        quoted,
        lambda s: ~F.lower(s).isin(rules.RESPONSE_SKIP_KEYS)
        & F.length(s).between(shortest, longest)
        & s.rlike("[ áéíóúñü]"),
    )
