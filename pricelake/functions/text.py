"""Text Column expressions: tokenizers, blocked-page marks, page title and headings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelake.functions import rules

# Plain-letter forms for optional accent folding before tokenizing.
ACCENTED, FOLDED = "áàäâãéèëêíìïîóòöôõúùüûñç", "aaaaaeeeeiiiiooooouuuunc"


def blank_to_null(col: Column) -> Column:
    """The data model treats an empty string like a missing one."""
    return F.when(col != "", col)


def relevance_tokens(text: Column, fold_accents: bool = False) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    if fold_accents:
        low = F.translate(low, ACCENTED, FOLDED)
    return F.filter(
        F.split(low, "[^a-zA-Z0-9]+"),
        lambda t: (F.length(t) > 2) & ~t.isin(rules.RELEVANCE_STOP_WORDS),
    )


def overlap_ratio(wanted: Column, found: Column) -> Column:
    return F.size(F.array_intersect(wanted, found)) / F.greatest(
        F.lit(1), F.size(F.array_distinct(wanted))
    )


def product_name_key(name: Column, fold_accents: bool = False) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    if fold_accents:
        low = F.translate(low, ACCENTED, FOLDED)
    return F.array_join(
        F.filter(
            F.split(low, "[^a-z0-9]+"),
            lambda t: (F.length(t) > 2) & ~t.isin(rules.NAME_STOP_WORDS),
        ),
        " ",
    )


def _words(text: Column) -> Column:
    """Lower-case runs of Unicode letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search_tokens(text: Column) -> Column:
    """Words of the text vector without English stop words."""
    return F.filter(_words(text), lambda t: ~t.isin(rules.ENGLISH_STOP_WORDS))


def positioned_tokens(text: Column) -> Column:
    """Words in place; a stop word leaves an empty place, so word distances stay true."""
    return F.transform(_words(text), lambda t: F.when(t.isin(rules.ENGLISH_STOP_WORDS), "").otherwise(t))


def blocked_html(html: Column, min_chars: int = 0) -> Column:
    """struct(blocked, reason) for a fetched result page; one shorter than ``min_chars`` counts as blocked."""
    low = F.lower(html)
    marker = reduce(
        lambda chain, m: chain.when(low.contains(m), f"marker:{m}"),
        rules.BLOCKED_HTML_MARKERS[1:],
        F.when(low.contains(rules.BLOCKED_HTML_MARKERS[0]), f"marker:{rules.BLOCKED_HTML_MARKERS[0]}"),
    )
    tiny = F.when(
        F.length(html) < min_chars, F.concat(F.lit("tiny_html:"), F.length(html))
    )
    reason = blank_to_null(F.concat_ws(",", tiny, marker))
    empty = html.isNull() | (html == "")
    return F.struct(
        (empty | reason.isNotNull()).alias("blocked"),
        F.when(empty, "empty_html").otherwise(F.coalesce(reason, F.lit("ok"))).alias("reason"),
    )


def blocked_text(text: Column) -> Column:
    """struct(blocked, reason) for rendered text."""
    low = F.lower(text)
    marker = F.coalesce(
        *[F.when(low.contains(m), f"marker:{m}") for m in rules.BLOCKED_TEXT_MARKERS]
    )
    empty = text.isNull() | (text == "")
    return F.struct(
        (empty | marker.isNotNull()).alias("blocked"),
        F.when(empty, "empty_text").otherwise(F.coalesce(marker, F.lit("ok"))).alias("reason"),
    )


def html_title(html: Column) -> Column:
    """Raw title text for jobs that need no other page field."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
