"""Similarity helpers for product-name clustering."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def match_ratio(later: pd.Series, earlier: pd.Series) -> pd.Series:
    """Matching-block ratio; the later name is always the first sequence (the ratio is not symmetric)."""
    return pd.Series(
        [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(later, earlier)], dtype="float64"
    )


def indel_budget(a: Column, b: Column, threshold: float) -> Column:
    """Most unmatched characters a pair may have and still reach the threshold."""
    return F.floor((1.0 - threshold) * (F.length(a) + F.length(b)) + 1e-9).cast("int")


def may_match(a: Column, b: Column, threshold: float) -> Column:
    """Necessary condition in the JVM: edit distance never exceeds the unmatched characters."""
    budget = indel_budget(a, b, threshold)
    close = F.abs(F.length(a) - F.length(b)) <= budget
    return close & (F.levenshtein(a, b) <= budget)


def _edits(short: Column, long: Column, threshold: float) -> Column:
    """Most characters of two names of these lengths that may stay unmatched; what matches counts twice, so the
    number has the parity of both lengths together."""
    total = short + long
    most = F.floor((1.0 - threshold) * total + 1e-9).cast("int")
    return most - F.pmod(total - most, F.lit(2))


def _pieces(short: Column, long: Column, threshold: float, key) -> Column:
    """``key(i, first, end, edits)`` for each of the ``edits + 1`` pieces that a name of length ``short`` is cut into when it
    meets one of length ``long``."""
    edits = _edits(short, long, threshold)
    border = lambda i: F.floor(i * short / (edits + 1)).cast("int")
    every = F.transform(F.sequence(F.lit(0), edits), lambda i: key(i, border(i), border(i + 1), edits))
    return F.when(edits >= long - short, every)


def _key(short: Column, long: Column, i: Column, name: Column, first: Column, end: Column) -> Column:
    return F.concat_ws("|", short, long, i, F.substring(name, first + 1, end - first))


def piece_keys(name: Column, threshold: float) -> Column:
    """Keys of a name as the shorter of a pair, for every length the other one may have.

    With at most ``edits`` unmatched characters in both names, one of ``edits + 1`` pieces stands whole in the other name.
    """
    short = F.length(name)
    longest = F.greatest(short, F.floor(short * ((2.0 - threshold) / threshold) + 1e-9).cast("int"))

    def against(long: Column) -> Column:
        return _pieces(short, long, threshold, lambda i, first, end, edits: _key(short, long, i, name, first, end))

    return F.flatten(F.filter(F.transform(F.sequence(short, longest), against), lambda k: k.isNotNull()))


def meeting_keys(name: Column, threshold: float) -> Column:
    """Keys of a name as the longer of a pair: its substrings where a piece of the shorter one can stand.

    Some whole piece i has exactly i unmatched characters before it and at most ``edits - i`` behind it. Before it, each
    moves the piece by one to the left or right; behind it, they must make up the rest of the difference in length.
    """
    long = F.length(name)
    shortest = F.least(long, F.ceil(long * (threshold / (2.0 - threshold)) - 1e-9).cast("int"))

    def against(short: Column) -> Column:
        more = long - short

        def shifted(i: Column, first: Column, end: Column, edits: Column) -> Column:
            low, high = F.greatest(-i, more - edits + i), F.least(i, more + edits - i)
            low = low + F.pmod(low - i, F.lit(2))
            fits = lambda d: (first + d >= 0) & (end + d <= long)
            shifts = F.when(low <= high, F.filter(F.sequence(low, high, F.lit(2)), fits))
            return F.transform(F.coalesce(shifts, F.array().cast("array<int>")), lambda d: _key(short, long, i, name, first + d, end + d))

        return F.flatten(_pieces(short, long, threshold, shifted))

    return F.array_distinct(F.flatten(F.filter(F.transform(F.sequence(shortest, long), against), lambda k: k.isNotNull())))
