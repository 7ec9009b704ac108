"""Geographic validation of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.functions import geo
from pricelake.operators.store import decision_key, reuse_decisions


def check_places(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) requests after country and city normalisation."""
    code = geo.country_code(F.col("country"))
    tagged = requests.withColumn("country_code", code).withColumn(
        "reject_reason",
        F.when(F.col("country_code").isNull(), "invalid_country").when(
            F.col("city").isNotNull()
            & (F.col("city") != "")
            & ~geo.city_is_known(F.col("country_code"), F.col("city")),
            "invalid_city",
        ),
    )
    accepted = (
        tagged.filter(F.col("reject_reason").isNull())
        .withColumn("city", F.when(F.col("city") != "", F.initcap(F.col("city"))))
        .drop("reject_reason")
    )
    return accepted, tagged.filter(F.col("reject_reason").isNotNull())


def geo_flags(candidates: DataFrame, mode: str = "label") -> DataFrame:
    """Host test, path test and foreign flag per candidate (columns url, country, optional city)."""
    city = F.col("city") if "city" in candidates.columns else None
    return (
        candidates.withColumn("host_ok", geo.is_country_host(F.col("url"), F.col("country"), mode))
        .withColumn("path_ok", geo.has_country_path(F.col("url"), F.col("country"), city))
        .withColumn("foreign", geo.is_foreign(F.col("url")))
    )


def drop_foreign(candidates: DataFrame) -> DataFrame:
    return candidates.filter(~geo.is_foreign(F.col("url")))


def validate(candidates: DataFrame, decisions: DataFrame, as_of: Column, mode: str = "label", pinned: bool = False) -> DataFrame:
    """Geo status per candidate: stored decision, then host or path rule, else ``unresolved``.

    Unresolved rows are the input of outside labelling; they are kept, not guessed. ``pinned`` as in ``reuse_decisions``.
    """
    keyed = candidates.withColumn("kind", F.lit("geo")).withColumn("key", decision_key("country", "url"))
    known = reuse_decisions(keyed, decisions, as_of, pinned)
    flagged = geo_flags(known, mode)
    status = (
        F.when(F.col("hit") & (F.col("value") == "1"), "true")
        .when(F.col("hit"), "false")
        .when(F.col("host_ok") | F.col("path_ok"), "true")
        .otherwise("unresolved")
    )
    return flagged.withColumn("geo_status", status).drop("kind", "value", "decided_at", "hit")
