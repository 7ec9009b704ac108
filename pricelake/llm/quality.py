"""Quality rules: fixed base rules and robust multivariate outliers, in DataFrame operations only.

Each text becomes a short vector of transformed statistics. For every language and source the minimum covariance
determinant is sought by concentration steps from several starts: medians with median deviations, and small random
subsets drawn by hash. In a step the ``KEPT_PART`` of the rows with the smallest Mahalanobis distances give the next mean
and covariance. A start goes on as long as its determinant falls; the smallest determinant of a group wins. Its
covariance times ``CONSISTENCY`` is that of normal rows. A row whose distance is then above ``CUTOFF`` is rejected.

A step is one aggregation of narrow rows by group and distance bin: counts, sums and cross sums are added up over the
bins that hold the nearest rows, so no group is sorted or gathered, and only one row per group and bin is shuffled.
Groups of fewer than ``LEAST_ROWS`` rows have no covariance of their own; they pool by language, and what is too small
even then in one last group. A floor is added to each variance, since a statistic may be constant in most texts.

Result cases. Null text: no words, fails the base rules. Null language or source: a group like any other. Null doc_id,
repeated rows: a result row each. Very long texts: whole. Ties: equal vectors get equal verdicts. Empty table: no rows.
Extra columns are ignored by ``verdicts`` and kept by ``good_documents``, where each row has its own verdict, whatever
rows share its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelake.functions.expr import let
from pricelake.llm.common import row_key, space_words, whole_text, without
from pricelake.session import cut_lineage, small_side

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30
KEPT_PART = 0.75
# the part divided by the chi-squared distribution (seven degrees of freedom) at the part's quantile of that with five
CONSISTENCY = 1.4121
RANDOM_STARTS = 2
SUBSET_ROWS = 24
LEAST_FALL = 1e-3  # of a determinant's logarithm
LEAST_ROWS = 60
# the 0.999 quantile of the chi-squared distribution with five degrees of freedom
CUTOFF = 20.5
# statistics and the least standard deviation each is given
FLOORS = {"length": 0.8, "word_length": 0.12, "symbols": 0.8, "dup_lines": 0.15, "repeats": 0.12}
STATS = list(FLOORS)
GRID = 4096
BINS_PER_E = 16


def repeat_words(words: Column) -> Column:
    """Number of words inside windows of eight words that stand in the list twice or more."""

    def joined(h: Column, step: int) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def covered(p: Column) -> Column:
        parts = F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW))))
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, x: n + x)

    def places(s: Column) -> Column:
        twin = F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]), e["i"]))
        return F.sort_array(F.filter(twin, lambda i: i.isNotNull()))

    def count(h: Column) -> Column:
        numbered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
            let(numbered, lambda s: let(places(s), covered))
        )

    single = F.transform(words, lambda w: F.xxhash64(w))
    pairs = let(single, lambda h: joined(h, 1))
    fours = let(pairs, lambda h: joined(h, 2))
    return let(let(fours, lambda h: joined(h, 4)), count)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, row_key and the counts of every text."""
    rows = docs.select("doc_id", "lang", "source", row_key(docs, "lang", "source").alias("row_key"), whole_text().alias("text")).withColumn("words", space_words(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return rows.withColumn("lines", lines).select(
        "doc_id", "lang", "source", "row_key", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"), repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def vectors(rows: DataFrame) -> DataFrame:
    """Add ``base_failed``, the transformed statistics and ``scope``, the group a row is judged in."""
    n = F.greatest("n_words", F.lit(1))
    values = {
        "length": F.log1p("n_words"), "word_length": F.log(F.greatest("word_chars", F.lit(1)) / n),
        "symbols": F.log1p(100 * F.col("n_symbols") / n), "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
    }
    # on a grid, so that sums do not depend on their order
    rows = rows.select("*", *[(F.round(v * GRID) / GRID).alias(k) for k, v in values.items()])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    sizes = rows.where("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = sizes.withColumn("big", F.col("n") >= LEAST_ROWS)
    pooled = by_lang.where("NOT big").groupBy(F.col("lang").alias("of")).agg((F.sum("n") >= LEAST_ROWS).alias("pool_big"))
    own = F.when(F.col("big"), F.struct(F.lit(2).alias("level"), "lang", "source"))
    pool = F.when(F.col("pool_big"), F.struct(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source")))
    last = F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    scopes = small_side(by_lang.join(pooled, F.col("lang").eqNullSafe(F.col("of")), "left").select(
        F.col("lang").alias("l"), F.col("source").alias("s"), F.xxhash64(F.to_json(F.coalesce(own, pool, last))).alias("scope")
    ))
    return rows.join(scopes, rows["lang"].eqNullSafe(scopes["l"]) & rows["source"].eqNullSafe(scopes["s"]), "left").drop("l", "s")


def _medians(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row per scope with the median of each value, to a bin of 1/64; counts by bin, no sorting."""
    bins = rows.select("scope", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(v * 64).cast("long").alias("bin")) for k, v in values.items()])).alias("b"))
    sums = bins.groupBy("scope", "b.k", "b.bin").agg(F.count("*").alias("n"))
    key = Window.partitionBy("scope", "k")
    upto = sums.withColumn("upto", F.sum("n").over(key.orderBy("bin"))).withColumn("all", F.sum("n").over(key))
    middle = upto.where(2 * F.col("upto") >= F.col("all")).groupBy("scope", "k").agg((F.min("bin") / 64).alias("m"))
    return middle.groupBy("scope").agg(*[F.max(F.when(F.col("k") == k, F.col("m"))).alias(k) for k in values])


P = range(len(STATS))
CELLS = [(i, j) for i in P for j in range(i + 1)]


def _sums() -> list[Column]:
    crossed = [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"q{i}{j}") for i, j in CELLS]
    return [F.count("*").alias("n"), *[F.sum(k).alias(f"s{i}") for i, k in enumerate(STATS)], *crossed]


def with_factor(estimates: DataFrame, scale: float = 1.0) -> DataFrame:
    """Add the Cholesky factor ``l<i><j>`` of ``scale`` times the covariance ``c<i><j>`` with floors, and the logarithm of
    its determinant."""
    for i, j in CELLS:
        rest = scale * F.col(f"c{i}{j}") + (FLOORS[STATS[i]] ** 2 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        # the floors keep every pivot positive
        entry = F.sqrt(F.greatest(rest, F.lit(FLOORS[STATS[i]] ** 2 * 1e-3))) if i == j else rest / F.col(f"l{j}{j}")
        estimates = estimates.withColumn(f"l{i}{j}", entry)
    return estimates.withColumn("log_det", 2 * sum((F.log(f"l{i}{i}") for i in P), F.lit(0.0)))


def _moments(sums: DataFrame) -> DataFrame:
    """Means ``m<i>`` and covariances ``c<i><j>`` of each (scope, start), with factor, from counts, sums and cross sums."""
    means = sums.select("*", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in P])
    cov = [(F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i, j in CELLS]
    return with_factor(means.select("scope", "start", *[f"m{i}" for i in P], *cov))


def with_distance(rows: DataFrame, factor: DataFrame) -> DataFrame:
    """Add ``start`` and ``d2``, the squared Mahalanobis distance, by forward substitution: a row for each of a scope's
    estimates, or one with nulls where there is none."""
    used = ["scope", "start", *[f"m{i}" for i in P], *[f"l{i}{j}" for i, j in CELLS]]
    out = rows.join(factor.select(*used), "scope", "left")
    for i, name in enumerate(STATS):
        rest = F.col(name) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(STATS))), F.col("y0") * F.col("y0"))
    return out.select(*rows.columns, "start", d2.alias("d2"))


def first_estimates(rows: DataFrame) -> DataFrame:
    """Start 0: medians and median deviations, uncorrelated. Starts 1 and on: rows drawn by hash."""
    middle = _medians(rows, {k: F.col(k) for k in STATS})
    named = small_side(middle.select("scope", *[F.col(k).alias(f"m{i}") for i, k in enumerate(STATS)]))
    apart = _medians(rows.join(named, "scope"), {k: F.abs(F.col(k) - F.col(f"m{i}")) for i, k in enumerate(STATS)})
    spread = [(F.pow(1.4826 * F.col(STATS[i]), F.lit(2)) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in CELLS]
    medians = with_factor(named.join(apart, "scope").select("scope", F.lit(0).alias("start"), *[f"m{i}" for i in P], *spread))
    # some SUBSET_ROWS of each scope, summed where they are; copies of a text have one hash each, by their id
    sizes = small_side(rows.groupBy("scope").agg(F.count("*").alias("size")))
    drawn = rows.join(sizes, "scope").withColumn("start", F.explode(F.array(*[F.lit(s + 1) for s in range(RANDOM_STARTS)])))
    unit = F.pmod(F.xxhash64("row_key", "doc_id", "start"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = drawn.where(unit * F.col("size") < SUBSET_ROWS)
    return medians.unionByName(_moments(few.groupBy("scope", "start").agg(*_sums())))


def concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step of each start: mean and covariance of the nearest ``KEPT_PART`` of its scope's rows."""
    near = with_distance(rows, estimates).where("start IS NOT NULL").withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * BINS_PER_E))
    sums = near.groupBy("scope", "start", "bin").agg(*_sums())
    key = Window.partitionBy("scope", "start")
    nearest = sums.withColumn("before", F.sum("n").over(key.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(key))
    nearest = nearest.where(F.col("before") < KEPT_PART * F.col("all")).drop("bin", "before", "all")
    return _moments(nearest.groupBy("scope", "start").agg(*[F.sum(c).alias(c) for c in nearest.columns if c not in ("scope", "start")]))


def least_determinants(rows: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """The estimate of the smallest determinant for each scope, scaled to normal rows.

    ``rows`` have the statistics, ``scope``, ``doc_id`` and ``row_key``. A start rests when its determinant does not fall by
    ``LEAST_FALL`` any more; only the others go on. Determinants have a floor and never rise, so all come to rest. The
    first step is always taken, since a start's own determinant is not that of a ``KEPT_PART``.
    """
    active = small_side(concentrated(rows, small_side(first_estimates(rows) if starts is None else starts)))
    rested = None
    while not active.isEmpty():
        was = active.select("scope", "start", F.col("log_det").alias("was"))
        step = cut_lineage(concentrated(rows, active).join(was, ["scope", "start"]))
        falls = F.col("log_det") < F.col("was") - LEAST_FALL
        still = active.join(step.where(~falls).select("scope", "start"), ["scope", "start"], "left_semi")
        rested = still if rested is None else rested.unionByName(still)
        active = small_side(step.where(falls).drop("was"))
    if rested is None:
        return active
    values = [c for c in rested.columns if c != "scope"]
    best = rested.groupBy("scope").agg(F.min_by(F.struct(*values), F.struct("log_det", "start")).alias("b"))
    return with_factor(best.select("scope", "b.*"), CONSISTENCY)


def keyed_verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``verdicts`` and the row_key each was given to."""
    rows = cut_lineage(vectors(cut_lineage(counts(docs))))
    judged = rows.where("NOT base_failed")
    apart = with_distance(rows, small_side(least_determinants(judged)))
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    return apart.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= cutoff)).alias("kept"), d2.alias("d2"), "row_key",
    )


def verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, counts, base_failed, d2 (null where the base rules fail) and kept for every row."""
    return keyed_verdicts(docs, cutoff).drop("row_key")


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept."""
    bad = keyed_verdicts(docs).where("NOT kept").select("doc_id", "row_key")
    return without(docs, bad, row_key(docs, "lang", "source"))
