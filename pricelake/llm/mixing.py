"""Mixing sources to target weights: words per source, repetition rates, whole copies plus a hash-seeded one.

Result cases. Null text: size 0, taken 0. Null source: a source of its own, last in order. Null doc_id: as an empty one in
the draw. The draw hashes id, source, text and, of rows equal in these, the number of the row, so rows without id and rows
that share one are drawn one by one, and reruns agree. Ties of targets: settled by level, none is preferred. Very long
texts: hashed where they are read; only rows that repeat another are moved. Empty table: no rows. Extra columns, whatever
their names, are ignored by ``mix_rates`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import all_columns, fresh, running_sum, space_words, whole_text
from pricelake.session import cut_lineage, small_side

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
DRAW_BITS = 52


def identity(docs: DataFrame) -> Column:
    """What a document's draw hashes but for the seed and its number among equal rows."""
    return F.concat(
        F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(docs["source"], F.lit(""))),
        F.md5(F.coalesce(docs["text"], F.lit(""))), F.lit(":"),
    )


def draw(identity: Column, number: Column, seed: str) -> Column:
    """Uniform number in [0, 1); the same in every run."""
    key = F.concat(identity, number.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, DRAW_BITS // 4), 16, 10).cast("bigint") / F.lit(float(2**DRAW_BITS))


def copies(rate: Column, identity: Column, number: Column, seed: str) -> Column:
    return F.floor(rate) + (draw(identity, number, seed) < rate - F.floor(rate)).cast("bigint")


def numbered(rows: DataFrame, identity: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``: the number, from 1, among the rows of an ``identity``. Equal rows are told apart by an arbitrary
    number, so that many of them are spread over tasks; which of them has which number makes no difference."""
    spread, one = fresh(rows, "spread", "one")
    marked = rows.withColumns({spread: F.monotonically_increasing_id(), one: F.lit(1)})
    return running_sum(marked, [identity], [*order, spread], one, name).drop(spread, one)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all words. A target
    above ``most`` times its source stops there and the excess goes to the others by weight; each pass settles
    at least one source, and only two sums come to the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("nul", F.col("source").isNull()).withColumn("one", F.lit(1))
    per = running_sum(per, [], ["nul", "source"], "one", "place")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    per = cut_lineage(per.select("source", "source_size", turn.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("limit")))
    whole = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        # level: words for each unit of weight; a source whose limit is lower is full
        over = F.col("limit") <= F.lit(level) * F.col("weight")
        taken, n, open_weight = per.agg(
            F.sum(F.when(over, F.col("limit")).otherwise(0.0)), F.count(F.when(over, 1)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if n == full or not open_weight:
            break
        full, level = n, (whole - taken) / open_weight
    target = F.least(F.col("limit"), F.lit(level) * F.col("weight")) if open_weight else F.col("limit")
    return per.select("source", "source_size", target.alias("target"))


def mix_rates(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, copies for every row: floor(rate) copies and, with probability of the
    rest of the rate, one more. The rate is the source's target over its size, at most ``most``."""
    size = F.size(space_words(whole_text())).cast("bigint")
    slim = numbered(docs.select("doc_id", "source", size.alias("size"), identity(docs).alias("identity")), "identity", [], "number")
    slim = cut_lineage(slim)
    targets = small_side(source_targets(slim, weights, share, most))
    rows = slim.join(targets, slim["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    taken = copies(rate, F.col("identity"), F.col("number"), seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("copies"))


def mixed(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed: str = "mix") -> DataFrame:
    """The documents themselves, each as often as it is taken, with all their columns."""
    slim = cut_lineage(docs.select("source", F.size(space_words(whole_text())).cast("bigint").alias("size"), identity(docs).alias("identity")))
    targets = source_targets(slim, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known, per, same, content, number, one = fresh(docs, "known", "rate", "identity", "content", "number", "copy")
    rates = small_side(targets.select(F.col("source").alias(known), rate.alias(per)))
    several = small_side(slim.groupBy("identity").agg(F.count("*").alias("n")).where("n > 1").select(F.col("identity").alias(same)))
    every = docs.withColumns({same: identity(docs), content: all_columns(docs)})
    single = every.join(several, same, "left_anti").withColumn(number, F.lit(1).cast("bigint"))
    repeated = numbered(every.join(several, same, "left_semi"), same, [content], number)
    rows = single.unionByName(repeated).join(rates, F.col("source").eqNullSafe(F.col(known)))
    taken = copies(F.col(per), F.col(same), F.col(number), seed).cast("int")
    return rows.withColumn(one, F.explode(F.array_repeat(F.lit(0), taken))).drop(known, per, same, content, number, one)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, concat(coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(source, '')), md5(coalesce(text, '')), ':') AS identity, CAST(CASE WHEN text IS NULL THEN 0
    ELSE len(list_filter(string_split_regex(text, '[ \x09-\x0d]+'), lambda w: w <> '')) END AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS lim,
    [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
w AS (
  SELECT 0 AS i, 0.0::DOUBLE AS level, -1::BIGINT AS settled
  UNION ALL
  SELECT i + 1,
    (SELECT (1.5 * sum(source_size) - sum(CASE WHEN lim <= w.level * weight THEN lim ELSE 0 END)) / sum(CASE WHEN lim > w.level * weight THEN weight END) FROM s),
    (SELECT count(*) FROM s WHERE lim <= w.level * weight)
  FROM w WHERE i < (SELECT count(*) FROM s) + 1
    AND (SELECT count(*) FROM s WHERE lim <= w.level * weight) <> w.settled),
l AS (SELECT level FROM w ORDER BY i DESC LIMIT 1),
t AS (SELECT source, source_size, least(lim, (SELECT level FROM l) * weight) AS target FROM s),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(concat('0x', substr(md5(concat(d.identity, row_number() OVER (PARTITION BY d.identity), ':mix')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
