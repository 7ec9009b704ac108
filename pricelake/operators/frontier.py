"""Reachability over the stored link graph, with the crawl rules (no fetching)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.functions import urls
from pricelake.functions.expr import let
from pricelake.operators.ordered import ranked
from pricelake.session import BROADCAST_BYTES, cut_lineage, measured_bytes


def allowed_domains(table: DataFrame, domains: list[str], url: str = "url") -> DataFrame:
    return table.filter(urls.netloc(F.col(url)).isin(domains))


def drop_excluded(table: DataFrame, patterns: list[str], url: str = "url") -> DataFrame:
    return table.filter(~urls.exclude_glob(F.col(url), patterns))


def remaining_slots(level: DataFrame, remaining: int) -> DataFrame:
    """First ``remaining`` URLs of a level in order; ranks over range partitions, so any number of slots is spread."""
    return ranked(level, [], ["pos", "url"], "__rank").filter(F.col("__rank") <= remaining).drop("__rank")


def crawl_frontier(
    seeds: DataFrame,
    edges: DataFrame,
    max_depth: int,
    max_pages: int | None = None,
    domains: list[str] | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    """Bounded breadth-first reach: (url, depth, parent) from ``seeds(url, pos)`` over ``edges(src, dst, pos)``.

    Each level is one join, one aggregation that keeps the first parent, and one anti-join with the
    visited set. Levels are cut with a reliable checkpoint; only level sizes reach the driver.
    """

    def admitted(df: DataFrame) -> DataFrame:
        df = df.filter(urls.is_valid_request(F.col("url")))
        if domains:
            df = allowed_domains(df, domains)
        return drop_excluded(df, exclude) if exclude else df

    level = admitted(
        seeds.groupBy("url")
        .agg(F.array(F.min("pos").cast("bigint")).alias("pos"))
        .select("url", "pos", F.lit(None).cast("string").alias("parent"))
    )
    visited, used, depth, known_bytes = None, 0, 0, 0
    while True:
        if max_pages is not None:
            level = remaining_slots(level, max_pages - used)
        level = cut_lineage(level.withColumn("depth", F.lit(depth)))
        size = level.count()
        if size == 0:
            break
        used += size
        visited = level if visited is None else visited.unionByName(level)
        if depth == max_depth or (max_pages is not None and used >= max_pages):
            break
        # order of the next level: order of the parent, then of the link on its page
        # levels are written down, so the small side is measured and never guessed
        near = level.select(F.col("url").alias("src"), F.col("pos").alias("src_pos"))
        known = visited.select("url")
        known_bytes += measured_bytes(level.select("url"))
        reach = (
            (F.broadcast(near) if measured_bytes(near) <= BROADCAST_BYTES else near)
            .join(edges, "src")
            .groupBy(F.col("dst").alias("url"))
            .agg(F.min(F.struct("src_pos", "pos", "src")).alias("first"))
        )
        fresh = admitted(reach.join(F.broadcast(known) if known_bytes <= BROADCAST_BYTES else known, "url", "left_anti"))
        level = fresh.select(
            "url",
            F.concat("first.src_pos", F.array(F.col("first.pos").cast("bigint"))).alias("pos"),
            F.col("first.src").alias("parent"),
        )
        depth += 1
    if visited is None:
        return level.select("url", "depth", "parent")
    return visited.select("url", "depth", "parent")


_RULE = "struct<allow: boolean, path: string>"
_GROUP = f"struct<agents: array<string>, rules: array<{_RULE}>>"
_STATE = f"struct<agents: array<string>, rules: array<{_RULE}>, done: array<{_GROUP}>>"


def _rule_path(value: Column) -> Column:
    """Path of a rule in one spelling: decoded, then percent-encoded but for slashes; a bad escape stays as it is."""
    plain = F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)
    coded = F.url_encode(plain)
    for shown, meant in (("%2F", "/"), ("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(shown), F.lit(meant))
    return F.struct(plain.alias("plain"), coded.alias("coded"))


def robots_rules(robots: DataFrame, user_agent: str) -> DataFrame:
    """Rules of one agent per domain, in file order: (domain, rules).

    A named group wins over ``*``; an empty disallow allows everything. The lines of a file are folded inside its row.
    """
    agent = F.lit(user_agent.split("/")[0].lower())
    bare = lambda text: F.btrim(text, F.lit(" \t\f\v\u00a0"))
    lines = F.transform(F.split(F.coalesce("body", F.lit("")), r"\r\n|[\n\r\v\f]"), lambda l: bare(F.regexp_replace(l, "#.*$", "")))
    parts = F.transform(lines, lambda l: F.struct(
        F.lower(bare(F.substring_index(l, ":", 1))).alias("key"), bare(F.regexp_replace(l, "^[^:]*:", "")).alias("value"),
        l.contains(":").alias("pair"), (l == "").alias("blank"),
    ))
    rows = robots.select("domain", F.filter(parts, lambda p: p["blank"] | p["pair"]).alias("lines"))
    none = F.array().cast("array<string>"), F.array().cast(f"array<{_RULE}>"), F.array().cast(f"array<{_GROUP}>")
    state = lambda agents, rules, done: F.struct(agents.alias("agents"), rules.alias("rules"), done.alias("done")).cast(_STATE)

    def step(held: Column, line: Column) -> Column:
        ruled = F.size(held["rules"]) > 0
        group = F.struct(held["agents"].alias("agents"), held["rules"].alias("rules"))
        done = F.when(ruled, F.concat(held["done"], F.array(group))).otherwise(held["done"])
        name = F.array(F.lower(line["value"]))

        def rule(path: Column) -> Column:
            allow = (line["key"] == "allow") | (path["plain"] == "")
            return F.concat(held["rules"], F.array(F.struct(allow.alias("allow"), path["coded"].alias("path"))))

        return (
            F.when(line["blank"], state(none[0], none[1], done))
            .when(line["key"] == "user-agent", F.when(ruled, state(name, none[1], done)).otherwise(state(F.concat(held["agents"], name), none[1], done)))
            .when(line["key"].isin("allow", "disallow") & (F.size(held["agents"]) > 0), let(_rule_path(line["value"]), lambda p: state(held["agents"], rule(p), held["done"])))
            .otherwise(held)
        )

    end = F.struct(F.lit("").alias("key"), F.lit("").alias("value"), F.lit(False).alias("pair"), F.lit(True).alias("blank"))
    folded = F.aggregate(F.concat("lines", F.array(end)), state(*none), step)["done"]
    groups = rows.select("domain", folded.alias("groups"))
    common = lambda g: F.array_contains(g["agents"], "*")
    named = F.filter("groups", lambda g: ~common(g) & F.exists(g["agents"], lambda a: F.contains(agent, a)))
    chosen = F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(F.filter("groups", common), F.lit(1)))
    return groups.select("domain", F.coalesce(chosen["rules"], none[1]).alias("rules"))


def robots_allowed(table: DataFrame, robots: DataFrame, user_agent: str, url: str = "url") -> DataFrame:
    """Add ``allowed``: first matching rule of the domain, and yes when there is none.

    One row per domain joins the URLs, so a busy domain multiplies nothing.
    """
    target = F.concat(
        F.when(urls.raw_path(F.col(url)) == "", "/").otherwise(urls.raw_path(F.col(url))),
        F.when(urls.query(F.col(url)) != "", F.concat(F.lit("?"), urls.query(F.col(url)))).otherwise(""),
    )
    rules = robots_rules(robots, user_agent)
    joined = table.withColumn("domain", urls.netloc(F.col(url))).withColumn("__target", target).join(rules, "domain", "left")
    first = F.try_element_at(
        F.filter("rules", lambda r: (r["path"] == "*") | F.startswith(F.col("__target"), r["path"])), F.lit(1)
    )
    return joined.withColumn("allowed", F.coalesce(first["allow"], F.lit(True))).drop("__target", "rules")


def crawl_summary(requested: DataFrame) -> DataFrame:
    """Requested and crawled counts from rows with a ``crawled`` flag."""
    return requested.agg(
        F.count(F.lit(1)).alias("requested"), F.count_if("crawled").alias("crawled")
    ).withColumn(
        "success_rate", F.when(F.col("requested") > 0, F.col("crawled") / F.col("requested")).otherwise(0.0)
    )


def request_check(url: Column) -> Column:
    """Reason a crawl request URL is refused, or null."""
    return F.when(url.isNull() | (urls.scheme(url) == "") | (urls.netloc(url) == ""), "invalid_url").when(
        ~urls.scheme(url).isin("http", "https"), "unsupported_scheme"
    )
