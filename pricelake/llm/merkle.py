"""Merkle manifest of a dataset: digests of rows, a subroot for each language, one root, and proofs.

A leaf is the hash of a row's fields. The leaves of a language stand in ascending doc_id, ties by leaf, null first; runs of
``FAN`` nodes become their hash until one is left. Leaves are numbered by a range shuffle with running sums, so that no
language is one task, and cut into aligned blocks of ``FAN ** DEPTH`` leaves. A block holds each of its levels as one
string of hexadecimal digits: a parent is the hash of a substring of fixed width, and a proof's siblings are the two
substrings that flank a node in its run. What a block ends in is a node of the next tier, which is blocked and
hashed the same way, until each language has one node; their tier ends in the root. Proofs run from the leaf upwards:
segments of the block, then those of the block as a node of the next tier, and so on.

Level strings are bytes of hexadecimal text, of which substrings are cut without counting characters. Only SQL functions
are used.

Result cases. Null fields: hashed as ``-``; a null language is one of its own, first. Null doc_id: before all others, never
tampered with by ``tampered``. Repeated rows: equal leaves side by side, each with its own proof. Empty text: ``0:``.
Very long texts: hashed where they are read, never moved. One row: its leaf is subroot and root, its proof
is empty. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import LOWER, UPPER, running_sum
from pricelake.session import cut_lineage, small_side

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
DEPTH = 3  # levels in a block
DIGEST = 64  # hexadecimal digits


def hexhash(value: Column) -> Column:
    """Hash of bytes or text, as bytes of hexadecimal text."""
    return F.sha2(value.cast("binary"), 256).cast("binary")


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """Hash of a row: every field as ``-`` if null, else its byte count, a colon and its value."""
    values = [text if name == "text" and text is not None else docs[name].cast("string") for name in FIELDS]
    return hexhash(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))


def tampered(docs: DataFrame) -> Column:
    """The text with A-Z lower-cased, in rows whose decimal doc_id has a checksum that 3 divides."""
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, F.translate(docs["text"], UPPER, LOWER)).otherwise(docs["text"])


def substring(value: Column, start: Column, n: Column) -> Column:
    """``n`` nodes of a level from number ``start`` on."""
    return F.substring(value, (start * DIGEST + 1).cast("int"), (n * DIGEST).cast("int"))


def nodes_in(level: Column) -> Column:
    return (F.octet_length(level) / DIGEST).cast("int")


def parents(level: Column, fan: int) -> Column:
    """The next level's string."""
    runs = F.sequence(F.lit(0), F.ceil(nodes_in(level) / fan).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: hexhash(substring(level, i * fan, F.lit(fan))).cast("string")), "").cast("binary")


def blocks(nodes: DataFrame, keys: list[str], fan: int, depth: int) -> DataFrame:
    """Nodes (keys, pos from 0, digest, row) as blocks (keys, block, members, levels): the members' rows in order and
    the strings of all levels but the last, and ``top``, the node they end in.

    A block that is all its tree has climbs until one node is left, any other climbs ``depth`` levels.
    """
    wide = fan**depth
    sizes = nodes.groupBy(*keys).agg(F.count("*").alias("__size"))
    sizes = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], "__size")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    sized = nodes.join(small_side(sizes), _all(same), "left").select(*nodes.columns, "__size")
    grouped = sized.groupBy(*keys, F.floor(F.col("pos") / wide).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "row"))).alias("members"), F.max("__size").alias("__size")
    )
    made = grouped.withColumn("l0", F.array_join(F.transform("members", lambda m: m["digest"].cast("string")), "").cast("binary"))
    for i in range(depth):
        climbs = (nodes_in(F.col(f"l{i}")) > 1) | (F.col("__size") > wide)
        made = made.withColumn(f"l{i + 1}", F.when(climbs, parents(F.col(f"l{i}"), fan)))
    levels = [F.col(f"l{i}") for i in range(depth)]
    below = [F.when(F.col(f"l{i + 1}").isNotNull(), level) for i, level in enumerate(levels)]
    top = F.coalesce(*[F.col(f"l{i}") for i in range(depth, -1, -1)])
    return made.select(*keys, "block", "members", F.array_compact(F.array(*below)).alias("levels"), top.alias("top"))


def _all(conditions: list[Column]) -> Column:
    both = F.lit(True)
    for one in conditions:
        both = both & one
    return both


def siblings(levels: Column, number: Column, fan: int) -> Column:
    """(before, after) in the run of node ``number`` of the block, for every level."""
    def one(level: Column, height: Column) -> Column:
        at = F.floor(number / F.pow(F.lit(fan), height)).cast("int")
        start = (at - at % fan).cast("int")
        return F.struct(substring(level, start, at - start).alias("before"), substring(level, at + 1, start + fan - 1 - at).alias("after"))

    return F.transform(levels, one)


def tiers(nodes: DataFrame, keys: list[str], fan: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the nodes with the proof of each block up to its tree's top, and (keys, top) of every tree."""
    stack = []
    while True:
        made = cut_lineage(blocks(nodes, keys, fan, depth))
        stack.append(made)
        if made.where("block > 0").isEmpty():
            break
        nodes = made.select(*keys, F.col("block").alias("pos"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("row"))
    tops = stack[-1].select(*keys, "top")
    none = F.array().cast("array<struct<before:binary,after:binary>>")
    above = stack.pop().withColumn("path", none)
    while stack:
        wide = fan**depth
        ways = above.select(*keys, "levels", "path", F.explode(F.transform("members", lambda m: m["pos"])).alias("__pos")).select(
            *[F.col(k).alias(f"__{k}") for k in keys], F.col("__pos").alias("__block"),
            F.concat(siblings(F.col("levels"), F.col("__pos") % wide, fan), F.col("path")).alias("path"),
        )
        below = stack.pop()
        names = [*below.columns, "path"]
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in [*keys, "block"]]
        above = cut_lineage(below.join(small_side(ways), _all(same)).select(*names))
    return above, tops


def manifest(docs: DataFrame, changed: Column | None = None, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, changed_leaf for every row.

    ``proof`` is the siblings before and after the node in its run, for every level from the leaf to the root;
    ``changed_leaf`` is the row's hash with ``changed`` in place of its text.
    """
    row = F.struct(docs["doc_id"].cast("long").alias("doc_id"), leaf(docs, changed).alias("changed"))
    leaves = docs.select(docs["lang"], docs["doc_id"].cast("long").alias("doc_id"), leaf(docs).alias("digest"), row.alias("row"), F.lit(1).alias("one"))
    placed = running_sum(leaves, ["lang"], ["doc_id", "digest"], "one", "number").select("lang", (F.col("number") - 1).alias("pos"), "digest", "row")
    below, tops = tiers(placed, ["lang"], fan, depth)

    ordered = running_sum(tops.select("lang", F.col("lang").isNotNull().alias("named"), "top", F.lit(1).alias("one")), [], ["named", "lang"], "one", "number")
    subroots = ordered.select((F.col("number") - 1).alias("pos"), F.col("top").alias("digest"), F.struct("lang").alias("row"))
    above, root = tiers(subroots, [], fan, depth)
    ways = above.select("levels", "path", F.explode("members").alias("m")).crossJoin(F.broadcast(root.select(F.col("top").alias("root"))))
    ways = small_side(ways.select(
        F.col("m.row.lang").alias("__lang"), F.col("m.digest").alias("subroot"), "root",
        F.concat(siblings(F.col("levels"), F.col("m.pos") % fan**depth, fan), F.col("path")).alias("way"),
    ))
    rows = below.join(ways, F.col("lang").eqNullSafe(F.col("__lang"))).select("levels", "path", "way", "subroot", "root", F.explode("members").alias("m"))
    proof = F.concat(siblings(F.col("levels"), F.col("m.pos") % fan**depth, fan), "path", "way")
    return rows.select("m.row.doc_id", F.col("m.digest").alias("leaf"), "subroot", "root", proof.alias("proof"), F.col("m.row.changed").alias("changed_leaf"))


def folded(start: Column, proof: Column) -> Column:
    """Root that a leaf and its proof give."""
    return F.aggregate(proof, start, lambda node, run: hexhash(F.concat(run["before"], node, run["after"])))


def tamper_report(docs: DataFrame) -> DataFrame:
    """The manifest with the digest of each proof, and whether the row still proves the root after ``tampered``."""
    rows = manifest(docs, tampered(docs)).withColumn("folded_root", folded(F.col("changed_leaf"), F.col("proof")))
    siblings_of = F.array_join(F.transform("proof", lambda run: F.concat(run["before"], run["after"]).cast("string")), "")
    text = {name: F.col(name).cast("string").alias(name) for name in ("leaf", "subroot", "root", "folded_root")}
    return rows.select(
        "doc_id", text["leaf"], text["subroot"], text["root"], F.sha2(siblings_of, 256).alias("proof_sha256"),
        text["folded_root"], (F.col("folded_root") == F.col("root")).alias("verified"),
    )
