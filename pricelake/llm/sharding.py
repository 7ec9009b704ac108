"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents with the same value in ``link`` are linked (null: not linked). Every shard may hold its even share of all
bytes. Linked documents start spread by hash; in each round a Spark join tells each of them the shard with room that
holds most of its neighbours, and it moves there if that is better than where it is, as far as the quota lets the
shard grow. What lies above a quota at the end, and all unlinked documents, fill the room that is left.

Result cases. Null text: as empty, size 8. Null doc_id: placed like any other. Rows that repeat a doc_id, or whole rows,
each get a place of their own. Ties: documents of one link and id stand in the order of the numbers they get when they are
first written. Very long texts: only their size travels; one larger than the mean is laid out first. Empty table: no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import running_sum, whole_text
from pricelake.session import BROADCAST_BYTES, cut_lineage, measured_bytes

ROW_BYTES = 8
ROUNDS = 6
PIECES = 64  # a link's documents meet facts about it in this many keys
ROW = ("doc_id", "link", "size", "crc", "salt")
# sizes of the unlinked documents as parts of the mean: large ones are laid out first, small ones even out the rest
TIERS = (1.0, 0.125, 0.0)


def _by_shard(values: dict[int, float], n_shards: int) -> Column:
    """One number per shard as a lookup: as many entries as there are shards."""
    return F.element_at(F.array(*[F.lit(float(values.get(s, 0.0))) for s in range(n_shards)]), F.col("shard") + 1)


def _sums(rows: DataFrame) -> dict[int, float]:
    """Bytes by shard; one number per shard comes to the driver."""
    return {r["shard"]: float(r["n"]) for r in rows.groupBy("shard").agg(F.sum("size").alias("n")).collect()}


def _unit(*parts) -> Column:
    return (F.xxhash64(*parts).bitwiseAND((1 << 53) - 1)) / F.lit(float(1 << 53))


def _told(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Left join of documents with the few rows of facts about each link. Facts are broadcast while they are small;
    beyond that each goes to ``PIECES`` keys, over which the documents of a link are dealt, so that no link is one task."""
    facts = cut_lineage(facts)
    if measured_bytes(facts) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts), on, "left")
    dealt = rows.withColumn("piece", F.pmod(F.xxhash64("salt"), F.lit(PIECES)).cast("int"))
    copies = facts.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    return dealt.join(copies, [*on, "piece"], "left").drop("piece")


def propagate(linked: DataFrame, n_shards: int, quota: float, rounds: int = ROUNDS) -> DataFrame:
    """Label propagation over (doc_id, link, size, shard) rows; a shard never takes more than its quota leaves."""
    for turn in range(rounds):
        load = _sums(linked)
        room = {s: quota - load.get(s, 0.0) for s in range(n_shards)}
        strength = F.struct(F.col("near"), F.xxhash64("link", "shard"))
        cells = linked.groupBy("link", "shard").agg(F.count("*").alias("near"), F.sum("size").alias("bytes"))
        open_cells = cells.where(_by_shard(room, n_shards) > 0)
        best = open_cells.groupBy("link").agg(F.max(F.struct(strength.alias("s"), F.col("shard").alias("to"))).alias("best"))
        moves = cut_lineage(
            cells.join(best, "link").where((F.col("shard") != F.col("best.to")) & (strength < F.col("best.s")))
            .select("link", F.col("shard").alias("from"), F.col("best.to").alias("shard"), "bytes")
        )
        wanted = {r["shard"]: float(r["n"]) for r in moves.groupBy("shard").agg(F.sum("bytes").alias("n")).collect()}
        if not wanted:
            break
        part = {s: min(1.0, max(0.0, room[s]) / n) for s, n in wanted.items() if n}
        # neighbours go together where they are few against the room, else one by one
        asked = moves.select(
            "link", "from", F.col("shard").alias("to"), _by_shard(part, n_shards).alias("part"),
            (F.col("bytes") * 8 < _by_shard(room, n_shards)).alias("together"),
        )
        drawn = F.when(F.col("together"), _unit("link", F.lit(turn))).otherwise(_unit("doc_id", "link", F.lit(turn), "salt"))
        stepped = _told(linked.withColumn("from", F.col("shard")), asked, ["link", "from"])
        linked = cut_lineage(stepped.select(
            *ROW, F.when(drawn < F.col("part"), F.col("to")).otherwise(F.col("shard")).alias("shard"),
        ))
    return linked


def _fill(rows: DataFrame, room: dict[int, float], n_shards: int) -> DataFrame:
    """Lay the rows on a line and cut it in proportion to the shards' room."""
    total = float(rows.agg(F.sum("size")).first()[0] or 0)
    whole = sum(max(0.0, r) for r in room.values())
    ends, at = [], 0.0
    for s in range(n_shards):
        at += (max(0.0, room.get(s, 0.0)) / whole if whole else 1 / n_shards) * total
        ends.append(at)
    line = running_sum(rows, [], ["link", "doc_id", "salt"], "size", "upto")
    middle = F.col("upto") - F.col("size") / 2
    passed = F.aggregate(F.array(*[F.lit(e) for e in ends[:-1]]), F.lit(0), lambda n, e: n + (e <= middle).cast("int"))
    return line.select(*ROW, passed.alias("shard"))


def sharded(docs: DataFrame, n_shards: int = 24, link: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; bytes are near equal, and links are cut as seldom as quotas allow.

    ``link`` defaults to equal texts. Moves carry slim rows only (no text).
    """
    text = whole_text()
    size = (F.octet_length(text) + ROW_BYTES).cast("bigint")
    rows = cut_lineage(docs.select(
        "doc_id", (F.xxhash64(text) if link is None else link).alias("link"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc")
    ).withColumn("salt", F.monotonically_increasing_id()))
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    if not count:
        return rows.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    quota = total / n_shards
    shared = rows.where("link IS NOT NULL").groupBy("link").agg(F.count("*").alias("n")).where("n > 1").select("link", F.lit(True).alias("shared"))
    marked = cut_lineage(_told(rows, shared, ["link"]))
    first = F.pmod(F.xxhash64("doc_id", "salt"), F.lit(n_shards)).cast("int")
    linked = propagate(cut_lineage(marked.where("shared").select(*ROW, first.alias("shard"))), n_shards, quota, rounds)

    queue = running_sum(linked, ["shard"], ["link", "doc_id", "salt"], "size", "upto")
    placed = cut_lineage(queue.withColumn("over", F.col("upto") > quota).drop("upto"))
    rest = marked.where("shared IS NULL").select(*ROW).union(placed.where("over").select(*ROW))
    done = placed.where("NOT over").select(*ROW, "shard")
    upper = float("inf")
    for tier in TIERS:
        lower = tier * total / count
        room = {s: quota - n for s, n in ({s: 0.0 for s in range(n_shards)} | _sums(done)).items()}
        some = rest.where((F.col("size") >= lower) & (F.col("size") < upper))
        done, upper = cut_lineage(done.union(_fill(some, room, n_shards))), lower
    slots = running_sum(done.withColumn("one", F.lit(1)), ["shard"], ["doc_id", "link", "salt"], "one", "place")
    return slots.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - 1).cast("bigint").alias("slot"))


def cut_links(placed: DataFrame, link: str) -> DataFrame:
    """Links cut, by value of ``link``: pairs of its documents in different shards."""
    cells = placed.groupBy(link, "shard").agg(F.count("*").alias("n"))
    return cells.groupBy(link).agg(((F.pow(F.sum("n"), 2) - F.sum(F.pow("n", F.lit(2)))) / 2).cast("bigint").alias("cut"))
