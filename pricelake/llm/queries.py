"""One query per corpus operator, over the whole of its table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.llm import (
    decontaminate, licenses, merkle, mixing, quality, secrets, sharding, simhash, suffixdedup, tokencounts, tokenfiles, warc, whitening,
)
from pricelake.llm.common import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and notices."""
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives."""
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.*, CASE WHEN m.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.first <> d.page_id THEN m.first END AS refers_to
FROM d LEFT JOIN m USING (payload_digest)
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words and tokens."""
    import public_tokenizers

    return tokencounts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, near equal in bytes, copies together as far as quotas allow."""
    placed = sharding.sharded(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    return quality.verdicts(table(spark, sf_dir, "documents")).drop("d2")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "novel")

    def n(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return secrets.secret_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(secrets.named(base), 256).alias("base_sha256"), secrets.named(spans).alias("spans"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that stands in a document, with its place and distance."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, from the files they were written to."""
    import public_tokenizers

    return tokenfiles.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in the mix."""
    rates = mixing.mix_rates(table(spark, sf_dir, "documents"))
    return rates.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes without those of 400-byte strings that stand twice."""
    return suffixdedup.removal_report(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, b, substr(h, 2 * b + 1, 2 * (512 + 399)) AS part FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399, 512)) AS b FROM d)),
w AS (SELECT r, b + j AS i, md5(substr(part, 2 * j + 1, 800)) AS k FROM (SELECT r, b, part, unnest(range(least(512, len(part) // 2 - 399))) AS j FROM p)),
m AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
o AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400 OR lag(i) OVER (PARTITION BY r ORDER BY i) IS NULL THEN 1 ELSE 0 END AS opens FROM m),
g AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS number FROM o),
s AS (SELECT r, min(i) AS a, max(i) + 400 AS e FROM g GROUP BY r, number),
k AS (SELECT s.r, a, e, substr(h, 2 * lag(e, 1, 0) OVER (PARTITION BY s.r ORDER BY a) + 1, 2 * (a - lag(e, 1, 0) OVER (PARTITION BY s.r ORDER BY a))) AS before FROM s JOIN d USING (r)),
t AS (SELECT r, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(before, '' ORDER BY a) AS front FROM k GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(concat(coalesce(front, ''), substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether a tampered text still proves the root."""
    return merkle.tamper_report(table(spark, sf_dir, "documents"))


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(strlen({value}), ':', {value}) END"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(_field(v) for v in ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', text))}))"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# the checksum of a short string, bit by bit
_CRC32 = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda v, step: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)))"""

OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, dense_rank() OVER (ORDER BY lang IS NOT NULL, lang) - 1 AS k, {_leaf('text')} AS leaf,
    CASE WHEN {_CRC32} % 3 = 0 THEN {_leaf(_LOWERED)} ELSE {_leaf('text')} END AS changed FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
n AS (
  SELECT k, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY k) AS size FROM b
  UNION ALL
  SELECT k, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (size + 7) // 8 FROM n WHERE size > 1 GROUP BY k, level, pos // 8, size),
s AS (SELECT k, digest AS subroot FROM n WHERE size = 1),
m AS (
  SELECT 0 AS level, k AS pos, subroot AS digest, count(*) OVER () AS size FROM s
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (size + 7) // 8 FROM m WHERE size > 1 GROUP BY level, pos // 8, size),
f AS (
  SELECT r, k, 0 AS level, pos, changed AS digest, '' AS proof FROM b
  UNION ALL
  SELECT f.r, f.k, f.level + 1, f.pos // 8, sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.digest ELSE n.digest END, '' ORDER BY n.pos)),
    concat(f.proof, string_agg(CASE WHEN n.pos = f.pos THEN '' ELSE n.digest END, '' ORDER BY n.pos))
  FROM f JOIN n ON n.k = f.k AND n.level = f.level AND n.pos // 8 = f.pos // 8 AND n.size > 1 GROUP BY f.r, f.k, f.level, f.pos, f.digest, f.proof),
h AS (
  SELECT f.r, 0 AS level, f.k AS pos, f.digest, f.proof FROM f JOIN n ON n.k = f.k AND n.level = f.level AND n.size = 1
  UNION ALL
  SELECT h.r, h.level + 1, h.pos // 8, sha256(string_agg(CASE WHEN m.pos = h.pos THEN h.digest ELSE m.digest END, '' ORDER BY m.pos)),
    concat(h.proof, string_agg(CASE WHEN m.pos = h.pos THEN '' ELSE m.digest END, '' ORDER BY m.pos))
  FROM h JOIN m ON m.level = h.level AND m.pos // 8 = h.pos // 8 AND m.size > 1 GROUP BY h.r, h.level, h.pos, h.digest, h.proof)
SELECT b.doc_id, b.leaf, s.subroot, m.digest AS root, sha256(h.proof) AS proof_sha256, h.digest AS folded_root, h.digest = m.digest AS verified
FROM b JOIN s USING (k) JOIN h USING (r) JOIN m ON m.size = 1 AND m.level = h.level
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding's whitened leading components."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_licenses, op2_warc, op3_token_counts, op4_sharding, op5_quality, op6_secrets, op7_decontamination, op8_simhash, op9_token_files, op10_mixing, op11_suffix_dedup, op12_merkle, op13_whitening)
}
ORACLES = {"op1_licenses": licenses.SQL, "op2_warc": OP2_SQL, "op10_mixing": mixing.SQL, "op11_suffix_dedup": OP11_SQL, "op12_merkle": OP12_SQL}
