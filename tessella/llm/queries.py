"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hnsw, lm, pieces, pii, secret_scan, sharding, simhash, token_count, toxicity, vafile, warc, whitening
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_held_out(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), ["doc_id"], remember=200_000)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_language_model, op3_toxicity, op4_decontaminate, op5_sentencepiece, op6_nearest, op7_token_counts, op8_sharding, op9_warc, op10_pii, op11_secrets, op12_whitening, op13_vector_codes)}

#: The other queries rest on seeded hashes, trained models or searches that SQL can't express; tests hold them against brute force.
_NEAREST = """SELECT r, part, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d
  FROM (SELECT r, p.part, CAST(e AS BIGINT) AS e, CAST((q[1] - c[1]) ** 2 + (q[2] - c[2]) ** 2 + (q[3] - c[3]) ** 2 + (q[4] - c[4]) ** 2 AS BIGINT) AS d FROM p JOIN {books} AS b ON b.part = p.part) GROUP BY r, part"""
_MOVED = """SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM {books} AS b LEFT JOIN
  (SELECT part, e, [floor(sum(q[1]) / count(*)), floor(sum(q[2]) / count(*)), floor(sum(q[3]) / count(*)), floor(sum(q[4]) / count(*))] AS c FROM p JOIN {found} USING (r, part) GROUP BY part, e) AS m ON m.part = b.part AND m.e = b.e"""

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
d AS (SELECT row_number() OVER () AS row_id, doc_id, ws FROM w),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i + 1:i + least(len(ws), 10)], ' ') AS k FROM (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT row_id, n, unnest(range(0, len(ws) - n + 1)) AS i, ws FROM d, sizes WHERE len(ws) >= n),
hit AS (SELECT row_id, i, spots.n, item_id FROM spots JOIN win ON win.n = spots.n AND win.k = array_to_string(ws[i + 1:i + spots.n], ' ')),
words AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_id) LEFT JOIN items USING (row_id)""",
    "op9_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best, payload_bytes >= {warc.REVISIT_BYTES} AS large FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN large AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN large AND page_id <> best THEN best END AS refers_to FROM g""",
    "op13_vector_codes": f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT r, vec_id, part, x[4 * part + 1 : 4 * part + 4] AS q FROM v, (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, n - 1 AS e, q AS c FROM (SELECT part, q, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS n FROM p) WHERE n <= 64),
a0 AS ({_NEAREST.format(books="b0")}), b1 AS ({_MOVED.format(books="b0", found="a0")}),
a1 AS ({_NEAREST.format(books="b1")}), b2 AS ({_MOVED.format(books="b1", found="a1")}),
a2 AS ({_NEAREST.format(books="b2")}),
codes AS (SELECT r, string_agg(lower(lpad(hex(CAST(e AS BIGINT)), 2, '0')), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN v USING (r), digest""",
}
