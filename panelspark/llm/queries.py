"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import fingerprints, licenses, manifest, mixing, neardup, packing, pages, periodic, quality, repeats, secrets, toxicity, warc
from .common import kept_rows, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(fn):
    QUERIES[fn.__name__] = fn
    return fn


@registered
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("stratum"))
    rows = kept_rows(quality.measured(docs).select("doc_id", "stratum", "m"))
    cutoffs = quality.calibrate(quality.labelled(rows, table(spark, sf_dir, "labels")), "stratum", "_good")
    return quality.judged(rows, cutoffs, "stratum").select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", quality.base_failed().alias("base_failed"), "kept")


@registered
def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@registered
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scanned(docs, drop_text=True).select("doc_id", "found.*")


@registered
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@registered
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@registered
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licensed(table(spark, sf_dir, "documents"))


@registered
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


@registered
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"))


@registered
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@registered
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@registered
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    given = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, manifest.row_digest(*given, lowered))
    leaves = docs.select("doc_id", "lang", manifest.row_digest(*given, F.col("text")).alias("leaf"), tampered.alias("tampered"))
    out = manifest.sealed(leaves, "lang", ["doc_id"]).withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("witness")))
    return out.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("witness")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 bit by bit; runs of 8 level by level; siblings of every row; the fold of its leaf.
ORACLES["op11_merkle_manifest"] = """
WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER (ORDER BY doc_id, lang, text) AS rid, *,
    xor(4294967295, list_reduce(
      list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT),
      lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT)) % 3 = 0 AS hit,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents),
heads AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM rows_),
hashed AS (
  SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS claimed
  FROM heads),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
low AS (
  SELECT lang, 0 AS lev, pos, leaf AS node FROM placed
  UNION ALL
  SELECT lang, any_value(lev) + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM low) WHERE n > 1 GROUP BY lang, pos // 8),
tops AS (SELECT lang, max(lev) AS up, arg_max(node, lev) AS subroot FROM low GROUP BY lang),
groups_ AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tops),
high AS (
  SELECT 0 AS lev, pos, subroot AS node FROM groups_
  UNION ALL
  SELECT any_value(lev) + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY pos // 8),
top AS (SELECT max(lev) AS up, arg_max(node, lev) AS root FROM high),
steps AS (
  SELECT p.rid, l.lev, p.pos // pow(8, l.lev)::BIGINT AS own, l.pos, l.node
  FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang
  JOIN low l ON l.lang IS NOT DISTINCT FROM p.lang AND l.lev < t.up AND l.pos // 8 = p.pos // pow(8, l.lev + 1)::BIGINT
  UNION ALL
  SELECT p.rid, t.up + h.lev, g.pos // pow(8, h.lev)::BIGINT, h.pos, h.node
  FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang JOIN groups_ g ON g.lang IS NOT DISTINCT FROM p.lang
  JOIN high h ON h.pos // 8 = g.pos // pow(8, h.lev + 1)::BIGINT AND h.lev < (SELECT up FROM top)),
sides AS (
  SELECT rid, lev, coalesce(string_agg(node, '' ORDER BY pos) FILTER (WHERE pos < own), '') AS a, coalesce(string_agg(node, '' ORDER BY pos) FILTER (WHERE pos > own), '') AS b
  FROM steps GROUP BY rid, lev),
proofs AS (SELECT rid, sha256(string_agg(a || b, '' ORDER BY lev)) AS proof, count(*) AS n FROM sides GROUP BY rid),
fold AS (
  SELECT rid, 0 AS lev, claimed AS h FROM placed
  UNION ALL
  SELECT f.rid, f.lev + 1, sha256(s.a || f.h || s.b) FROM fold f JOIN sides s ON s.rid = f.rid AND s.lev = f.lev),
done AS (SELECT rid, arg_max(h, lev) AS folded FROM fold GROUP BY rid)
SELECT p.doc_id, p.leaf, t.subroot, r.root, coalesce(q.proof, sha256('')) AS proof_sha256, d.folded AS folded_root, d.folded = r.root AS verified
FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang JOIN done d USING (rid) LEFT JOIN proofs q USING (rid), top r"""


@registered
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = periodic.periodic_runs(periodic.with_planted_repeats(docs)).withColumn("top", periodic.strongest(F.col("runs")))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
                      F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
                      periodic.digest_of_runs(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@registered
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.written(warc.records_of(table(spark, sf_dir, "pages")), f"{shared_folder(spark)}/warc-{uuid.uuid4()}")
    out = warc.read(spark, path, payload="false").where(F.col("record_type").isin("response", "revisit"))
    return out.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      warc.page_of(F.col("refers_to")).alias("refers_to"))
