"""One named query per operator over its whole table, and check SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from cellweft.llm import (hyperminhash, licence_scan, packing, periodic_runs, perplexity, pivotal, pseudo_likelihood, quote_links,
                          rule_ensemble, secret_scan, url_model, vantage, whitening)
from cellweft.llm.common import table
from cellweft.plans.registry import query

TOKENIZER_FILE = "byte_bpe_50k.json"


@query("op1_url_model")
def op1_url_model(spark, folder):
    return url_model.judge_urls(table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


@query("op2_secret_scan")
def op2_secret_scan(spark, folder):
    found = secret_scan.scan_secrets(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex",
                        F.sha2(secret_scan.span_text("base").cast("binary"), 256).alias("base_sha256"),
                        secret_scan.span_text("spans").alias("spans"), "n_live", "n_example", "n_shared")


@query("op3_rule_ensemble")
def op3_rule_ensemble(spark, folder):
    rated = rule_ensemble.rate_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rated.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op4_hyperminhash")
def op4_hyperminhash(spark, folder):
    return hyperminhash.near_duplicates(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op5_pivotal_mix")
def op5_pivotal_mix(spark, folder):
    mixed = pivotal.mix_sources(table(spark, folder, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP6_SQL = """
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20
"""


@query("op6_vantage_trees", OP6_SQL)
def op6_vantage_trees(spark, folder):
    found = vantage.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20, factor=1.0)
    return found.withColumnRenamed("id", "vec_id")


@query("op7_perplexity")
def op7_perplexity(spark, folder):
    rated = perplexity.rate_documents(table(spark, folder, "documents"))
    return rated.select(F.col("id").alias("doc_id"), *perplexity.COUNTS, "base_failed", "kept", "loss", "exact_loss")


@query("op8_quote_links")
def op8_quote_links(spark, folder):
    linked = quote_links.link_quotations(table(spark, folder, "conversations"))
    return linked.withColumnsRenamed({"conv": "conv_id"}).withColumn("reply_path", F.array_join("reply_path", "."))


@query("op9_pseudo_likelihood")
def op9_pseudo_likelihood(spark, folder):
    return pseudo_likelihood.score_documents(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op10_swap_packing")
def op10_swap_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER_FILE)).withColumnRenamed("id", "doc_id")


@query("op11_rare_token_licences")
def op11_rare_token_licences(spark, folder):
    found = licence_scan.scan_licences(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", F.size("places").cast("bigint").alias("n_base"),
                        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
                        licence_scan.labels_of("places").alias("base_labels"),
                        licence_scan.labels_of("places", "matches").alias("labels"),
                        F.coalesce(F.array_max("matches.share"), F.lit(0.0)).alias("score"))


@query("op12_cholesky_whitening")
def op12_cholesky_whitening(spark, folder):
    rows = whitening.whiten(table(spark, folder, "embeddings"))
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part")
    rows = rows.select("id", "n", "deviation", "identity_error", parts)
    return rows.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", "deviation",
                       "part.whitened", "part.explained", "identity_error")


@query("op13_periodic_runs")
def op13_periodic_runs(spark, folder):
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table(spark, folder, "documents")))
    return found.select(F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length",
                        "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(periodic_runs.run_text().cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
