"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import audit, bpe, dedup, langid, lattice, licences, mixing, negatives, quality, secrets, simhash, substrings, toxicity

BPE_FILE, PIECE_FILE = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizers():
    import public_tokenizers

    return public_tokenizers


def op1_quality_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.judge_quality(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op2_source_mixing(spark, sf_dir):
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.withColumns({c: F.round(c, 6) for c in ("ratio", "p", "sample_weight", "margin_error")})


def op3_exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark, sf_dir):
    return lattice.score_texts(_table(spark, sf_dir, "documents"), lattice.read_vocabulary(_tokenizers().path(PIECE_FILE)))


def op5_secret_scan(spark, sf_dir):
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op7_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


def op8_license_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return licences.scan_licences(docs, licences.train(docs))


def op9_byte_bpe(spark, sf_dir):
    t = _tokenizers()
    ranks = bpe.read_ranks(t.path(BPE_FILE))
    return bpe.round_trip(_table(spark, sf_dir, "documents"), ranks, t.PATTERN)


def op10_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op11_substring_dedup(spark, sf_dir):
    told = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return told.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


def op13_filter_audit(spark, sf_dir):
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries():
    found = (op1_quality_rules, op2_source_mixing, op3_exact_dedup, op4_lm_scoring, op5_secret_scan, op6_language_id, op7_simhash_near_dedup, op8_license_scan, op9_byte_bpe, op10_toxicity, op11_substring_dedup, op12_hard_negatives, op13_filter_audit)
    return {f.__name__: f for f in found}


def oracle_sql():
    return {
        "op2_source_mixing": mixing.mix_sql(),
        "op3_exact_dedup": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op11_substring_dedup": substrings.remove_repeats_sql(),
        "op12_hard_negatives": negatives.hard_negatives_sql(),
        "op13_filter_audit": audit.audit_sql(),
    }
