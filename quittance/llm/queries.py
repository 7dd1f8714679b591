"""Queries opN_<name>: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from public_tokenizers import path as tokenizer

from . import decontaminate as decontamination
from . import chat_format, divergence, hard_negatives, lm_score, ngram_join, packing, quality, secret_scan, sql, token_counts, token_files, toxicity, url_filter
from .common import crc_mod, table

#: host, path and verdict of the url rules that op7 is to apply (fixed values)
URL_RULES = (
    url_filter.HostRule("allow", "org", "/"),
    url_filter.HostRule("block", "example.org", "/es/"),
    url_filter.HostRule("block", "example.org", "/en/1"),
    url_filter.HostRule("allow", "com", "/fr/"),
    url_filter.HostRule("block", "com", "/de/"),
)
TOKEN_LIMIT = 512


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents")).drop("component")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score_texts(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), learn)
    return scored.select(
        "row.doc_id",
        (crc_mod(F.col("row.doc_id"), 5) == 0).alias("held_out"),
        "out.score",
        (F.col("out.score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "out.n_words",
        "out.n_hit",
        F.size("out.item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("out.item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("out.n_hit") > 0).alias("contaminated"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    of_rank = [F.filter("spans", lambda s: s["kind"] == kind) for kind in secret_scan.KINDS]
    counts = [F.size(spans).cast("bigint").alias(f"n_{kind}") for spans, kind in zip(of_rank, secret_scan.KINDS)]
    return found.select(
        "row.doc_id",
        *counts,
        F.sha2(secret_scan.span_text(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return counted.select("row.doc_id", "out.n_bytes", "out.n_tokens", (F.col("out.n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("row.page_id", "out.host", "out.path", "out.rule", "out.verdict")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), with_ids=False)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", *quality.BASE, "base_failed", "kept")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    read = chat_format.read_back(chat_format.format_conversations(rows.unionByName(more)))
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("roles").cast("bigint").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_join, op2_lm_score, op3_toxicity, op4_benchmark_hits, op5_secret_scan, op6_token_counts, op7_url_filter, op8_token_files, op9_packing, op10_quality_rules, op11_chat_format, op12_hard_negatives, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": sql.OP1, "op4_benchmark_hits": sql.OP4, "op7_url_filter": sql.OP7, "op10_quality_rules": sql.OP10, "op11_chat_format": sql.OP11, "op12_hard_negatives": sql.OP12, "op13_source_divergence": sql.OP13}
