"""A training corpus from `documents`, stage by stage; each stage's Parquet output is the next one's input.

All stages return the columns of `documents` (the last: pieces) and read no others, whatever their names; null
languages, sources and counts are kept; empty tables give no rows at every stage; very long texts are worked on whole.
Each stage's docstring has the rest; see also the operators'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from public_tokenizers import path as tokenizer

from quittance.llm import decontaminate, ngram_join, packing, quality, secret_scan
from quittance.llm.common import fresh_dir, rows_where, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what base rules or certified cutoffs reject: null and empty texts among it. Repeated rows are judged row
    by row, null ids too; no order or tie matters."""
    cutoffs = quality.learn_cutoffs(docs, table(spark, sf_dir, "labels"))
    return rows_where(quality.apply_rules(docs, cutoffs, COLUMNS), F.col("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: of the smallest doc_id (null ones come last), then the smallest hash of id and text.

    Documents are told apart by id and text: rows equal in both are one document, of which one row stays (empty texts
    too); rows of one id with different texts are different documents. Texts without words link with nothing.
    """
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.when(F.col("text").isNull(), "null").otherwise("text"), F.col("text"))
    key = F.unhex(F.md5(name.cast("binary")))
    joined = ngram_join.jaccard_join(docs, key=key)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    firsts = joined.where("n_shingles > 0").groupBy("component").agg(F.min(order).alias("first")).select("first.key")
    kept = firsts.unionByName(joined.where("n_shingles = 0").select("key").distinct())
    kept = docs.select(*COLUMNS, key.alias("__key")).join(kept.withColumnRenamed("key", "__key"), "__key", "left_semi")
    # the join has dealt and sorted the rows by their key already
    place = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    return kept.withColumn("__place", place).where("__place = 1").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with any benchmark window; null and empty texts have none. Repeated rows and ids, null ones too,
    are judged row by row; no order or tie matters."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.where("out.n_hit = 0").select("row.*")


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind in brackets and counts the characters anew; null texts stay with their count.
    Repeated rows and ids, null ones too, are redacted row by row; of overlapping spans the first names the kind."""
    found = secret_scan.find_spans(docs, secret_scan.learn_cutoffs(docs), COLUMNS)
    cleaned = found.select("row.*", secret_scan.redacted(F.col("row.text"), F.col("spans")).alias("clean"))
    return cleaned.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.coalesce(F.length("clean").cast("bigint"), F.col("n_chars")).alias("n_chars"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 token ids, a row per piece with its ids. Null and empty texts hold the end id; repeated
    rows and ids, null ones too, are packed row by row; ties of fill levels go to the fullest."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_redaction", secret_redaction),
    ("sequence_packing", sequence_packing),
]
#: several stages have no SQL form; tests hold each against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
