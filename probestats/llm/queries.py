"""Registered queries of the corpus operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from probestats.llm import conversations, decontamination, html, language, maxent, packing, periodic, quality, sharding, simhash, topk, toxicity, warc
from probestats.llm.oracles import CONVERSATIONS, QUALITY, TOP_K, WARC
from probestats.llm.shared import table
from probestats.operators.stage import own_folder

#: A file of the installed vocabularies.
TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def op1_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as WARC archives to the shared folder and reads them back, digests verified."""
    warc.register(spark)
    path = f"{own_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.page_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    found = spark.read.format("warc").option("verify", "true").load(path).where(F.col("record_type").isin("response", "revisit"))
    return found.select(
        warc.page_id_of("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.replace("payload_digest", F.lit("sha1:"), F.lit("")).alias("payload_digest"), "record_type", warc.page_id_of("refers_to").alias("refers_to"),
    )


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_failed", "kept")


def op8_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op11_survivor_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


def op12_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summarize(table(spark, sf_dir, "documents"), repeat_tails=True)


def op13_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def llm_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_host_paths, op2_harmonic_packing, op3_decontamination, op4_simhash, op5_feistel_sharding, op6_warc, op7_host_quality, op8_crf_language, op9_nb_toxicity, op10_maxent, op11_survivor_viterbi, op12_recompression_runs, op13_segment_topk)}


def llm_oracles() -> dict[str, str]:
    return {"op6_warc": WARC, "op7_host_quality": QUALITY, "op11_survivor_viterbi": CONVERSATIONS, "op13_segment_topk": TOP_K}
