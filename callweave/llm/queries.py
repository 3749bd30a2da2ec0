"""Registered queries of the training-data operators: ``QUERIES`` and ``ORACLE``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import oracles
from callweave.llm import op01_url_filters, op02_bpe, op03_quality, op04_token_files, op05_toxicity, op06_token_counts, op07_mixing, op08_embeddings, op09_minhash, op10_chat, op11_whitening, op12_vector_codes, op13_topk
from callweave.sources.tables import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


#: the rules given by hand: host, path, verdict
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the row of its id in ``labels``: block if of bad quality or toxic."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").otherwise("allow").alias("label"))
    labelled = pages.select("page_id", "url").join(labels, F.col("page_id") == F.col("doc_id")).select("url", "label")
    return op01_url_filters.filter_urls(pages, labelled, URL_RULES)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_bpe.round_trip_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = op03_quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_score")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_token_files.read_files(spark, op04_token_files.write_files(table(spark, sf_dir, "documents"), WORD_BPE))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_mixing.mix(table(spark, sf_dir, "documents")).drop("print")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


#: the conversation that the query adds: its texts hold other templates' marks
MARKED = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    return op10_chat.read_back(op10_chat.format_conversations(op10_chat.events_of_turns(turns.unionByName(own))))


def op11_whitening_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_vector_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, _ = op12_vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return op12_vector_codes.with_label_errors(codes)


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % op13_topk.EVERY == 0)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_bpe_round_trip, op3_quality, op4_token_files, op5_toxicity, op6_token_counts, op7_source_mix, op8_embedding_dedup, op9_minhash_dedup, op10_chat_format, op11_whitening_rows, op12_vector_code, op13_exact_topk)}
ORACLE: dict[str, str] = {"op7_source_mix": oracles.MIX, "op8_embedding_dedup": oracles.EMBEDDINGS, "op9_minhash_dedup": oracles.MINHASH,
                          "op10_chat_format": oracles.CHAT, "op12_vector_code": oracles.VECTOR_CODES, "op13_exact_topk": oracles.TOP_K}
