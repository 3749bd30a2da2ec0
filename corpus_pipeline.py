"""The corpus pipeline: quality rules, toxicity, MinHash near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept; its result is written as Parquet and read again. All stages but the last give the
columns of ``documents``; the last adds the ids of the text, their number and digests.
Labels of the scale-factor folder teach the quality rules and the toxicity model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import op02_bpe, op03_quality, op05_toxicity, op07_mixing, op09_minhash
from callweave.llm.common import written
from callweave.llm.queries import WORD_BPE
from callweave.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that a base rule or the score rejects go."""
    return op03_quality.kept_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that are predicted toxic go."""
    model = op05_toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = op05_toxicity.with_scores(docs.select(*COLUMNS), model)
    return scored.where(F.col("score") < op05_toxicity.THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near-duplicates stays."""
    return op09_minhash.deduplicate(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: a document comes as often as the mix takes its words, in whole copies
    that give each source the words that the mix takes of it."""
    return op07_mixing.mixed_documents(docs.select(*COLUMNS))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the ids of each text, and the digests of ids and decoded text."""
    return op02_bpe.round_trip_rows(docs.select(*COLUMNS), WORD_BPE)


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("near-dedup", near_dedup), ("mixing", mixing), ("bpe", encoding)]

#: learned models, sketches and encoders have no SQL form; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
