"""T4: incremental function ingest.

New and edited source files are picked up by a ``binaryFile`` file stream, extracted in
the same ``mapInPandas`` pass as the batch job, and replace what the table holds of the
same file, so an edit leaves no stale function behind. The table is partitioned by a
hash bucket of the file; a micro-batch reads and rewrites only the buckets of its files
(dynamic partition overwrite, committed by Spark's commit protocol). The number of
buckets is the table's own: give a new table as many as its expected size asks for.

Paths may be local or URIs of any file system that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators import extract as X
from callweave.session import cut_lineage, scratch_path
from callweave.sources.corpus import corpus_files, corpus_root, hadoop_path, scan_filter
from callweave.streaming import edges as E

BUCKETS = 64


def corpus_stream(spark: SparkSession, repo_path: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = (spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.py").load(repo_path))
    df = corpus_files(raw, *corpus_root(spark, repo_path))
    return scan_filter(df.select("repo", "path", "content", "readable", "repo_root",
                                 F.unix_micros("modificationTime").alias("seq")))


def _stored(spark: SparkSession, table_root: str) -> DataFrame | None:
    """The table with its file marks, or None before the first batch."""
    fs, p = hadoop_path(spark, table_root.rstrip("/") + "/bucket=*")
    found = fs.globStatus(p)
    return spark.read.parquet(table_root) if found is not None and len(found) else None


def current_table(spark: SparkSession, table_root: str) -> DataFrame | None:
    stored = _stored(spark, table_root)
    return None if stored is None else stored.where(F.col("lookup_id").isNotNull())


def replace_files(stored: DataFrame | None, functions: DataFrame, files: DataFrame, buckets: int) -> DataFrame:
    """The buckets of ``files(file_path, seq)`` after the batch. Every file has a mark (a row
    without ``lookup_id``), so a bucket whose files lost all functions is rewritten too. A
    file that the table holds in a later version keeps that one."""
    bucket = F.pmod(F.xxhash64("file_path"), F.lit(buckets)).cast("int")
    files = files.groupBy("file_path").agg(F.max("seq").alias("seq")).withColumn("bucket", bucket)
    if stored is None:
        return functions.join(files, "file_path", "right")
    stored = stored.join(files.select("bucket").distinct(), "bucket", "left_semi")
    newer = stored.groupBy("file_path").agg(F.max("seq").alias("_have"))
    files = cut_lineage(files.join(newer, "file_path", "left").where(F.coalesce(F.col("_have") <= F.col("seq"), F.lit(True))).drop("_have"))
    new = functions.join(files, "file_path", "right")  # a file without functions: its mark alone
    return stored.join(files, "file_path", "left_anti").unionByName(new)


def ingest_functions(spark: SparkSession, repo_path: str, table_root: str, checkpoint: str | None = None,
                     buckets: int = BUCKETS, graph_root: str | None = None) -> DataFrame | None:
    """Run the ingest over all files available now; returns the current table. With ``graph_root``
    the call graph stored there (``streaming.edges``) follows; it is written before the table, so
    a batch that failed between the two meets the table as it was and is applied again."""
    checkpoint = checkpoint or scratch_path(spark, "ingest-state")

    def merge(batch: DataFrame, batch_id: int):
        batch = cut_lineage(batch)
        files = batch.select(F.concat_ws("/", "repo_root", "path").alias("file_path"), "seq")
        functions = X.functions_from(X.extract(batch.drop("seq")))
        stored = _stored(spark, table_root)
        merged = cut_lineage(replace_files(stored, functions, files, buckets))  # no read of the target left
        if graph_root:
            rows = lambda df: df.where("lookup_id IS NOT NULL").join(files.select("file_path").distinct(), "file_path", "left_semi").select("lookup_id", "name", "calls")
            before = rows(stored) if stored is not None else rows(merged).limit(0)
            E.apply_changes(spark, graph_root, cut_lineage(before), rows(merged), buckets=buckets)
        (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(table_root))

    q = (corpus_stream(spark, repo_path).writeStream.foreachBatch(merge)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return current_table(spark, table_root)
