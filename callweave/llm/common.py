"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.session import scratch_path, ship_package

#: the white space that separates words: space, tab, line feed, vertical tab, form feed, return
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: bytes of one Arrow batch: texts can be long
ARROW_BYTES, BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare_python(spark: SparkSession) -> None:
    """Ship the package to the executors' Python workers and bound the size of Arrow batches."""
    ship_package(spark)
    try:
        now = int(spark.conf.get(BATCH))
    except ValueError:  # written with a unit
        return
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(BATCH, str(ARROW_BYTES))


_KEPT: dict[str, Callable[[], None]] = {}


def keep_for(owner: str, clear: Callable[[], None]) -> None:
    """Tells that a Python worker now holds something for later tasks of ``owner``."""
    _KEPT[owner] = clear


def only_for(owner: str) -> None:
    """At the start of a task: what tasks of other operators left in this Python worker goes. Workers
    are used again, so without this one holds the sum of what all operators keep."""
    others = [k for k in _KEPT if k != owner]
    for k in others:
        _KEPT.pop(k)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()


def words(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD_PATTERN})"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new table in the shared scratch folder and read back:
    the work is done once, and a lost executor repeats none of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vocabulary(spark: SparkSession, path: str):
    """Broadcast of a tokenizer file: a published vocabulary, a few MB whatever the input."""
    if os.path.getsize(path) > 64 << 20:
        raise ValueError(f"{path} is too large to broadcast")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())
