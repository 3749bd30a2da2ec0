"""Global ranks without a single-partition window.

``Window.orderBy`` with no partition moves every row into one task. Here the
rows are range-sorted (a distributed sort), tagged with
``monotonically_increasing_id`` (partition index in the high bits), and offset
by the row counts of the preceding partitions: a table with one row per
partition, so its broadcast has a proven bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.session import cut_lineage

_LOW_BITS = 33


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """1-based position of each row under ``order`` (make ``order`` total for a stable result)."""
    tagged = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    tagged = (tagged.withColumn("_pid", F.shiftright("_mid", _LOW_BITS))
                    .withColumn("_local", F.col("_mid").bitwiseAND((1 << _LOW_BITS) - 1)))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.coalesce("_off", F.lit(0)) + F.col("_local") + 1).cast("long"))
            .drop("_mid", "_pid", "_local", "_off"))


def global_dense_rank(df: DataFrame, cols: list[str], ascending: list[bool],
                      name: str = "dense_rank") -> DataFrame:
    """Dense rank of the distinct ``cols`` values, joined back to every row."""
    order = [F.col(c).asc() if a else F.col(c).desc() for c, a in zip(cols, ascending)]
    ranks = global_row_number(df.select(*cols).distinct(), order, name)
    return df.join(ranks, cols)
