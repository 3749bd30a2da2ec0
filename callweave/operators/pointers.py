"""Pointer doubling: chains of any length in as many rounds as their length has binary digits."""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import cut_and_count, cut_lineage


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def follow(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointer doubling over ``pointers(node, to, w)``, one row a node: (``ends(node, end, dist)``: the first
    node behind that has no pointer, and the sum of ``w`` on the way; ``rings(node, low)``: nodes that come to
    none, as they are on or run into a ring, with the lowest id that they pass).
    The number of rounds is the logarithm of the longest chain."""
    first = pointers.select("node", "to", F.col("w").cast("long").alias("dist"), F.least("node", "to").alias("low"))
    open_, n = cut_and_count(first, "pointers")
    ends = []
    rounds = ceil(log2(n)) + 1 if n else 0
    for _ in range(rounds + 1):
        ahead = open_.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("dist").alias("more"), F.col("low").alias("lower"))
        if ends:
            done = union(ends)
            ahead = ahead.unionByName(done.select(F.col("node").alias("to"), F.col("end").alias("further"), F.col("dist").alias("more"), F.col("node").alias("lower"))
                                      .withColumn("closed", F.lit(True)), allowMissingColumns=True)
        else:
            ahead = ahead.withColumn("closed", F.lit(None).cast("boolean"))
        step = open_.join(ahead, "to", "left")
        closed = F.col("further").isNull() | F.coalesce("closed", F.lit(False))
        step, _ = cut_and_count(step.select(
            "node", F.coalesce("further", "to").alias("to"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"),
            F.least("low", F.coalesce("lower", "low")).alias("low"), closed.alias("closed")), "pointers")
        ends.append(step.where("closed").select("node", F.col("to").alias("end"), "dist"))
        open_ = step.where("NOT closed").drop("closed")
        if open_.isEmpty():
            break
    empty = open_.select("node", F.col("to").alias("end"), "dist").limit(0)
    return (cut_lineage(union(ends)) if ends else empty), open_.select("node", "low")
