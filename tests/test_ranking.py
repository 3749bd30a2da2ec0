"""Distributed global ranks against Python, across many partitions."""

import random

from pyspark.sql import functions as F

from callweave.operators.ranking import global_dense_rank, global_row_number


def test_row_number_and_dense_rank(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(40), rnd.randrange(5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, a int, b int").repartition(13)
    rn = {r.id: r.pos for r in global_row_number(df, [F.desc("a"), F.col("b"), F.col("id")], "pos").collect()}
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[2], r[0]))]
    assert [i for i, _ in sorted(rn.items(), key=lambda kv: kv[1])] == want
    assert sorted(rn.values()) == list(range(1, 2001))
    dr = {r.id: r.dr for r in global_dense_rank(df, ["a", "b"], [False, True], "dr").collect()}
    keys = sorted({(r[1], r[2]) for r in rows}, key=lambda k: (-k[0], k[1]))
    rank = {k: i + 1 for i, k in enumerate(keys)}
    assert dr == {r[0]: rank[(r[1], r[2])] for r in rows}
