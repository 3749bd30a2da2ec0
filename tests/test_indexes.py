"""Stored indexes: names by edit distance, vectors by cells, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.operators import fuzzy as Z
from callweave.operators import vector as V
from callweave.operators import vector_index as I
from callweave.session import scratch_path

VECTORS = "id long, embedding array<float>"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(r, name, times):
    for _ in range(times):
        at = r.randrange(len(name) + 1)
        name = r.choice([name[:at] + r.choice("ab_é") + name[at:], name[:at] + name[at + 1:], name[:at] + r.choice("ab") + name[at + 1:]])
    return name


@pytest.mark.parametrize("d", [1, 2])
def test_fuzzy_pairs_equal_all_pairs(spark, d):
    """Lengths around the border of the two ways of filing, edits at both ends, repeats and odd names."""
    r = random.Random(d)
    names = ["".join(r.choice("abc_") for _ in range(n)) for n in (1, 2, 5, 10, 11, 12, 13, 14, 15, 16, 20, 40) for _ in range(4)]
    names += ["", "A", "ab", "Ba", "load_File", "x" * 3000] + names[:3]
    asked = [changed(r, n, t) for n in names for t in (0, 1, 2, 3)]
    pairs = lambda rows: spark.createDataFrame([(x,) for x in rows] + [(None,)], "name string")
    got = Z.fuzzy_pairs(Z.name_index(pairs(names), max_distance=d), pairs(asked), max_distance=d).collect()
    low = lambda rows: {x.lower() for x in rows}
    want = {(a, n, edits(a, n)) for a in low(asked) for n in low(names) if abs(len(a) - len(n)) <= d and edits(a, n) <= d}
    assert len(got) == len(want) and {tuple(g) for g in got} == want


def test_fuzzy_functions(spark):
    f = spark.createDataFrame([(1, "Load_file", 3), (2, "load_file", 4), (3, "unload", 5), (4, None, 6)], "lookup_id long, name string, distance_from int")
    asked = spark.createDataFrame([("lod_file",), ("nothing",)], "wanted string")
    rows = Z.fuzzy_functions(f, asked, "wanted").select("lookup_id", "asked", "distance").collect()
    assert sorted(map(tuple, rows)) == [(1, "lod_file", 1), (2, "lod_file", 1)]
    assert Z.fuzzy_functions(f.limit(0), asked, "wanted").count() == 0 and Z.fuzzy_functions(f, asked.limit(0), "wanted").count() == 0


def rows_of(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())


def clustered(n, dim=8, seed=3):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(10, dim)) * 5
    return [(i, (centers[i % 10] + r.normal(size=dim) * 0.3).astype(np.float32).tolist()) for i in range(n)]


def test_index_equals_the_exact_search_after_inserts(spark):
    rows = clustered(600)
    bad = [(900, None), (901, [1.0]), (902, [None] * 8), (903, [float("nan")] * 8), (904, [float("inf")] * 8)]
    frame = lambda x: spark.createDataFrame(x, VECTORS)
    root = scratch_path(spark, "index-test")
    I.build_index(frame(rows[:300] + bad), root, 8, cells=12)
    far = [(700, [90.0] * 8), (701, [90.0] * 8)]  # beyond every cell's radius until now
    I.insert(frame(rows[250:] + far), root)
    I.insert(frame(rows[::7] + [(5, [0.0] * 8)]), root)  # held: nothing changes
    every = rows + far
    queries = spark.createDataFrame([(i, v) for i, v in rows[::40]] + [(998, [90.0] * 8), (999, None), (1000, [1.0])], "query_id long, embedding array<float>")
    exact = V.vector_topk(frame(every), queries, k=7, dim=8)
    assert rows_of(I.search(root, queries, k=7, probes=1)) == rows_of(exact)
    probes = I.probes_for(root, queries.where("query_id % 80 = 0"), 7)
    assert probes < 6
    near = I.search(root, queries, k=7, probes=probes, exact=False)
    assert V.recall(near, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert rows_of(I.search(root, queries, k=1000, probes=2)) == rows_of(V.vector_topk(frame(every), queries, k=1000, dim=8))
    assert I.search(root, queries.limit(0)).count() == 0


def test_search_reads_only_probed_cells(spark):
    root = scratch_path(spark, "index-test")
    I.build_index(spark.createDataFrame(clustered(400), VECTORS), root, 8, cells=10)
    q = spark.createDataFrame([(1, clustered(1)[0][1])], "query_id long, embedding array<float>")
    near = I.search(root, q, 3, probes=1, exact=False)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan or "PartitionFilters: [cell" in plan
    assert near.count() == 3


def test_empty_index(spark):
    root = scratch_path(spark, "index-test")
    none = spark.createDataFrame([], VECTORS)
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>")
    I.build_index(none, root, 2)
    assert I.search(root, q).count() == 0
    I.insert(spark.createDataFrame([(4, [1.0, 1.0]), (4, [0.0, 1.0])], VECTORS), root)
    assert [(r.id, round(r.score, 6)) for r in I.search(root, q).collect()] == [(4, round(1 / 3, 6))]


def test_recall_of_the_registered_query(spark):
    from callweave.plans.catalog import QUERIES
    from tests.conftest import SF01
    got = [r.recall for r in QUERIES["vector_index_recall"](spark, SF01).collect()]
    assert len(got) == 10 and sum(got) / len(got) >= 0.9
