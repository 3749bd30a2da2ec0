"""K4: a stored vector index (inverted file) with inserts.

An index is a folder of four tables: ``centroids`` (k-means over a bounded sample),
``vectors`` (every vector, partitioned by its nearest centroid's cell), ``radii`` (the
largest distance from a centroid, per cell and insert) and ``layout`` (the schema).
A search reads only the cells that it probes (partition pruning) and scores their
vectors exactly. With ``exact`` a second pass reads the cells that may still hold a
better vector by the triangle inequality, so the result is that of ``vector_topk``.
Without it, ``probes_for`` tells how many cells a wanted recall takes on these vectors:
few where they are clustered, most where they have no structure.

Defined results: null vectors, those of another length and those with null or
non-finite components are not indexed and ask nothing; an id that the index holds is not
inserted again, so a repeated insert changes nothing; of equal ids in one insert the
smallest vector stays; an empty table gives an index of one empty cell.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.operators.vector import MAX_QUERY_BLOCK, _blocks, _exact, valid_vectors
from callweave.session import scratch_path, ship_package

SAMPLE = 65_536      # vectors that the centroids are fitted on, about
MAX_CELLS = 1_024    # centroids: few enough to broadcast whatever the number of vectors
SLACK = 1e-6         # of distances, so that rounding leaves out no cell


def _usable(df: DataFrame, dim: int) -> DataFrame:
    odd = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return valid_vectors(df, dim).where(F.col("is_valid") & ~odd).drop("is_valid")


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # at most MAX_CELLS
    return np.array([r["center"] for r in rows], dtype=np.float64)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/layout").schema).parquet(f"{path}/vectors")


def _with_cell(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """Adds the nearest cell (ties: the smaller) and the distance from its centroid."""
    spark = vectors.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast(centers)
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def run(batches):
        c = bc.value
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                cell = ((c * c).sum(axis=1)[None, :] - 2.0 * (v @ c.T)).argmin(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32), distance=np.sqrt(((v - c[cell]) ** 2).sum(axis=1)))

    return vectors.mapInPandas(run, schema)


def build_index(vectors: DataFrame, path: str, dim: int, cells: int | None = None, sample: int = SAMPLE, seed: int = 42) -> None:
    """Fits centroids on a hash sample of about ``sample`` vectors and indexes every ``(id, embedding)``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    spark = vectors.sparkSession
    v = _usable(vectors.select("id", "embedding"), dim)
    n = v.count()
    cells = min(MAX_CELLS, cells or max(1, round(math.sqrt(n))))
    centers = [[0.0] * dim]
    if n:
        share = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / n)) + 1
        model = KMeans(k=cells, seed=seed, maxIter=10, initMode="random").fit(v.where(share).select(array_to_vector("embedding").alias("features")))
        centers = [c.tolist() for c in model.clusterCenters()]
    spark.createDataFrame(list(enumerate(centers)), "cell int, center array<double>").write.parquet(f"{path}/centroids")
    none = v.limit(0).withColumn("cell", F.lit(0))
    none.write.parquet(f"{path}/layout")
    none.write.partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([], "cell int, radius double, vectors long").write.parquet(f"{path}/radii")
    insert(vectors, path)


def insert(vectors: DataFrame, path: str) -> None:
    """Adds vectors whose id the index does not hold. The radii are written first: an insert that
    fails between leaves cells that look wider than they are, and is simply run again."""
    spark = vectors.sparkSession
    centers = _centroids(spark, path)
    layout = spark.read.parquet(f"{path}/layout").schema
    new = _usable(vectors.select("id", "embedding"), centers.shape[1]).groupBy("id").agg(F.min("embedding").alias("embedding"))
    new = new.select(*[F.col(c).cast(layout[c].dataType) for c in ("id", "embedding")])
    staged = scratch_path(spark, "index-insert")
    _with_cell(new.join(_stored(spark, path).select("id"), "id", "left_anti"), centers).write.parquet(staged)
    rows = spark.read.parquet(staged)
    rows.groupBy("cell").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("vectors")).write.mode("append").parquet(f"{path}/radii")
    # files of one cell each, and a hot cell is split over tasks
    rows.select("id", "embedding", "cell").hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def _distances(vecs: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((vecs * vecs).sum(axis=1)[:, None] - 2.0 * (vecs @ centers.T) + (centers * centers).sum(axis=1)[None, :], 0.0))


def _score_cells(bc, k: int):
    def run(batches):
        asked = bc.value
        for pdf in batches:
            for cell, part in pdf.groupby("cell"):
                v, ids = np.stack(part["embedding"].to_numpy()).astype(np.float64), part["id"].to_numpy()
                for j in asked["by_cell"].get(int(cell), ()):
                    s = _exact(v, asked["vecs"][j], "l2")
                    best = np.lexsort((ids, -s))[:k]
                    yield pd.DataFrame({"query_id": [asked["ids"][j]] * len(best), "id": ids[best], "score": s[best]})
    return run


def _probe(stored: DataFrame, ids: list, vecs: np.ndarray, probed: np.ndarray, k: int, schema) -> DataFrame:
    """Best ``k`` a query and batch, over the cells that ``probed`` (query x cell) marks."""
    by_cell = {int(c): np.flatnonzero(probed[:, c]).tolist() for c in np.flatnonzero(probed.any(axis=0))}
    bc = stored.sparkSession.sparkContext.broadcast({"ids": ids, "vecs": vecs, "by_cell": by_cell})
    return stored.where(F.col("cell").isin(sorted(by_cell))).select("id", "embedding", "cell").mapInPandas(_score_cells(bc, k), schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(path: str, queries: DataFrame, k: int = 5, probes: int | None = None, exact: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` by ``1 / (1 + d^2)``, ties by id, among the
    ``probes`` nearest cells (default: an eighth of all), or among all vectors with ``exact``.

    Queries go in blocks of checked size; a block's centroid distances (block x MAX_CELLS) and
    k-th scores (one a query) are all that the driver holds.
    """
    spark = queries.sparkSession
    ship_package(spark)
    centers, stored = _centroids(spark, path), _stored(spark, path)
    radii = np.full(len(centers), -np.inf)  # an empty cell is never worth a probe
    for r in spark.read.parquet(f"{path}/radii").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radii[r["cell"]] = r["radius"]
    probes = min(len(centers), max(1, probes or math.ceil(len(centers) / 8)))
    asked = _usable(queries.select("query_id", "embedding"), centers.shape[1])
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                           T.StructField("id", stored.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    out = [spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType(), False)]))]
    for block in _blocks(asked, centers.shape[1]):
        local = block.toPandas()  # one bounded block
        if not len(local):
            continue
        ids, vecs = local["query_id"].tolist(), np.stack(local["embedding"].to_numpy()).astype(np.float64)
        away = _distances(vecs, centers)
        first = np.zeros(away.shape, dtype=bool)
        np.put_along_axis(first, np.argsort(np.where(np.isinf(radii), np.inf, away), axis=1, kind="stable")[:, :probes], True, axis=1)
        found = _probe(stored, ids, vecs, first, k, schema)
        if exact:
            staged = scratch_path(spark, "index-search")
            _ranked(found, k).write.parquet(staged)
            found = spark.read.parquet(staged)
            worst = {r["query_id"]: r["s"] for r in found.where(F.col("rank") == k).select("query_id", F.col("score").alias("s")).collect()}
            reach = np.array([math.sqrt(max(1.0 / worst[i] - 1.0, 0.0)) if i in worst else np.inf for i in ids])
            more = ~first & ~np.isinf(radii)[None, :] & (away - radii[None, :] <= (reach + SLACK * (1.0 + away.max(axis=1)))[:, None])
            found = found.drop("rank")
            if more.any():
                found = found.unionByName(_probe(stored, ids, vecs, more, k, schema))
        out.append(_ranked(found, k))
    return reduce(lambda a, b: a.unionByName(b), out)


def probes_for(path: str, queries: DataFrame, k: int = 5, recall: float = 0.95) -> int:
    """The number of nearest cells that hold at least ``recall`` of the exact neighbours of a
    tuning set of at most ``MAX_QUERY_BLOCK`` queries."""
    spark = queries.sparkSession
    centers = _centroids(spark, path)
    asked = _usable(queries.select("query_id", "embedding"), centers.shape[1])
    if asked.count() > MAX_QUERY_BLOCK:
        raise ValueError(f"a tuning set has at most {MAX_QUERY_BLOCK} queries")
    local = asked.toPandas()
    held = search(path, asked, k).select("query_id", "id").join(_stored(spark, path).select("id", "cell"), "id").select("query_id", "cell").collect()
    if not held:
        return 1
    order = np.argsort(_distances(np.stack(local["embedding"].to_numpy()).astype(np.float64), centers), axis=1, kind="stable")
    place = dict(zip(local["query_id"], np.argsort(order, axis=1)))  # of each cell in the query's order
    places = sorted(int(place[r["query_id"]][r["cell"]]) + 1 for r in held)
    return places[math.ceil(recall * len(places)) - 1]
