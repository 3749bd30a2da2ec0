"""Exact top-k inner products by dual-tree cover-tree search (operator 13).

Components become integers floor(256 x); the score of a query and a candidate is their
integer inner product. Queries and data are one index: a cover tree whose top level is a
net of ``pivots`` points, picked farthest first from a bounded sample of ``sample`` vectors
(it places rows, it leaves none out), and whose subtrees are grown in the tasks.

1. Equal vectors are one point with its k + 1 lowest ids: more of them can be in no result.
   Every point goes to its nearest pivot; a pivot's points are cut by a hash into tiles of
   ``tile`` points at most, so a group of any size is many tiles.
2. A task grows a tile's tree, and a tree of the queries that lie in the tile (blocks of
   ``BLOCK``), and descends both (``covertree``). Each query's (k + 1)-th best score there,
   its own row included, is a floor of what it can still find.
3. Query and pivot are a pair of nodes of the top level: where the pivot's covering radius
   keeps every product below the query's floor, the pivot is pruned. Queries join
   the tiles of the pivots that stay (all but their own) and are searched there with their floors.
4. Each query's lists are merged (a limit a query before the shuffle), its own row is taken
   out, and k stay.

A task reads its rows in order and holds one tile and one block of queries. Copies of a query
are at most the number of tiles: vectors without structure in many dimensions prune
little, and the search is then one of blocks.

Defined results: vectors that are null or hold a null or non-finite component take no part;
vectors score only with vectors of their length (empty vectors: 0). A query finds every row
but itself, rows of its id or its vector included; a repeated query row has results of its
own. Rows with a null id are no queries and come last among equal scores (the largest long
stands for null inside). Fewer than k candidates: all of them. Integers beyond +-2^58 are
held there, scores beyond a long are held at its bounds. Columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import prepare_python, written
from callweave.llm.covertree import Search, grow
from callweave.llm.vectors import LIMIT, LONG, by_length, usable_vectors

SCALE, K, EVERY = 256, 5, 50
PIVOTS, SAMPLE = 32, 4_096
#: points of a tile: a share of all, between these bounds
TILES, LEAST, MOST = 256, 512, 16_384
BLOCK = 2_048
FOUND = "key long, own long, score long, vec_id long"


def points_of(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id (null: the largest long) and x (array of long) of the rows that take part."""
    rows = usable_vectors(embeddings, vector_col, vec_id=F.coalesce(F.col(id_col).cast("long"), F.lit(LONG)))
    held = lambda c: F.floor(F.greatest(F.least(SCALE * c, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long")
    return rows.select("vec_id", F.transform("v", held).alias("x"))


def net(points: DataFrame, pivots: int, sample: int) -> dict[int, np.ndarray]:
    """The centres of the top level, by vector length: a net of a seeded sample. Rows are thinned
    by a hash first, so that tasks send few however many tasks there are."""
    draw = F.shiftrightunsigned(F.xxhash64("vec_id", "x"), 1)
    share = min(1.0, 4 * sample / max(1, points.count()))
    rows = points.where(draw <= min(LONG, int(share * LONG))).orderBy(draw, "x").limit(sample).select("x").collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r["x"]), []).append(r["x"])
    out = {}
    for d, xs in by_dim.items():
        x = np.array(xs, float).reshape(len(xs), d)
        picks, near = [0], np.linalg.norm(x - x[0], axis=1)
        while len(picks) < pivots and near.max() > 0:
            picks.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(x - x[picks[-1]], axis=1))
        out[d] = x[picks]
    return out


def centres_of(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """A length that the sample does not hold has the origin as its only centre."""
    return pivots.get(dim, np.zeros((1, dim)))


def placed(points: DataFrame, pivots: dict[int, np.ndarray], k: int) -> DataFrame:
    """key, dim, pivot, radius, x, ids: each different vector with its pivot and its lowest ids."""
    first = Window.partitionBy("x").orderBy("vec_id")
    different = (points.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
                 .groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("key"), "x", "ids"))
    names = ["key", "dim", "pivot", "radius", "x", "ids"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, m in by_length(b.column(1)):
                x, centres = m.astype(float), centres_of(pivots, m.shape[1])
                far = np.stack([np.linalg.norm(x - c, axis=1) for c in centres])
                own = far.argmin(axis=0)
                rows = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(at), m.shape[1], np.int32)), pa.array(own.astype(np.int32)), pa.array(far.min(axis=0)), rows.column(1), rows.column(2)], names)

    return different.mapInArrow(place, "key long, dim int, pivot int, radius double, x array<long>, ids array<long>")


def _runs(b: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The stretches of a batch with one (dim, pivot, tile, asks)."""
    if not b.num_rows:
        return
    marks = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
    starts = np.flatnonzero(np.r_[True, (np.diff(marks) != 0).any(axis=0)])
    for a, z in zip(starts, [*starts[1:], b.num_rows]):
        yield tuple(marks[:, a].tolist()), b.slice(a, z - a)


def search_tiles(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (dim, pivot, tile, asks, key, x, ids, floor): data, and queries that ask them.
    key, own, score, vec_id: the k + 1 best rows of each query in each tile it asks."""
    dealt = rows.repartition("dim", "pivot", "tile").sortWithinPartitions("dim", "pivot", "tile", "asks", "key")

    def answer(search: Search, keys: list[int], queries: np.ndarray, floors: list[int | None]) -> pa.RecordBatch:
        # without a floor everything counts: below any product
        low = -(queries.shape[1] * LIMIT * LIMIT) - 1
        given = np.array([low if f is None else f for f in floors], object)
        scores, places = search.top(queries, given)
        clip = lambda s: max(-LONG, min(LONG, int(s)))
        out: list[tuple[int, int, int, int]] = []
        for key, q, floor, score, place in zip(keys, queries.astype(object), floors, scores, places):
            own = clip((q * q).sum())
            best = sorted((-clip(s), int(i)) for s, p in zip(score, place) if p >= 0 for i in search.ids[p])[:k + 1]
            out += [(key, own, -s, i) for s, i in best if floor is None or -s >= floor]
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(4)], [f.split()[0] for f in FOUND.split(", ")])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, data, ids, search = None, [], [], None
        keys: list[int] = []
        queries: list[np.ndarray] = []
        floors: list[int | None] = []

        def asked() -> Iterator[pa.RecordBatch]:
            if keys and search:
                m = np.concatenate(queries)
                for a in range(0, len(keys), BLOCK):
                    yield answer(search, keys[a:a + BLOCK], m[a:a + BLOCK], floors[a:a + BLOCK])
            keys.clear(), queries.clear(), floors.clear()

        for batch in batches:
            for mark, run in _runs(batch):
                if mark[:3] != tile:
                    yield from asked()
                    tile, data, ids, search = mark[:3], [], [], None
                m = run.column(5).flatten().to_numpy(zero_copy_only=False).reshape(run.num_rows, mark[0])
                if not mark[3]:
                    data.append(m)
                    ids += [np.array(i, np.int64) for i in run.column(6).to_pylist()]
                    continue
                if search is None and data:
                    search, data = Search(np.concatenate(data), ids, k + 1), []
                keys += run.column(4).to_pylist()
                queries.append(m)
                floors += run.column(7).to_pylist()
                if len(keys) >= BLOCK:
                    yield from asked()
        yield from asked()

    return dealt.select("dim", "pivot", "tile", "asks", "key", "x", "ids", "floor").mapInArrow(tiles, FOUND)


def top_k(embeddings: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          pivots: int = PIVOTS, sample: int = SAMPLE, least: int = LEAST, most: int = MOST) -> DataFrame:
    """query_id, rank, vec_id, score of every row for whose id ``is_query`` (Column to Column) holds."""
    prepare_python(embeddings.sparkSession)
    rows = points_of(embeddings, id_col, vector_col)
    centres = net(rows, pivots, sample)
    points = written(placed(rows, centres, k), "points")
    asks = rows.where((F.col("vec_id") != LONG) & is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "x")
    asks = written(asks.join(points.select("x", "key"), "x").select("query_id", "key"), "queries")

    counted = points.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("reach"))
    total = F.sum("n").over(Window.partitionBy())  # a row a pivot
    size = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(total / TILES)))
    groups = written(counted.select("dim", "pivot", "reach", F.ceil(F.col("n") / size).cast("int").alias("tiles")), "groups")
    tiled = points.join(F.broadcast(groups), ["dim", "pivot"]).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    data = tiled.select("dim", "pivot", "tile", F.lit(0).alias("asks"), "key", "x", "ids", F.lit(None).cast("long").alias("floor"))
    no_ids = F.array().cast("array<long>").alias("ids")
    queries = tiled.join(asks.select("key").distinct(), "key", "left_semi")
    home = queries.select("dim", "pivot", "tile", F.lit(1).alias("asks"), "key", "x", no_ids, F.lit(None).cast("long").alias("floor"))
    near = written(search_tiles(data.unionByName(home), k), "near")

    floors = near.groupBy("key").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("floor"))
    reach: dict[int, dict[int, float]] = {}
    for r in groups.collect():  # ``pivots`` rows a vector length
        reach.setdefault(r["dim"], {})[r["pivot"]] = r["reach"]

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pivots that a query's floor does not prune."""
        for b in batches:
            for at, m in by_length(b.column(1)):
                x, radii = m.astype(float), reach[m.shape[1]]
                p = np.array(sorted(radii))
                centres = centres_of(centres_by_dim, m.shape[1])[p]
                sizes, wide = np.linalg.norm(x, axis=1)[:, None], np.array([radii[i] for i in p.tolist()])[None]
                above = x @ centres.T + sizes * wide
                above += 1e-9 * (sizes * (np.linalg.norm(centres, axis=1)[None] + wide) + 1)
                floor = b.column(2).take(pa.array(at)).to_numpy(zero_copy_only=False).astype(float)
                q, j = np.nonzero(np.isnan(floor)[:, None] | (above >= floor[:, None]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[q])), pa.array(p[j].astype(np.int32))], ["key", "at"])

    centres_by_dim = centres
    asked = written(queries.join(floors, "key", "left").select("key", "dim", "pivot", "tile", "x", "floor"), "asked")
    open_ = asked.select("key", "x", "floor").mapInArrow(survive, "key long, at int")
    spread = asked.join(open_, "key").select("dim", F.col("at").alias("to"), "key", "x", "floor", F.col("pivot").alias("home"), F.col("tile").alias("home_tile"))
    every = F.broadcast(groups.select("dim", F.col("pivot").alias("to"), "tiles"))
    spread = spread.join(every, ["dim", "to"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.where((F.col("to") != F.col("home")) | (F.col("tile") != F.col("home_tile")))
    away = spread.select("dim", F.col("to").alias("pivot"), "tile", F.lit(1).alias("asks"), "key", "x", no_ids, "floor")
    far = search_tiles(data.unionByName(away), k)

    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    lists = (near.unionByName(far).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
             .groupBy("key").agg(F.first("own").alias("own"), F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))).alias("found")))
    itself = F.array_position("found", F.struct((-F.col("own")).alias("down"), F.col("query_id").alias("vec_id")))
    others = F.filter("found", lambda f, i: (i + 1) != F.col("itself"))
    ranked = (asks.join(lists, "key").withColumn("itself", itself).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("i", "f")))
    return ranked.select("query_id", (F.col("i") + 1).alias("rank"), F.nullif("f.vec_id", F.lit(LONG)).alias("vec_id"), (-F.col("f.down")).alias("score"))
