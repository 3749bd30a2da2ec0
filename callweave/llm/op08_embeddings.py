"""Embedding near-duplicates by a subspace pigeonhole join (operator 8).

Unit vectors have a cosine of at least c iff their squared distance is at most
2 - 2c. The vectors are turned by a seeded random rotation, which keeps distances and
spreads them evenly, and cut into ``parts`` blocks of a few dimensions. If two
vectors are within the budget, then in some block they are within that block's share
of it (by dimensions): the blocks' distances add up to the whole. So every block is
range-joined under its own share, and what any block finds is verified exactly, in
double precision on the given components.

Range join of a block: its first coordinate is cut into cells as wide as the block's
radius (and the slack that the claim of a block has), so partners are in the same or the next cell. A cell with more than ``tile``
vectors is cut into tiles by a hash, and every pair of tiles of neighbouring cells is
one task's group: two tiles at most in memory, however many vectors a cell holds.
A pair that several blocks find counts in the first of them. A group returns one row
a vector (links found, and the link of a spanning forest of what it found), never the
pairs. Equal vectors are one row in the join; their links are counted by number.

Cost: at most the square of the number of different vectors per block and cell pair,
in matrix products; high-dimensional vectors without structure prune little.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors link only with vectors of their length. A repeated
vec_id stands for several vectors; rows of one id form one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import prepare_python, written
from callweave.operators.graph import star_components

COSINE, PARTS, TILE, SEED = 0.9, 4, 32_768, 20
#: cells of the matrix of distances that are in memory at once
STRIP = 1 << 24
#: rounding of the rotated single-precision coordinates: candidates only, the exact check follows
SLACK = 1e-3


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def part_edges(dim: int, parts: int) -> list[int]:
    return [dim * i // min(parts, dim) for i in range(min(parts, dim) + 1)]


def distinct_vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(v, n, low, dim): each usable vector once, how often it comes and its lowest id."""
    v = F.col(vector_col)
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    return rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).withColumn("dim", F.size("v"))


def _turned(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return unit @ rotation(vectors.shape[1])


def cells(vectors: DataFrame, budget: float, parts: int) -> DataFrame:
    """(key, part, cell, v, n): each vector in each block's cell."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, g in b.groupby("dim"):
                v = np.stack(g["v"].to_numpy()).astype(float)
                # a vector's length may overflow or vanish when squared: scale first
                t = _turned(v / np.abs(v).max(axis=1, keepdims=True))
                edges = part_edges(int(dim), parts)
                for p, (a, z) in enumerate(zip(edges, edges[1:])):
                    width = np.sqrt(budget * (z - a) / dim + 2 * SLACK) + SLACK  # what a block claims, it must have met
                    yield pd.DataFrame({"key": g["key"], "dim": g["dim"], "part": p, "cell": np.floor(t[:, a] / width).astype(np.int64)})

    return vectors.select("key", "dim", "v").mapInPandas(deal, "key long, dim int, part int, cell long")


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of a graph on 0..n-1."""
    top = list(range(n))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = root(a), root(b)
        if a != b:
            top[max(a, b)] = min(a, b)
            kept.append(k)
    return left[kept], right[kept]


def _group_links(group: pd.DataFrame, cosine: float, parts: int) -> pd.DataFrame:
    """Links between the two sides of a group (one side: among its own)."""
    group = group.drop_duplicates(["key", "side"]).sort_values("key")
    a, b = group[group["side"] == 0], group[group["side"] == 1]
    own = len(b) == 0 and not group["two"].iloc[0]
    b = a if own else b
    if len(a) == 0 or len(b) == 0:
        return pd.DataFrame({"key": [], "links": [], "other": []})
    va, vb = np.stack(a["v"].to_numpy()).astype(float), np.stack(b["v"].to_numpy()).astype(float)
    va, vb = (x / np.abs(x).max(axis=1, keepdims=True) for x in (va, vb))
    ua, ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (va, vb))
    dim, part = va.shape[1], int(group["part"].iloc[0])
    budget, edges = 2 - 2 * cosine, part_edges(va.shape[1], parts)
    turn = rotation(dim)
    ta, tb = (ua @ turn).astype("f4"), (ub @ turn).astype("f4")

    def within(p: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether pairs of rows are within the share of block p."""
        s = slice(edges[p], edges[p + 1])
        return ((x[:, s] - y[:, s]) ** 2).sum(axis=1) <= budget * (edges[p + 1] - edges[p]) / dim + SLACK

    s = slice(edges[part], edges[part + 1])
    share = budget * (edges[part + 1] - edges[part]) / dim + SLACK
    na, nb = (ta[:, s] ** 2).sum(axis=1), (tb[:, s] ** 2).sum(axis=1)
    step = max(1, STRIP // len(b))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for top in range(0, len(a), step):  # the tiles are large, so that few copies are made; their distances are not held at once
        first = top if own else 0
        i, j = np.nonzero(na[top:top + step, None] + nb[None, first:] - 2 * (ta[top:top + step, s] @ tb[first:, s].T) <= share + SLACK)
        i, j = i + top, j + first
        keep = within(part, ta[i], tb[j])
        if own:
            keep &= i < j
        for p in range(part):
            keep[keep] = ~within(p, ta[i[keep]], tb[j[keep]])
        i, j = i[keep], j[keep]
        exact = np.einsum("ij,ij->i", ua[i], ub[j]) >= cosine
        found.append((i[exact], j[exact]))
    i, j = (np.concatenate(x) for x in zip(*found))
    keys_a, keys_b, many_a, many_b = a["key"].to_numpy(), b["key"].to_numpy(), a["n"].to_numpy(), b["n"].to_numpy()
    links_a, links_b = np.bincount(i, many_b[j], len(a)), np.bincount(j, many_a[i], len(b))
    x, y = _forest(len(a) + len(b), i, j if own else j + len(a))
    names = keys_a if own else np.concatenate([keys_a, keys_b])
    out = [pd.DataFrame({"key": k[n > 0], "links": n[n > 0], "other": -1}) for k, n in ((keys_a, links_a), (keys_b, links_b))]
    out.append(pd.DataFrame({"key": names[x], "links": 0, "other": names[y]}))
    return pd.concat(out)


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                    parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = embeddings.sparkSession
    prepare_python(spark)
    vectors = written(distinct_vectors(embeddings, id_col, vector_col).withColumn("key", F.monotonically_increasing_id()), "vectors")
    placed = written(cells(vectors, 2 - 2 * cosine, parts), "cells")
    # tiles: as many as a cell's vectors need
    sized = placed.groupBy("dim", "part", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    around = sized.select("dim", "part", (F.col("cell") + 1).alias("cell"), F.col("tiles").alias("below"))
    after = sized.select("dim", "part", (F.col("cell") - 1).alias("cell"), F.col("tiles").alias("above"))
    at = ["dim", "part", "cell"]
    p = placed.join(vectors.select("key", "v", "n"), "key").join(sized.join(around, at, "left").join(after, at, "left").fillna(0, ["below", "above"]), at)
    p = p.withColumn("t", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1))
    none = F.array().cast("array<struct<cell:bigint,a:int,b:int,two:boolean,side:int>>")
    place = lambda cell, a, b, two, side: F.struct(cell.cast("long").alias("cell"), a.cast("int").alias("a"), b.cast("int").alias("b"), two.alias("two"), side.cast("int").alias("side"))
    t, cell = F.col("t"), F.col("cell")
    same = F.transform(upto(F.col("tiles")), lambda o: place(cell, F.least(t, o), F.greatest(t, o), t != o, F.when(t <= o, 0).otherwise(1)))
    up = F.transform(upto(F.col("above")), lambda o: place(cell, t, o + (1 << 20), F.lit(True), F.lit(0)))
    down = F.transform(upto(F.col("below")), lambda o: place(cell - 1, o, t + (1 << 20), F.lit(True), F.lit(1)))
    groups = p.withColumn("g", F.explode(F.concat(same, F.coalesce(up, none), F.coalesce(down, none)))).select("key", "dim", "part", "v", "n", "g.*")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        return _group_links(group, cosine, parts)

    found = written(groups.groupBy("dim", "part", "cell", "a", "b").applyInPandas(links, "key long, links double, other long"), "vector-links")
    lows = vectors.select(F.col("key").alias("k"), F.col("low").alias("o"))
    edges = (found.where("other >= 0").join(vectors.select("key", "low"), "key").join(lows, F.col("other") == F.col("k"))
             .select(F.col("low").alias("src"), F.col("o").alias("dst")).where("src != dst").distinct())
    classes = star_components(vectors.select(F.col("low").alias("id")).distinct(), written(edges, "vector-edges"), "id")
    counts = found.where("other < 0").groupBy("key").agg(F.sum("links").alias("links"))
    info = (vectors.join(counts, "key", "left").join(classes, F.col("low") == F.col("id"), "left")
            .select("v", (F.coalesce("links", F.lit(0.0)).cast("long") + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id")))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    out = rows.join(info, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
