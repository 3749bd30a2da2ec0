"""Vector code compression by equal-average nearest-entry search (operator 12).

A vector's components become integers floor(256 x) and are cut into ``parts`` equal
consecutive parts (of lengths that differ by one at most if they cannot be equal). Each
part position has a codebook of ``entries`` entries, begun with the vectors of the
smallest ids and moved ``rounds`` times to the floored means of the parts nearest to them.

Nearest entry: by Cauchy and Schwarz, two parts of length d whose component sums differ by g
are at a squared distance of g^2 / d at least. The entries are sorted by their sums; from the
place of a part's own sum the search goes outward, the nearer side first, and stops
when g^2 / d strictly exceeds the best distance so far, so equal distances are all seen and
go to the lower index. Many parts advance side by side as numpy lanes.

Each round is one pass of Spark over the rows: a task returns sums and counts by part, entry
and position, summed natively. The codebooks (entries times the vector length) are all that
reaches the driver.

Defined results: rows whose vector is null or holds a null or non-finite component are left
out; empty vectors have empty parts (index 0, distance 0); an empty table gives no row.
Vectors of each length have codebooks of their own. Null ids come last among the smallest,
equal ids by their vectors; repeated rows count and come out each; with fewer than
``entries`` vectors there are as many entries as vectors. Integers beyond +-2^58 are held
there; an error beyond a long is null, and so is the sum of a label that holds one. Null labels
are one label. Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from callweave.llm.common import prepare_python, written
from callweave.llm.vectors import by_length, column_sums, decimals, floors, largest, longs, roomy, usable_vectors

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
Codebook = list[np.ndarray]


def part_edges(dim: int, parts: int) -> list[int]:
    return [dim * p // parts for p in range(parts + 1)]


def nearest_entries(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (lowest of equals) and the squared distance."""
    d, n, k = vectors.shape[1], len(vectors), len(entries)
    bound = d * d * (largest(vectors) + largest(entries)) ** 2
    vectors, entries = roomy(vectors, bound), roomy(entries, bound)
    sums = entries.sum(axis=1)
    order = np.lexsort((np.arange(k), sums)) if sums.dtype != object else np.array(sorted(range(k), key=lambda e: (sums[e], e)))
    sums, mine = sums[order], vectors.sum(axis=1)
    right = np.searchsorted(sums, mine).astype(np.int64)
    left = right - 1
    best, index = np.zeros(n, vectors.dtype), np.full(n, -1, np.int64)
    rows = np.arange(n)
    while len(rows):
        l, r, own = left[rows], right[rows], mine[rows]
        below, above = own - sums[np.maximum(l, 0)], sums[np.minimum(r, k - 1)] - own
        down = (l >= 0) & ((r >= k) | (below <= above))
        gap = np.where(down, below, above)
        # the nearer side fails only if both do
        live = ((l >= 0) | (r < k)) & ((index[rows] < 0) | (gap * gap <= d * best[rows])).astype(bool)
        rows, l, r, down = rows[live], l[live], r[live], down[live]
        e = order[np.where(down, l, r)]
        z = vectors[rows] - entries[e]
        far = (z * z).sum(axis=1)
        better = (index[rows] < 0) | (far < best[rows]) | ((far == best[rows]) & (e < index[rows]))
        better = better.astype(bool)
        best[rows[better]], index[rows[better]] = far[better], e[better]
        left[rows], right[rows] = l - down, r + ~down
    return index, best


def assign(q: np.ndarray, book: Codebook) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(part's rows, indices, distances) for each part position."""
    edges = part_edges(q.shape[1], len(book))
    for p, entries in enumerate(book):
        sub = q[:, edges[p]:edges[p + 1]]
        yield sub, *(nearest_entries(sub, entries) if sub.shape[1] else (np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)))


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> dict[int, Codebook]:
    books = {}
    for d in sorted(r[0] for r in vectors.select(F.size("v")).distinct().collect()):
        rows = vectors.where(F.size("v") == d).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
        first = floors(np.array([r["v"] for r in rows], float).reshape(len(rows), d), SCALE)
        edges = part_edges(d, parts)
        books[d] = [first[:, a:z] for a, z in zip(edges, edges[1:])]
    return books


def moved(vectors: DataFrame, books: dict[int, Codebook]) -> dict[int, Codebook]:
    """The codebooks after one round."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: [(np.zeros(b.shape, object), np.zeros(len(b), np.int64)) for b in book] for d, book in books.items()}
        for batch in batches:
            for _, m in by_length(batch.column(0)):
                d = m.shape[1]
                for (sums, counts), (sub, index, _) in zip(total[d], assign(floors(m, SCALE), books[d])):
                    order = np.argsort(index, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(index[order]) > 0]) if len(order) else np.zeros(0, np.int64)
                    for a, z in zip(starts, [*starts[1:], len(order)]):
                        e = index[order[a]]
                        sums[e] += column_sums(sub[order[a:z]])
                        counts[e] += z - a
        for d, parts in total.items():
            for p, (sums, counts) in enumerate(parts):
                e, i = np.nonzero(np.repeat(counts[:, None] > 0, sums.shape[1], axis=1))
                if len(e):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d] * len(e), pa.int32()), pa.array([p] * len(e), pa.int32()), pa.array(e, pa.int32()), pa.array(i, pa.int32()), decimals(sums[e, i]), pa.array(counts[e])],
                        ["dim", "part", "entry", "i", "s", "n"])

    rows = vectors.select("v").mapInArrow(add, "dim int, part int, entry int, i int, s decimal(38,0), n long")
    out = {d: [b.copy() for b in book] for d, book in books.items()}
    for r in rows.groupBy("dim", "part", "entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        out[r["dim"]][r["part"]][r["entry"], r["i"]] = int(r["s"]) // r["n"]
    return out


def codebooks_digest(book: Codebook) -> str:
    return hashlib.sha256(",".join(str(int(x)) for part in book for x in part.ravel()).encode()).hexdigest()


def compress(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, Codebook]]:
    """(vec_id, label, code, error, codebooks_sha256 of every usable vector; the codebooks by length)."""
    prepare_python(embeddings.sparkSession)
    vectors = usable_vectors(embeddings, vector_col, vec_id=F.col(id_col).cast("long"), label=F.col(label_col))
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds):
        books = moved(vectors, books)
    digests = {d: codebooks_digest(b) for d, b in books.items()}
    schema = StructType([*vectors.schema.fields[:2]]).add("code", StringType()).add("error", LongType()).add("codebooks_sha256", StringType())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, m in by_length(b.column(2)):
                found = [(index, far) for _, index, far in assign(floors(m, SCALE), books[m.shape[1]])]
                error = sum(far.astype(object) if largest(far) >= 1 << 58 else far for _, far in found)
                hexes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
                picked = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(picked), b.column(1).take(picked), pa.array([r.tobytes().hex() for r in hexes]), longs(error), pa.array([digests[m.shape[1]]] * len(at))],
                    schema.names)

    return vectors.mapInArrow(code, schema), books


def decompress(codes: DataFrame, book: Codebook) -> DataFrame:
    """``codes`` with ``approximation``: the vector that a code stands for, in the scale of the input."""
    table = [[[int(x) / SCALE for x in e] for e in part] for part in book]
    entries = F.array(*[F.array(*[F.array(*[F.lit(x) for x in e]).cast("array<double>") for e in part]) for part in table])
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1
    return codes.withColumn("approximation", F.concat(*[F.element_at(F.element_at(entries, p + 1), index(p)) for p in range(len(book))]))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows of a label. The codes are written first, and the sums
    too, so that the join knows their size and can split the rows of a large label."""
    codes = written(codes, "vector-codes")
    sums = codes.groupBy(F.col("label").alias("of")).agg(
        F.when(F.count("error") == F.count(F.lit(1)), F.try_sum(F.col("error").cast("decimal(38,0)"))).try_cast("long").alias("label_error"))
    sums = written(sums, "label-errors")
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"]), "left").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
