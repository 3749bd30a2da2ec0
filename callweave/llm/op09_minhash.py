"""MinHash near-dedup by ProbMinHash (operator 9).

A document is the multiset of its five-word shingles (fewer words: one shingle of
all of them). Two documents are near-duplicates if the weighted Jaccard similarity
of the multisets, sum of minima over sum of maxima, is at least 0.8; classes are the
connected components of these links and of equal texts.

1. Equal texts are one *print* (128-bit digest of the text).
2. ProbMinHash: every shingle is a Poisson process whose rate is its weight; each
   arrival falls into one of ``bands * rows`` registers, which keeps its earliest
   arrival. An element stops as soon as its next arrival comes after the latest
   register: no later one can matter. Registers agree with the probability Jaccard.
3. ``rows`` registers make a band. Prints that share a band are compared by all their
   registers, in tiles of a sorted partition (at most ``tile`` of a bucket on either
   side in memory; larger buckets are cut into tiles and every pair of tiles is met).
   Pairs whose estimate is at least ``near`` - over six standard deviations below 0.8 -
   are joined; of these only a spanning forest leaves the tile, never the pairs.
4. The components of the forests are clusters: every pair that step 2 and 3 can find is
   inside one. Only texts of clusters are read again, each goes to its cluster (cut into
   tiles if large), and the links inside are found exactly, from the words: texts of one
   link component so far need no comparison, any other is compared with all by an
   inverted index. Again a spanning forest of the links is returned.

No pairs of a group are emitted, no group must fit into a task, and nothing is capped.
At a similarity of 0.8 a link is missed with a probability of 1 - (1 - 0.8^5)^32 < 4e-6.

Defined results: documents without a word link only with equal texts (null texts with
null texts); repeated rows form one class; of a class the row with the smallest doc_id
(nulls last) is kept, one row of equal ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import only_for, prepare_python, written
from callweave.operators.graph import star_components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, NEAR, TILE = 32, 5, 0.55, 1_024
#: characters of a tile of texts, on average (a longer text is whole in its tile)
TILE_CHARS = 4_000_000
#: shingles that one round of numpy works on: few enough for a core's cache
GROUP = 1 << 17
_SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
#: what str.split() takes for white space, too
_OTHERS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_U, MASK = np.uint64, (1 << 64) - 1


def words_of(text: str | None) -> list[str]:
    """Words between ASCII white space."""
    if not text:
        return []
    return [w for w in text.translate(_SPACES).split(" ") if w] if _OTHERS.search(text) else text.split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(word_hashes: np.ndarray) -> np.ndarray:
    """Hash of every five-word window (fewer words: of all of them)."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    size = min(n, SHINGLE)
    h = np.full(n - size + 1, size, _U)
    for k in range(size):
        h = mixed(h * _U(0x9E3779B97F4A7C15) + word_hashes[k:n - size + 1 + k])
    return h


def probminhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """The element in each register of each document (n_docs x registers); ``doc`` is the row
    of each weighted element. All documents advance by one arrival an element a round."""
    earliest = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, _U)
    at, r = np.zeros(len(doc)), 0
    while len(doc):
        r += 1
        u = mixed(element + _U(r * 2 * 0x9E3779B97F4A7C15 & MASK))
        at = at - np.log((u >> _U(11)).astype(float) * 2.0 ** -53 + 2.0 ** -54) / weight
        place = doc * registers + (mixed(u + _U(1)) % _U(registers)).astype(np.int64)
        np.minimum.at(earliest, place, at)
        won = earliest[place] == at
        winner[place[won]] = element[won]
        latest = earliest.reshape(n_docs, registers).max(axis=1)
        going = at < latest[doc]
        doc, element, weight, at = doc[going], element[going], weight[going], at[going]
    return winner.reshape(n_docs, registers)


def print_of(text: Column) -> Column:
    """Digest of a text; a null text has its own."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), text.cast("string")), F.lit("null"))))


def sketches(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """(print, sig, bands) of texts (print, text) with a word; ``sig`` has 8 bits a register."""
    seen: dict[str, int] = {}

    def word_hash(w: str) -> int:
        if len(seen) >= 400_000:
            seen.clear()
        h = seen[w] = xxhash.xxh64_intdigest(w)
        return h

    def made(prints: list[bytes], found: list[np.ndarray]) -> pa.RecordBatch:
        n = len(prints)
        if not n:
            keys, sigs = [], []
        else:
            doc, element = np.repeat(np.arange(n), [len(f) for f in found]), np.concatenate(found)
            order = np.lexsort((element, doc))
            doc, element = doc[order], element[order]
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])])
            weight = np.diff(np.r_[first, len(doc)]).astype(float)
            winner = probminhash(doc[first], element[first], weight, n, bands * rows)
            h = np.broadcast_to(np.arange(bands, dtype=_U), (n, bands)).copy()
            by_band = winner.reshape(n, bands, rows)
            for k in range(rows):
                h = mixed(h * _U(0x9E3779B97F4A7C15) + by_band[:, :, k])
            sigs = [s.tobytes() for s in (mixed(winner) >> _U(56)).astype("u1")]
            keys = list(h.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["print", "sig", "bands"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_for("near-dedup")
        prints, found, size = [], [], 0
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1)):
                ws = words_of(x.as_py())
                if ws:
                    get = seen.get
                    prints.append(p)
                    found.append(shingle_hashes(np.array([get(w) or word_hash(w) for w in ws], _U)))
                    size += len(found[-1])
                if size >= GROUP:
                    yield made(prints, found)
                    prints, found, size = [], [], 0
        yield made(prints, found)
        seen.clear()

    return texts.mapInArrow(sketch, "print binary, sig binary, bands array<long>")


class Forest:
    """Union-find that remembers which unions joined two trees."""

    def __init__(self, n: int):
        self.top = list(range(n))

    def root(self, x: int) -> int:
        top = self.top
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.top[max(a, b)] = min(a, b)
        return True


def agreeing(sig: np.ndarray, bucket: np.ndarray, side: np.ndarray, near: float) -> tuple[list[int], list[int]]:
    """Spanning forest of the pairs of rows of one bucket (rows sorted by bucket; sides 0 and 1
    are compared with each other, side 2 among itself) whose registers agree often enough."""
    n, least = len(sig), near * sig.shape[1]
    forest, left, right = Forest(n), [], []
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[start, n])

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        ok = (side[i] == 2) | (side[i] != side[j])
        i, j = i[ok], j[ok]
        ok = (sig[i] == sig[j]).sum(axis=1) >= least
        for a, b in zip(i[ok].tolist(), j[ok].tolist()):
            if forest.join(a, b):
                left.append(a)
                right.append(b)

    small = size <= 32
    end = np.repeat(start + size, size) if n else start
    in_small = np.repeat(small, size)
    rows = np.flatnonzero(in_small)
    for d in range(1, 32):  # all small buckets at once, by distance within the bucket
        rows = rows[rows + d < end[rows]]
        if not len(rows):
            break
        meet(rows, rows + d)
    for s, k in zip(start[~small].tolist(), size[~small].tolist()):
        for a in range(k - 1):
            rest = np.arange(s + a + 1, s + k)
            meet(np.full(len(rest), s + a), rest)
    return left, right


def cluster_edges(sketched: DataFrame, near: float, tile: int) -> DataFrame:
    """(src, dst) prints: spanning forests of the pairs that share a band and agree enough."""
    rows = sketched.select("print", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    rows = written(rows.join(sizes, "band"), "band-rows")
    t = F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int")
    place = lambda o: F.struct(F.least(F.col("t"), o).alias("a"), F.greatest(F.col("t"), o).alias("b"), F.when(F.col("t") == o, 2).when(F.col("t") < o, 0).otherwise(1).alias("side"))
    rows = rows.withColumn("t", t).withColumn("g", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), place)))
    rows = rows.select("print", F.xxhash64("band", "g.a", "g.b").alias("band"), "g.side").join(sketched.select("print", "sig"), "print")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            prints = t.column("print").to_pylist()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "u1").reshape(len(prints), -1) if prints else np.zeros((0, 1), "u1")
            left, right = agreeing(sig, t.column("band").to_numpy(), t.column("side").to_numpy(), near)
            return pa.RecordBatch.from_arrays([pa.array([prints[i] for i in x], pa.binary()) for x in (left, right)], ["src", "dst"])

        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held)
            band = t.column("band").to_numpy()
            cut = int(np.searchsorted(band, band[-1])) if len(band) else 0  # the last bucket may go on
            if cut >= 2_000 or cut and len(band) >= 20_000:
                yield done(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    pairs = rows.repartition("band").sortWithinPartitions("band").select("band", "side", "print", "sig").mapInArrow(compare, "src binary, dst binary")
    return pairs.distinct()


def shingle_elements(texts: list[str | None]) -> tuple[list[np.ndarray], int]:
    """The shingles of each text as numbers that are the same for equal shingles (exactly, without a
    hash), and how many numbers there are. The k-th use of a shingle is an element of its own:
    minima and maxima of counts become intersections and unions. Words get numbers first; a
    window's number is made of the number of the window without its last word, and that word's."""
    number: dict[str, int] = {}
    rows = []
    for x in texts:
        ws = [number.setdefault(w, len(number) + 1) for w in words_of(x)]
        rows.append(np.array(ws + [0] * (SHINGLE - len(ws)) if ws else [], np.int64))  # 0: no word, so fewer words are another shingle
    n = np.array([max(0, len(r) - SHINGLE + 1) for r in rows], np.int64)
    if not n.sum():
        return [np.zeros(0, np.int64) for _ in texts], 0
    flat, begin = np.concatenate(rows), np.cumsum([0, *[len(r) for r in rows[:-1]]])
    doc = np.repeat(np.arange(len(rows)), n)
    at = begin[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    code = flat[at]
    for k in range(1, SHINGLE):
        code = np.unique(code * (len(number) + 1) + flat[at + k], return_inverse=True)[1]
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    first = np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])]
    use = np.arange(len(code)) - np.maximum.accumulate(np.where(first, np.arange(len(code)), 0))
    names, element = np.unique(code * (int(use.max()) + 1) + use, return_inverse=True)
    return np.split(element, np.cumsum(n)[:-1]), len(names)


def exact_links(texts: list[str], side: list[int], similarity: float) -> tuple[list[int], list[int]]:
    """Spanning forest of the links among texts (sides as in ``agreeing``), from their words."""
    sets, numbers = shingle_elements(texts)
    size = np.array([len(s) for s in sets])
    forest, left, right = Forest(len(texts)), [], []
    kind = np.array(side)

    def link(i: int, hit: np.ndarray) -> None:
        for j in hit.tolist():
            if j != i and (kind[i] == 2 or kind[i] != kind[j]) and forest.join(i, j):
                left.append(i)
                right.append(j)

    # one flat inverted index: the texts of element e are owner[at[e]:at[e + 1]]
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    owner, at = owner[order], np.r_[0, np.cumsum(np.bincount(flat, minlength=numbers))].astype(np.int64)

    def common(i: int) -> np.ndarray:
        s = sets[i]
        n = at[s + 1] - at[s]
        index = np.repeat(at[s] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.bincount(owner[index], minlength=len(sets))

    # the shortest texts first; a text is skipped when it and all it may link with are one tree
    for i in np.argsort(size, kind="stable").tolist():
        if size[i] == 0:
            continue
        fits = (size * similarity <= size[i] + 1e-9) & (size[i] * similarity <= size + 1e-9) & ((kind == 2) | (kind != kind[i]))
        mine = forest.root(i)
        if all(forest.root(j) == mine for j in np.flatnonzero(fits).tolist()):
            continue
        both = common(i)
        link(i, np.flatnonzero(fits & (both >= similarity * (size + size[i] - both) - 1e-9) & (both > 0)))
    return left, right


def text_links(members: DataFrame, similarity: float, tile: int) -> DataFrame:
    """(src, dst) prints: spanning forests of the exact links of (print, cluster, text)."""
    tiles = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum(F.length("text")) / TILE_CHARS)).cast("int").alias("tiles"))
    place = lambda o: F.struct(F.least(F.col("t"), o).alias("a"), F.greatest(F.col("t"), o).alias("b"), F.when(F.col("t") == o, 2).when(F.col("t") < o, 0).otherwise(1).alias("side"))
    rows = members.join(tiles, "cluster").withColumn("t", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("g", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), place))).select("print", "text", "cluster", "g.*")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        only_for("near-dedup")
        prints = group["print"].tolist()
        left, right = exact_links(group["text"].tolist(), group["side"].tolist(), similarity)
        return pd.DataFrame({"src": [prints[i] for i in left], "dst": [prints[i] for i in right]}, dtype=object)

    return rows.groupBy("cluster", "a", "b").applyInPandas(links, "src binary, dst binary")


def classes_of_texts(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                     near: float = NEAR, tile: int = TILE) -> DataFrame:
    """(print, class) of the texts that link with another text."""
    spark = docs.sparkSession
    prepare_python(spark)
    texts = docs.select(print_of(F.col(text_col)).alias("print"), F.col(text_col).cast("string").alias("text"))
    each = sketches(texts.where("text IS NOT NULL"), bands, rows).groupBy("print").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    sketched = written(each, "sketches")
    edges = written(cluster_edges(sketched, near, tile), "cluster-edges")
    ends = edges.select("src").union(edges.select("dst")).distinct().withColumnRenamed("src", "print")
    clusters = written(star_components(ends, edges, "print"), "clusters").withColumnRenamed("component_id", "cluster")
    # merged at every size: a broadcast of the members would not stay small
    members = written(texts.join(clusters.hint("merge"), "print").groupBy("print", "cluster").agg(F.first("text").alias("text")), "cluster-texts")
    links = written(text_links(members, similarity, tile).distinct(), "text-links")
    ends = links.select("src").union(links.select("dst")).distinct().withColumnRenamed("src", "print")
    return written(star_components(ends, links, "print"), "text-classes").withColumnRenamed("component_id", "class")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, print, class_id (the smallest id of the class), class_size and kept of every row."""
    found = classes_of_texts(docs, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), print_of(F.col(text_col)).alias("print"))
    # per text first (summed on the map side), then per class: a huge group of copies is one row
    texts = rows.groupBy("print").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    texts = texts.join(found, "print", "left").withColumn("class", F.coalesce("class", "print"))
    classes = texts.groupBy("class").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    texts = texts.join(classes, "class").select("print", "class", "class_id", "class_size")
    same = Window.partitionBy("class", "doc_id").orderBy("print")
    return (rows.join(texts, "print").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.row_number().over(same) == 1))
            .select("doc_id", "print", "class_id", "class_size", "kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept: one of each class, with its own columns."""
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias("_id"), F.col("print").alias("_kept"))
    d = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_mine"), print_of(F.col(text_col)).alias("_print"))  # no name can clash
    d = d.join(kept, F.col("_mine").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_kept")), "left_semi")
    same = Window.partitionBy("_mine", "_print").orderBy(F.lit(0))
    return d.withColumn("_row", F.row_number().over(same)).where("_row = 1").select("_doc.*")
