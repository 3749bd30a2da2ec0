"""D8 for tables of names: an edit-distance join by an index instead of one scan a name.

Two names within ``d`` edits share a key. Short names are filed under every string that
deleting up to ``d`` letters gives. Longer ones are cut into ``d + 1`` pieces, of which ``d``
edits leave one whole, moved by at most ``d`` places: a stored name is filed under its
pieces, an asked one looks for them at every length and place they may have. A pair differs
by at most ``d`` letters in length, so names around the border are filed both ways.
Keys are 64-bit hashes of distinct lower-cased names; each pair that meets is verified by
``levenshtein``, so a collision costs a comparison and never a result.

Defined results: null names match nothing; case does not count; equal names are at distance
0; the empty name matches names of up to ``d`` letters; names may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT = 12  # letters of the longest name that is only filed by deletions


def _deletions(name: Column, times: int) -> Column:
    """Hashes of the strings that deleting up to ``times`` letters gives, the name itself included."""
    def less(x: Column) -> Column:
        at = F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
    level, every = F.array(name), [F.array(name)]
    for _ in range(times):
        level = F.array_distinct(F.flatten(F.transform(level, less)))
        every.append(level)
    return F.transform(F.array_distinct(F.concat(*every)), lambda x: F.xxhash64(F.lit("deletion"), x))


def _piece(name: Column, length: Column, i: Column, pieces: int, shift: Column) -> Column:
    start = F.floor(i * length / pieces).cast("int")
    size = F.floor((i + 1) * length / pieces).cast("int") - start
    return F.xxhash64(F.lit("piece"), length, i, F.substr(name, F.greatest(start + shift, F.lit(0)) + 1, size))


def _keys(name: Column, d: int, asked: bool) -> Column:
    number = lambda a, b: F.sequence(F.lit(a), F.lit(b))
    none = F.array().cast("array<bigint>")
    if asked:
        lengths = F.filter(F.sequence(F.length(name) - d, F.length(name) + d), lambda x: x > SHORT)
        pieces = F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(number(0, d), lambda i: F.transform(
            number(-d, d), lambda s: _piece(name, n, i, d + 1, s))))))
    else:
        pieces = F.transform(number(0, d), lambda i: _piece(name, F.length(name), i, d + 1, F.lit(0)))
    return F.array_distinct(F.concat(F.when(F.length(name) <= SHORT + d, _deletions(name, d)).otherwise(none),
                                     F.when(F.length(name) > SHORT, pieces).otherwise(none)))


def _distinct(names: DataFrame, col: str) -> DataFrame:
    return names.select(F.lower(F.col(col)).alias("name")).where("name IS NOT NULL").distinct()


def name_index(names: DataFrame, col: str = "name", max_distance: int = 2) -> DataFrame:
    """(name, key): the postings of the distinct lower-cased names; a table to write and to append to."""
    return _distinct(names, col).select("name", F.explode(_keys(F.col("name"), max_distance, False)).alias("key"))


def fuzzy_pairs(index: DataFrame, asked: DataFrame, col: str = "name", max_distance: int = 2) -> DataFrame:
    """(asked, name, distance) of every pair of lower-cased names within ``max_distance``."""
    a = _distinct(asked, col).select(F.col("name").alias("asked"), F.explode(_keys(F.col("name"), max_distance, True)).alias("key"))
    near = a.join(index, "key").where(F.abs(F.length("asked") - F.length("name")) <= max_distance)
    met = near.withColumn("distance", F.levenshtein("asked", "name", max_distance)).where(F.col("distance") >= 0)
    return met.select("asked", "name", "distance").distinct()  # verified first, so only results are shuffled


def fuzzy_functions(functions: DataFrame, asked: DataFrame, col: str = "name", max_distance: int = 2) -> DataFrame:
    """The function rows near each asked name, with ``asked`` and ``distance``."""
    pairs = fuzzy_pairs(name_index(functions, "name", max_distance), asked, col, max_distance).withColumnRenamed("name", "_near")
    return functions.join(pairs, F.lower(F.col("name")) == F.col("_near")).drop("_near")
