"""Function lookup table: projection, summaries, point lookups, filters, metadata scoring.

All pure Catalyst plans: filters reach the parquet scan, projections prune it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.fixed import (
    ERROR_QUERY_WORDS, MAX_FUNCTIONS_PER_SEARCH, SCORE_ERROR, SCORE_MODULE, SCORE_NAME,
)
from callweave.functions.text import file_name as _file_name


def _has_error_handling():
    return F.coalesce(F.col("error_handling.has_try_catch"), F.lit(False))


# ------------------------------------------------------------------- S9
def lookup_table(functions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 12-column lookup projection (id lists joined with ','), and the columns to ``keep``."""
    nested = F.col("nested_call_ids") if "nested_call_ids" in functions.columns \
        else F.array().cast("array<string>")
    return functions.select(
        F.col("name").alias("function_name"), "lookup_id",
        F.array_join(nested, ",").alias("nested_call_ids"),
        _file_name("file_path").alias("file_name"),
        "repository_name", "module_name", "start_line", "end_line", "is_async",
        F.coalesce("class_context", F.lit("")).alias("class_context"),
        F.size("calls").alias("calls_count"),
        _has_error_handling().alias("has_error_handling"), *keep,
    )


# ------------------------------------------------------------ R1, R8, R12
def table_summary(lookup: DataFrame, approx: bool = False) -> DataFrame:
    """Totals; zeros on an empty table (Q22). ``approx`` uses HyperLogLog++."""
    distinct = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.countDistinct(c))
    return lookup.agg(
        F.count(F.lit(1)).alias("total_functions"),
        F.count_if(F.col("is_async")).alias("async_functions"),
        F.count_if(F.col("has_error_handling")).alias("functions_with_error_handling"),
        distinct("module_name").alias("unique_modules"),
        distinct("repository_name").alias("unique_repositories"),
    )


def composition(lookup: DataFrame) -> DataFrame:
    """Long-form counts of async/sync and with/without error handling."""
    return (lookup.select(
                F.when(F.col("is_async"), "async").otherwise("sync").alias("kind"),
                F.when(F.col("has_error_handling"), "with_error_handling")
                 .otherwise("without_error_handling").alias("errors"))
            .select(F.expr("stack(2, 'execution', kind, 'error_handling', errors) AS (facet, value)"))
            .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("functions")))


def usage_counts(functions: DataFrame, array_col: str) -> DataFrame:
    """Distinct values of an array column (decorators, error types) with use counts."""
    return (functions.select(F.explode(array_col).alias("value"))
            .groupBy("value").agg(F.count(F.lit(1)).alias("uses")))


# ------------------------------------------------------- D1 - D4, D7, D8
def by_ids(functions: DataFrame, ids) -> DataFrame:
    """Rows for the given ids (a list -> IN filter pushed to the scan; a DataFrame of
    ``lookup_id`` -> semi join, which AQE broadcasts when that side is small)."""
    if isinstance(ids, DataFrame):
        return functions.join(ids.select("lookup_id").distinct(), "lookup_id", "left_semi")
    return functions.where(F.col("lookup_id").isin(list(ids)))


def by_name(functions: DataFrame, name: str) -> DataFrame:
    """Exact name; may return many rows."""
    return functions.where(F.col("name") == name)


def name_contains(functions: DataFrame, part: str) -> DataFrame:
    """D3: partial, case-sensitive name match."""
    return functions.where(F.col("name").contains(part))


def glob_to_like(pattern: str) -> str:
    out = []
    for ch in pattern:
        if ch in "%_\\":
            out.append("\\" + ch)
        elif ch == "*":
            out.append("%")
        elif ch == "?":
            out.append("_")
        else:
            out.append(ch)
    return "".join(out)


def by_glob(functions: DataFrame, pattern: str) -> DataFrame:
    """Glob name search (``*`` any run, ``?`` one character)."""
    return functions.where(F.col("name").like(glob_to_like(pattern)))


def fuzzy_name(functions: DataFrame, name: str, max_distance: int = 2) -> DataFrame:
    """Case-insensitive Levenshtein distance <= ``max_distance``; the length
    difference bound is checked first so most rows never run the distance."""
    n = F.lower(F.col("name"))
    target = name.lower()
    near = F.abs(F.length(n) - len(target)) <= max_distance
    d = F.levenshtein(n, F.lit(target), max_distance)
    return (functions.where(near).withColumn("distance", d)
            .where((F.col("distance") >= 0) & (F.col("distance") <= max_distance)))


FILTER_EXACT = ["func_name", "repository_name", "module_name", "class_context"]


def clamp(value: int, low: int, high: int) -> int:
    """K5: limit / depth clamping."""
    return min(max(low, value), high)


def search_by_filters(functions: DataFrame, filters: dict, limit: int = 10,
                      with_file_path: bool = True) -> DataFrame | None:
    """Conjunctive filter search; ``start_line`` / ``end_line`` mean ``>=`` (Q15).

    Unknown keys are dropped; when none is left the result is empty (Q14). The
    size is capped from above only; rows are taken in ``lookup_id`` order.
    """
    conds = []
    for key, value in filters.items():
        if key in FILTER_EXACT:
            col = "name" if key == "func_name" else key
            conds.append(F.col(col) == F.lit(value))
        elif key == "is_async":
            conds.append(F.col("is_async") == F.lit(bool(value)))
        elif key in ("start_line", "end_line"):
            conds.append(F.col(key) >= F.lit(value))
        elif key == "file_path" and with_file_path:
            conds.append(F.col("file_path") == F.lit(value))
    if not conds:
        return functions.limit(0)
    hit = functions.where(reduce(lambda a, b: a & b, conds))
    return (hit.orderBy("lookup_id").limit(min(limit, MAX_FUNCTIONS_PER_SEARCH))
            .withColumn("relevance_score", F.lit(1.0))
            .withColumn("search_method", F.lit("filter_search"))
            .withColumn("match_type", F.lit("exact")))


# -------------------------------------------------------------------- K1
def relevance_scores(lookup: DataFrame, queries: list[str]) -> DataFrame:
    """K1 scores of every row for every query, generated row by row (no join):
    +10 query in name, +5 in module, +3 error handling when the query names an error word."""
    qs = F.array(*[F.lit(q) for q in queries])
    x = lookup.select("*", F.posexplode(qs).alias("query_id", "query"))
    ql = F.lower(F.col("query"))
    err_words = reduce(lambda a, b: a | b, [F.instr(ql, w) > 0 for w in ERROR_QUERY_WORDS])
    score = (F.when(F.instr(F.lower(F.col("function_name")), ql) > 0, SCORE_NAME).otherwise(0)
             + F.when(F.instr(F.lower(F.col("module_name")), ql) > 0, SCORE_MODULE).otherwise(0)
             + F.when(F.col("has_error_handling") & err_words, SCORE_ERROR).otherwise(0))
    return x.withColumn("score", score.cast("int"))


def most_relevant(lookup: DataFrame, queries: list[str], limit: int = 5,
                  order_col: str = "seq") -> DataFrame:
    """K1: top ``limit`` rows with score > 0 per query, ties kept in input order.

    ``row_number() <= limit`` per query is planned with a per-partition group
    limit, so only ``limit`` rows per query and partition are shuffled.
    """
    s = relevance_scores(lookup, queries).where(F.col("score") > 0)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(order_col))
    return (s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit))
