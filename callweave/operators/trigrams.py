"""K1, D3 and D7 for tables of queries: postings of letter groups instead of rows x queries.

Every distinct text is filed under each group of up to three letters that it holds (the empty
group included). A query of up to three letters is itself a group, so its postings are its
result; a longer one meets the postings of its rarest trigram only, and what it meets is
verified. A glob is met by the rarest group of its literal runs. Groups held by many texts are
dealt over ``SALTS`` tasks by a hash of the text.

Defined results: null texts and null queries match nothing; the empty query matches every text
that is not null; repeated queries count once (K1: once a ``query_id``); texts and queries may
be of any length; an empty table on either side gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.fixed import ERROR_QUERY_WORDS, SCORE_ERROR, SCORE_MODULE, SCORE_NAME

SALTS = 8


def _letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _next(groups: Column, letters: Column, n: int) -> Column:
    """Groups of ``n`` letters from those of ``n - 1``: each with the letter behind it."""
    longer = F.zip_with(groups, F.slice(letters, n, F.size(letters) + 1), lambda g, x: F.concat(g, x))
    return F.filter(longer, lambda g: g.isNotNull())


def _groups(text: Column) -> tuple[Column, Column, Column]:
    one = _letters(text)
    two = _next(one, one, 2)
    return one, two, _next(two, one, 3)


def text_index(texts: DataFrame, col: str) -> DataFrame:
    """(text, gram, salt): postings of the distinct texts of ``col``; a table to write and to append to."""
    t = texts.select(F.col(col).alias("text")).where("text IS NOT NULL").distinct()
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *_groups(F.col("text"))))
    return t.select("text", F.explode(grams).alias("gram"), F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int").alias("salt"))


def _met(index: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (with the groups ``grams`` that a text must hold) and each ``text`` filed under the rarest of them."""
    sizes = index.groupBy("gram").agg(F.count(F.lit(1)).alias("_held"))  # combined map-side
    each = asked.select("asked", F.explode("grams").alias("gram")).join(sizes, "gram", "left")
    order = F.struct(F.coalesce("_held", F.lit(0)), F.col("gram"))  # a group that no text holds ends the search
    rarest = each.groupBy("asked").agg(F.min_by("gram", order).alias("gram"))
    dealt = rarest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(index, ["gram", "salt"]).select("asked", "text")


def containing_pairs(index: DataFrame, asked: DataFrame, col: str = "asked") -> DataFrame:
    """(asked, text) of every distinct query and every text that contains it (case-sensitive)."""
    a = asked.select(F.col(col).alias("asked")).where("asked IS NOT NULL").distinct()
    grams = F.when(F.char_length("asked") <= 3, F.array("asked")).otherwise(F.array_distinct(_groups(F.col("asked"))[2]))
    return _met(index, a.select("asked", grams.alias("grams"))).where(F.contains("text", "asked"))


def glob_pairs(index: DataFrame, patterns: DataFrame, col: str = "asked") -> DataFrame:
    """(asked, text) of every distinct glob (``*`` any run, ``?`` one character) and every text that it fits."""
    a = patterns.select(F.col(col).alias("asked")).where("asked IS NOT NULL").distinct()
    runs = a.select("asked", F.explode(F.split("asked", "[*?]")).alias("run"))
    of_run = F.when(F.char_length("run") <= 3, F.array("run")).otherwise(_groups(F.col("run"))[2])
    grams = runs.select("asked", F.explode(of_run).alias("g")).groupBy("asked").agg(F.collect_set("g").alias("grams"))
    like = F.translate(F.regexp_replace("asked", r"([\\%_])", r"\\$1"), "*?", "%_")
    return _met(index, grams).where(F.like(F.col("text"), like))


def _rows(functions: DataFrame, pairs: DataFrame) -> DataFrame:
    return functions.join(pairs.withColumnRenamed("text", "_text"), F.col("name") == F.col("_text")).drop("_text")


def names_containing(functions: DataFrame, asked: DataFrame, col: str = "asked") -> DataFrame:
    """D3 for a table of queries: the function rows whose name contains each, with ``asked``."""
    return _rows(functions, containing_pairs(text_index(functions, "name"), asked, col))


def names_like(functions: DataFrame, patterns: DataFrame, col: str = "asked") -> DataFrame:
    """D7 for a table of globs: the function rows whose name fits each, with ``asked``."""
    return _rows(functions, glob_pairs(text_index(functions, "name"), patterns, col))


# -------------------------------------------------------------------- K1
def _first(rows: DataFrame, keys: list[str], limit: int, order_col: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order_col)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def most_relevant_for(lookup: DataFrame, queries: DataFrame, limit: int = 5, order_col: str = "seq") -> DataFrame:
    """K1 for a table ``queries(query_id, query)``: the rows that ``lookup.most_relevant`` gives, without rows x queries.

    Rows of one name, module and error flag score alike for every query, so only the first ``limit`` of them
    in ``order_col`` can be among a query's first ``limit``: an exact bound, planned with a limit before the
    shuffle. Likewise the first ``limit`` rows of a module (for each flag) stand for a module that a query
    names, and the first ``limit`` rows that handle errors for a query that only names an error.
    """
    flag = F.coalesce(F.col("has_error_handling"), F.lit(False))
    kinds = lookup.select("*", F.lower("function_name").alias("_name"), F.lower("module_name").alias("_module"), flag.alias("_error"))
    heads = _first(kinds, ["_name", "_module", "_error"], limit, order_col)
    of_modules = _first(heads, ["_module", "_error"], limit, order_col)
    failing = heads.where("_error").orderBy(order_col).limit(limit)  # a top-k of ``limit`` rows
    errs = reduce(lambda a, b: a | b, [F.instr("asked", w) > 0 for w in ERROR_QUERY_WORDS])
    q = queries.select("query_id", "query", F.lower("query").alias("asked")).where("asked IS NOT NULL").distinct()

    def hits(rows: DataFrame, col: str) -> DataFrame:
        return rows.join(containing_pairs(text_index(rows, col), q).withColumnRenamed("text", col), col).join(q, "asked")

    named, of_module = (F.coalesce(F.contains(c, "asked"), F.lit(False)) for c in ("_name", "_module"))
    alone = q.where(errs).withColumn("_error", F.lit(True)).join(F.broadcast(failing), "_error")
    met = reduce(DataFrame.unionByName, (hits(heads, "_name"), hits(of_modules, "_module").where(~named), alone.where(~named & ~of_module)))
    score = (F.when(named, SCORE_NAME).otherwise(0) + F.when(of_module, SCORE_MODULE).otherwise(0)
             + F.when(F.col("_error") & errs, SCORE_ERROR).otherwise(0))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(order_col))
    ranked = met.withColumn("score", score.cast("int")).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= limit).drop("_name", "_module", "_error", "asked")
