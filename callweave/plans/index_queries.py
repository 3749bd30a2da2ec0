"""Registered queries over indexes: names by edit distance (D8) and by letter groups (D3, D7, K1), vectors by cells (K4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import factorised as FC
from callweave.operators import fuzzy as Z
from callweave.operators import lookup as L
from callweave.operators import trigrams as TG
from callweave.operators import vector as V
from callweave.operators import vector_index as I
from callweave.plans import standins as S
from callweave.plans.catalog import FN_CTES, FN_LOOKUP_SQL, VEC_TOPK_SQL, register
from callweave.session import materialized, scratch_path

# every function is asked by its name without the third letter, whole and up to the slash
NAMES_SQL = f"""fn AS ({S.FN_SQL}),
names AS (SELECT DISTINCT lower(name) AS name FROM fn UNION SELECT DISTINCT lower(split_part(name, '/', 1)) FROM fn),
asked AS (SELECT DISTINCT left(name, 2) || substr(name, 4) AS asked FROM names)"""


@register("fuzzy_name_pairs", f"""WITH {NAMES_SQL}
SELECT asked, name, CAST(levenshtein(asked, name) AS INTEGER) AS distance FROM asked, names WHERE levenshtein(asked, name) <= 2""")
def q_fuzzy_name_pairs(spark, sf_dir):
    """D8 for a table of misspelled names, against all names."""
    f = S.fn(spark, sf_dir).select("name")
    names = f.unionByName(f.select(F.split_part("name", F.lit("/"), F.lit(1)).alias("name")))
    asked = names.select(F.concat(F.substr("name", F.lit(1), F.lit(2)), F.substr("name", F.lit(4))).alias("name"))
    return Z.fuzzy_pairs(Z.name_index(names), asked)


def stored_index(spark, sf_dir) -> str:
    """The folder of an index built over two thirds of the vectors, the rest inserted, some of it twice."""
    def build():
        root = scratch_path(spark, "vector-index")
        v = S.vectors(spark, sf_dir)
        I.build_index(v.where("id % 3 <> 0"), root, 64)
        I.insert(v.where("id % 3 = 0"), root)
        I.insert(v.where("id % 2 = 0"), root)  # held already
        return spark.createDataFrame([(root,)], "root string")
    return materialized(spark, ("vector_index", sf_dir), build).first()["root"]


@register("vector_index_topk", f"WITH {VEC_TOPK_SQL} SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def q_vector_index_topk(spark, sf_dir):
    """K4 made exact: cells by their distance first, then those that may hold a better vector."""
    r = I.search(stored_index(spark, sf_dir), S.vector_queries(spark, sf_dir), 5)
    return r.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int"))


@register("vector_index_recall")
def q_vector_index_recall(spark, sf_dir):
    """K4: recall by query of the probed cells alone, against K2; the number of probes is tuned on every second label."""
    root, q = stored_index(spark, sf_dir), S.vector_queries(spark, sf_dir)
    probes = I.probes_for(root, q.where("query_id % 2 = 0"), 5, recall=0.98)
    return V.recall(I.search(root, q, 5, probes, exact=False), V.vector_topk(S.vectors(spark, sf_dir), q, 5))


# pieces of every function's name: two letters, a run over the first words, what follows the slash, and one that no name holds
PIECES = ["substr(name, 1, 2)", "substr(name, 3, 6)", "split_part(name, '/', 2)", "split_part(name, '/', 1)", "substr(name, 2, 5) || '~'"]
GLOBS = ["substr(name, 1, 3) || '*' || substr(name, length(name) - 1, 2)", "'*' || substr(name, 4, 5) || '?' || substr(name, 10, 2) || '*'", "'?' || substr(name, 2, 1) || '*'"]
SUMMARY = "count(*) AS functions, min(lookup_id) AS first_id, max(lookup_id) AS last_id"


def _asked_sql(pieces: list[str]) -> str:
    return " UNION ".join(f"SELECT {p} AS asked FROM fn" for p in pieces)


def _asked(f, pieces: list[str]):
    return f.select(F.explode(F.array(*map(F.expr, pieces))).alias("asked"))


def _summary(rows):
    return rows.groupBy("asked").agg(F.count(F.lit(1)).alias("functions"), F.min("lookup_id").alias("first_id"), F.max("lookup_id").alias("last_id"))


@register("names_containing", f"""WITH fn AS ({S.FN_SQL}), asked AS ({_asked_sql(PIECES)})
SELECT asked, {SUMMARY} FROM asked JOIN fn ON contains(name, asked) GROUP BY 1""")
def q_names_containing(spark, sf_dir):
    """D3 for a table of pieces of names."""
    f = S.fn(spark, sf_dir).select("lookup_id", "name")
    return _summary(TG.names_containing(f, _asked(f, PIECES)))


@register("names_like", f"""WITH fn AS ({S.FN_SQL}), asked AS ({_asked_sql(GLOBS)})
SELECT asked, {SUMMARY} FROM asked JOIN fn ON name LIKE translate(asked, '*?', '%_') GROUP BY 1""")
def q_names_like(spark, sf_dir):
    """D7 for a table of globs."""
    f = S.fn(spark, sf_dir).select("lookup_id", "name")
    return _summary(TG.names_like(f, _asked(f, GLOBS)))


# words of names, modules, and both with a word that names an error
WORDS = ["split_part(name, ' ', 1)", "module_name", "split_part(name, '/', 2) || ' error'", "substr(module_name, 2, 4)", "upper(substr(name, 3, 2))", "'some bug'"]


@register("relevance_table", f"""WITH {FN_CTES}, {FN_LOOKUP_SQL},
q AS ({" UNION ".join(f"SELECT {p} AS query FROM fn" for p in WORDS)}),
s AS (
  SELECT q.query, f.lookup_id, f.seq,
         CAST((CASE WHEN contains(lower(f.function_name), lower(q.query)) THEN 10 ELSE 0 END)
            + (CASE WHEN contains(lower(f.module_name), lower(q.query)) THEN 5 ELSE 0 END)
            + (CASE WHEN f.has_error_handling AND regexp_matches(lower(q.query), 'error|exception|bug|issue') THEN 3 ELSE 0 END) AS INTEGER) AS score
  FROM q, fn_lookup f)
SELECT query, lookup_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, seq) AS INTEGER) AS rank
  FROM s WHERE score > 0) WHERE rank <= 5""")
def q_relevance_table(spark, sf_dir):
    """K1 for a table of queries."""
    fns = S.fn_unwritten(spark, sf_dir)
    asked = _asked(fns, WORDS).distinct().select(F.col("asked").alias("query_id"), F.col("asked").alias("query"))
    # the lookup table as a plan: the lists of calls and of nested ids, which no column here needs, are not made
    lookup = L.lookup_table(FC.nested_call_ids(fns, FC.factorise(fns)), keep=("seq",))
    return TG.most_relevant_for(lookup, asked, 5).select("query", "lookup_id", "score", "rank")
