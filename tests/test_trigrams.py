"""Queries by letter groups against every row and every query."""

import fnmatch
import random
import re

from pyspark.sql import functions as F

from callweave.operators import lookup as L
from callweave.operators import trigrams as TG

NAMES = ["load_file", "Load_File", "load", "lo", "l", "", "a%b_c", "a\\b", "x" * 5000 + "_end", "naïve_😀_join", "naïve_😀_join", "tab\nline", "50%", "load_files"]


def fns(spark, names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "lookup_id int, name string")


def texts(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "asked string")


def test_names_containing(spark):
    r = random.Random(3)
    names = NAMES + ["".join(r.choice("abc") for _ in range(r.randrange(9))) for _ in range(60)] + [None]
    asked = ["", "l", "lo", "oad", "load_f", "x_en", "xx", "😀_j", "%", "_", "\\", "\n", "none such", "x" * 4999, None, "lo"]
    asked += ["".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(30)]
    got = TG.names_containing(fns(spark, names), texts(spark, asked)).select("asked", "lookup_id").collect()
    want = {(a, i) for a in asked for i, n in enumerate(names) if a is not None and n is not None and a in n}
    assert len(got) == len(want) and {tuple(g) for g in got} == want
    assert TG.names_containing(fns(spark, names).limit(0), texts(spark, asked)).count() == 0
    assert TG.names_containing(fns(spark, names), texts(spark, [])).count() == 0


def test_names_like(spark):
    globs = ["", "*", "?", "??", "load*", "*file", "lo?d*", "*_😀_*", "a%b_c", "a%*", "a\\b", "*\\*", "*\n*", "l*d_f*s", "50%", "5?%", "*" + "x" * 40 + "*end", None, "load*"]
    got = TG.names_like(fns(spark, NAMES + [None]), texts(spark, globs)).select("asked", "lookup_id").collect()
    fits = lambda g, n: re.fullmatch("".join({"*": "(?s:.*)", "?": "(?s:.)"}.get(c, re.escape(c)) for c in g), n)
    want = {(g, i) for g in globs for i, n in enumerate(NAMES) if g is not None and fits(g, n)}
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert fnmatch.fnmatchcase("load_file", "lo?d*")  # the plain meaning of the two signs


def test_relevance_equals_rows_by_queries(spark):
    """Many rows of one name, of one module and with errors: the bounds must not lose a place."""
    r = random.Random(9)
    rows = [(f"id{i}", r.choice(["get", "Get_item", "set_bug", "error_log", "q", None, ""]), r.choice(["core", "Core.error", "ui", None, "get.core"]),
             r.choice([True, False, None]), i) for i in range(300)]
    lookup = spark.createDataFrame(rows, "lookup_id string, function_name string, module_name string, has_error_handling boolean, seq int")
    asked = ["get", "CORE", "error", "bug", "core error", "e", "", "nothing", "get issue", "ui", "item", "exception", "Get"]
    table = spark.createDataFrame([*enumerate(asked), (99, None)], "query_id int, query string")
    for k in (1, 3, 40):
        pick = lambda df: sorted((x.query_id, x["rank"], x.lookup_id, x.score) for x in df.collect())
        assert pick(TG.most_relevant_for(lookup, table, k)) == pick(L.most_relevant(lookup, asked, k))
    assert TG.most_relevant_for(lookup.limit(0), table).count() == 0 and TG.most_relevant_for(lookup, table.limit(0)).count() == 0


def test_common_groups_are_dealt(spark):
    index = TG.text_index(fns(spark, [f"get_{i}" for i in range(400)]), "name")
    salts = index.where("gram = 'get'").groupBy("salt").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(salts) == TG.SALTS and max(s.n for s in salts) < 100


def test_relevance_table_makes_no_lists(spark, monkeypatch):
    """No column of the answer needs the lists of calls or of nested ids, so neither is made or stored."""
    from callweave.plans import catalog, index_queries
    from callweave.plans import standins as S
    from tests.conftest import SF001

    def stored(*_):
        raise AssertionError("a table is stored")
    for module in (S, catalog, index_queries):
        monkeypatch.setattr(module, "materialized", stored)
    df = index_queries.q_relevance_table(spark, SF001)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan and "lead(" not in plan
    assert df.count() > 0
