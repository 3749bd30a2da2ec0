"""Registered queries over extracted source code.

The driver tables hold no source code, so Spark assembles one Python file per row of
``part``: nested and async functions, a class, a function after the class, dotted, called
and plain decorators, plain and tuple handlers, built-in and unknown calls, imports with
and without a module; files in excluded folders, test files and files that do not parse.
The oracle states the expected rows of such a file by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import text as TX
from callweave.operators import extract as X
from callweave.operators import graph as G
from callweave.plans.catalog import register
from callweave.session import materialized, spread
from callweave.sources import corpus as C
from callweave.sources.tables import table

#: one file: K is the part's key, N the next key
SOURCE = '''import os.path
from lib import tool, other as o

def step_K(x):
    return step_N(x) + len([x])

class Unit_K(Base):
    """Doc."""
    @wrap.deco(2)
    @plain
    async def run_K(self, y):
        def inner_K():
            return self.go()
        try:
            await step_K(y)
        except ValueError:
            raise
        except (KeyError, a.Odd):
            pass

def late_K():
    print(Unit_K().run_K(1))
'''
BROKEN = "def broken_K(:\n    pass\n"

# expected rows of SOURCE: name, lines, async, last class met, class around, calls, decorators,
# handled types, try, signature
EXPECTED_SQL = """(VALUES
  ('step_K', 4, 5, false, NULL, NULL, 'len,step_N', '', '', false, 'def step_K(x):'),
  ('late_K', 21, 22, false, 'Unit_K', NULL, 'Unit_K,print,run_K', '', '', false, 'def late_K():'),
  ('run_K', 11, 19, true, 'Unit_K', 'Unit_K', 'deco,go,step_K', 'deco,plain', 'ValueError', true, 'async def run_K(self, y):'),
  ('inner_K', 12, 13, false, 'Unit_K', 'Unit_K', 'go', '', '', false, 'def inner_K():')
) AS t(name, start_line, end_line, is_async, class_context, enclosing_class, calls, decorators, error_types, has_try_catch, signature)"""

FILES_SQL = """
files AS (SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(p_partkey + 1 AS VARCHAR) AS n, p_size % 13 = 0 AS broken,
  CASE WHEN p_size % 7 = 0 THEN 'pkg/tests/mod_' WHEN p_size % 11 = 0 THEN 'pkg/test_mod_'
       WHEN p_size % 5 = 0 THEN 'test/mod_' ELSE 'pkg/sub/mod_' END || p_partkey || '.py' AS path, p_size
  FROM part),
scanned AS (SELECT * FROM files WHERE p_size % 7 <> 0 AND p_size % 11 <> 0 AND p_size % 5 <> 0),
fns AS (SELECT k, path, replace(replace(path, '/', '.'), '.py', '') AS module_name, start_line, end_line, is_async, has_try_catch,
  """ + ",\n  ".join(f"replace(replace({c}, 'K', k), 'N', n) AS {c}" for c in
                       ("name", "class_context", "enclosing_class", "calls", "signature")) + """,
  decorators, error_types FROM scanned, """ + EXPECTED_SQL + """ WHERE NOT broken)"""
# keys stand after an underscore: other letters K and N stay
FILES_SQL = FILES_SQL.replace("'K', k)", "'_K', '_' || k)").replace("'N', n)", "'_N', '_' || n)")


def source_corpus(spark, sf_dir: str) -> DataFrame:
    """(repo, path, content) of a file for each part."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    key = lambda c: F.concat(F.lit("_"), c.cast("string"))
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("_K"), key(F.col("p_partkey"))), F.lit("_N"), key(F.col("p_partkey") + 1))
    place = (F.when(F.col("p_size") % 7 == 0, "pkg/tests/mod_").when(F.col("p_size") % 11 == 0, "pkg/test_mod_")
             .when(F.col("p_size") % 5 == 0, "test/mod_").otherwise("pkg/sub/mod_"))
    content = F.when(F.col("p_size") % 13 == 0, filled(BROKEN)).otherwise(filled(SOURCE))
    df = p.select(F.lit("parts").alias("repo"), F.concat(place, F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), content.alias("content"))
    return C.exclude_patterns(C.scan_filter(C.corpus_table(df, "/corpus")), anchored=True)


def extracted(spark, sf_dir: str) -> DataFrame:
    return X.functions_from(X.extract(source_corpus(spark, sf_dir)))


def extracted_calls(spark, sf_dir: str) -> DataFrame:
    """What the call graph reads of the functions: the files are parsed once, however often it is joined."""
    return materialized(spark, ("corpus_calls", sf_dir), lambda: extracted(spark, sf_dir).select("lookup_id", "name", "calls"))


def joined(c: str) -> Column:
    return F.array_join(c, ",")


@register("corpus_functions", f"""WITH {FILES_SQL}
SELECT name, sha256('parts:' || path || ':' || start_line || ':' || name) AS lookup_id, '/corpus/' || path AS file_path, module_name,
       start_line, end_line, is_async, class_context, enclosing_class, calls, 'os.path,lib.tool,lib.other' AS imports, decorators,
       error_types, has_try_catch, CAST(CASE WHEN has_try_catch THEN 1 ELSE 0 END AS INTEGER) AS try_blocks, signature,
       CAST(end_line - start_line + 1 AS INTEGER) AS code_lines, false AS is_test
FROM fns""")
def q_corpus_functions(spark, sf_dir):
    return extracted(spark, sf_dir).select(
        "name", "lookup_id", "file_path", "module_name", "start_line", "end_line", "is_async", "class_context", "enclosing_class",
        joined("calls").alias("calls"), joined("imports").alias("imports"), joined("decorators").alias("decorators"),
        joined("error_handling.error_types").alias("error_types"), F.col("error_handling.has_try_catch").alias("has_try_catch"),
        F.size("error_handling.try_catch_blocks").alias("try_blocks"), TX.signature("code").alias("signature"),
        F.size(F.split("code_with_line_numbers", "\n")).alias("code_lines"), TX.is_test_file("file_path").alias("is_test"))


@register("corpus_errors", f"""WITH {FILES_SQL}
SELECT 'parts' AS repo, path, 'SyntaxError' AS error FROM scanned WHERE broken""")
def q_corpus_errors(spark, sf_dir):
    return X.parse_errors(X.extract(source_corpus(spark, sf_dir))).select("repo", "path", F.substring_index("parse_error", ":", 1).alias("error"))


CALLS_SQL = "calls AS (SELECT name, unnest(string_split(calls, ',')) AS call FROM fns)"


@register("corpus_edges", f"""WITH {FILES_SQL}, {CALLS_SQL}
SELECT c.name AS caller, f.name AS callee FROM calls c JOIN fns f ON c.call = f.name WHERE c.name <> f.name""")
def q_corpus_edges(spark, sf_dir):
    f = extracted_calls(spark, sf_dir)
    names = f.select("lookup_id", "name")
    return (G.resolve_calls(f).join(names.select(F.col("lookup_id").alias("src"), F.col("name").alias("caller")), "src")
            .join(names.select(F.col("lookup_id").alias("dst"), F.col("name").alias("callee")), "dst").select("caller", "callee"))


@register("corpus_external_calls", f"""WITH {FILES_SQL}, {CALLS_SQL}
SELECT name, call FROM calls WHERE call NOT IN (SELECT name FROM fns) AND call NOT IN ('len', 'print')""")
def q_corpus_external_calls(spark, sf_dir):
    f = extracted_calls(spark, sf_dir)
    return G.external_calls(f).join(f.select("lookup_id", "name"), "lookup_id").select("name", "call")
