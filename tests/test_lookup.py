"""Lookup-table goldens (demo lookup file, hand-computed) and filter semantics."""

import pytest
from pyspark.sql import functions as F

from callweave.operators import lookup as L
from callweave.sources import sinks as SK

SCHEMA = ("name string, lookup_id string, nested_call_ids array<string>, file_path string, "
          "repository_name string, module_name string, start_line int, end_line int, is_async boolean, "
          "class_context string, calls array<string>, decorators array<string>, "
          "error_handling struct<has_try_catch:boolean,error_types:array<string>>, seq long, code string")

ROWS = [
    ("authenticate_user", "func-auth-001", ["func-jwt-002", "func-db-003"], "src/auth/authentication.py",
     "webapp-backend", "src.auth.authentication", 15, 45, False, "AuthService", ["validate_token", "get_user"],
     ["@require_auth", "@rate_limit"], (True, ["TokenExpiredError", "InvalidTokenError", "UserNotFoundError"]),
     0, "def authenticate_user(): pass"),
    ("validate_token", "func-jwt-002", [], "src/auth/jwt_utils.py", "webapp-backend", "src.auth.jwt_utils",
     8, 25, False, None, ["decode"], [], (True, ["jwt.InvalidTokenError", "jwt.ExpiredSignatureError"]), 1,
     "def validate_token(): pass"),
    ("process_bulk_insert", "func-db-003", ["func-db-004"], "src/database/operations.py", "webapp-backend",
     "src.database.operations", 67, 120, True, "DatabaseManager", ["create_connection"],
     ["@async_timeout(300)", "@retry(max_attempts=3)"],
     (True, ["DatabaseConnectionError", "TransactionError", "TimeoutError"]), 2, ""),
    ("create_connection", "func-db-004", [], "src/database/connection.py", "webapp-backend",
     "src.database.connection", 12, 30, True, None, [], ["@connection_timeout(30)"], (False, []), 3,
     "def create_connection(): pass"),
]


@pytest.fixture(scope="module")
def fns(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_summary_golden(fns):
    s = L.table_summary(L.lookup_table(fns)).first().asDict()
    # the demo header says 3 modules; its four records name four
    assert s == {"total_functions": 4, "async_functions": 2, "functions_with_error_handling": 3,
                 "unique_modules": 4, "unique_repositories": 1}


def test_summary_empty(spark, fns):
    s = L.table_summary(L.lookup_table(fns.limit(0))).first().asDict()
    assert s == {"total_functions": 0, "async_functions": 0, "functions_with_error_handling": 0,
                 "unique_modules": 0, "unique_repositories": 0}


def test_lookup_projection(fns):
    row = L.lookup_table(fns).where(F.col("lookup_id") == "func-jwt-002").first()
    assert row.nested_call_ids == "" and row.class_context == "" and row.file_name == "jwt_utils.py"
    assert row.calls_count == 1 and row.has_error_handling
    first = L.lookup_table(fns).where(F.col("lookup_id") == "func-auth-001").first()
    assert first.nested_call_ids == "func-jwt-002,func-db-003"


def test_relevance(fns):
    lk = L.lookup_table(fns).join(fns.select("lookup_id", "seq"), "lookup_id")
    r = L.most_relevant(lk, ["auth", "error", "nothing-matches"], 5).orderBy("query_id", "rank").collect()
    got = [(x.query_id, x.lookup_id, x.score) for x in r]
    assert got == [(0, "func-auth-001", 15), (0, "func-jwt-002", 5),
                   (1, "func-auth-001", 3), (1, "func-jwt-002", 3), (1, "func-db-003", 3)]
    top1 = L.most_relevant(lk, ["error"], 1).collect()
    assert [x.lookup_id for x in top1] == ["func-auth-001"]


def test_point_lookups(spark, fns):
    assert [r.lookup_id for r in L.by_ids(fns, ["func-db-004", "missing"]).collect()] == ["func-db-004"]
    ids = spark.createDataFrame([("func-jwt-002",), ("nope",)], "lookup_id string")
    assert [r.lookup_id for r in L.by_ids(fns, ids).collect()] == ["func-jwt-002"]
    assert L.by_name(fns, "validate_token").count() == 1
    assert L.name_contains(fns, "connection").count() == 1
    assert sorted(r.name for r in L.by_glob(fns, "*_user").collect()) == ["authenticate_user"]
    assert sorted(r.name for r in L.by_glob(fns, "create_?onnection").collect()) == ["create_connection"]
    fz = L.fuzzy_name(fns, "validate_tokn", 2).collect()
    assert [(r.name, r.distance) for r in fz] == [("validate_token", 1)]


def test_filter_search(fns):
    r = L.search_by_filters(fns, {"is_async": 1, "start_line": 20}).collect()
    assert [x.lookup_id for x in r] == ["func-db-003"]  # start_line >= 20
    r = L.search_by_filters(fns, {"end_line": 30, "repository_name": "webapp-backend"}).collect()
    assert [x.lookup_id for x in r] == ["func-auth-001", "func-db-003", "func-db-004"]
    assert L.search_by_filters(fns, {"bogus": 1}).count() == 0
    assert L.search_by_filters(fns, {"func_name": "validate_token"}).first().search_method == "filter_search"
    assert L.search_by_filters(fns, {"is_async": True}, limit=1).count() == 1
    assert L.clamp(50, 1, 20) == 20 and L.clamp(0, 1, 20) == 1


def test_usage_and_composition(fns):
    u = {r.value: r.uses for r in L.usage_counts(fns, "decorators").collect()}
    assert u["@require_auth"] == 1 and len(u) == 5
    c = {(r.facet, r.value): r.functions for r in L.composition(L.lookup_table(fns)).collect()}
    assert c == {("execution", "async"): 2, ("execution", "sync"): 2,
                 ("error_handling", "with_error_handling"): 3, ("error_handling", "without_error_handling"): 1}


def test_exports(spark, fns, tmp_path):
    SK.export_lookup(fns, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 4 and "nested_call_ids" in back.columns
    SK.export_lookup(fns, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json/functions")).count() == 4
    head = spark.read.json(str(tmp_path / "json/header")).first()
    assert head.export_info.total_functions == 4 and head.summary.async_functions == 2
    with pytest.raises(ValueError):
        SK.export_lookup(fns, str(tmp_path / "x"), "xml")


def test_bulk_store_and_report(spark, fns, tmp_path):
    from callweave.operators.pipeline import processing_report
    withv = fns.withColumn("embedding", F.when(F.col("seq") < 3, F.array_repeat(F.lit(0.5).cast("float"), 4)))
    counts = SK.bulk_store(withv, 4, str(tmp_path / "store")).first()
    # seq 3 has no vector: skipped, not failed; a row without code is valid
    assert (counts.success, counts.failed, counts.skipped) == (3, 0, 1)
    rep = processing_report(SK.bulk_store(withv, 4)).first()
    assert rep.total_functions == 4 and rep.success_rate == 75.0 and rep.low_success


def test_bulk_store_rules(spark, tmp_path):
    rows = [("a", "f", "code", [1.0, 2.0]), (None, "f", "code", [1.0, 2.0]), ("b", None, "code", [1.0, 2.0]), ("c", "", "code", [1.0, 2.0]),
            ("d", "g", None, [1.0, 2.0]), ("e", "g", "", [1.0]), ("f", "g", "x", None)]
    df = spark.createDataFrame(rows, "lookup_id string, name string, code string, embedding array<float>")
    counts = SK.bulk_store(df, 2, str(tmp_path / "s")).first()
    assert (counts.success, counts.skipped) == (2, 5)
    assert [tuple(e) for e in counts.errors] == [("no lookup_id", 1), ("no name", 2), ("vector of another size", 2)]
    assert sorted(r.lookup_id for r in spark.read.parquet(str(tmp_path / "s")).collect()) == ["a", "d"]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "lookup_id string, seq int, v string")
    new = spark.createDataFrame([("a", 2, "x2"), ("c", 2, "z")], "lookup_id string, seq int, v string")
    got = sorted((r.lookup_id, r.v) for r in SK.upsert(old, new).collect())
    assert got == [("a", "x2"), ("b", "y"), ("c", "z")]


def test_compressed_exports_read_back_the_same(spark, tmp_path):
    f = spark.createDataFrame([("a", "x", ["b", "c"]), ("b", "y", [])], "lookup_id string, name string, nested_call_ids array<string>").selectExpr(
        "*", "'p/q.py' AS file_path", "'r' AS repository_name", "'m' AS module_name", "1 AS start_line", "2 AS end_line", "true AS is_async", "'c' AS class_context",
        "array('x') AS calls", "array('d') AS decorators", "named_struct('has_try_catch', true, 'error_types', array('E')) AS error_handling")
    for fmt, folder in (("csv", ""), ("json", "/functions")):
        SK.export_lookup(f, str(tmp_path / fmt), fmt)
        SK.export_lookup(f, str(tmp_path / f"{fmt}.gz"), fmt, "gzip")
        read = lambda at: sorted(map(str, getattr(spark.read.option("header", True), fmt)(str(tmp_path / at) + folder).collect()))  # noqa: B023,E731
        assert read(fmt) == read(f"{fmt}.gz") and list((tmp_path / f"{fmt}.gz{folder}").glob("*.gz"))
