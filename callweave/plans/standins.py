"""Stand-in inputs derived by Spark from the driver tables.

The driver tables hold no source code, so the graph, lookup and history
operators run on tables derived from them; each builder below has an exact
DuckDB twin (the ``*_SQL`` strings) used by the oracle queries.

* ``dag_edges`` / ``dag_nodes``: region -> nation -> {customer, supplier};
  customer -> order; order -> part and supplier -> part through lineitem.
* ``fn``: one function record per part; ``fn`` calls the name of the part on the
  next line of the same order (``fn_calls``), giving a cyclic, name-resolved graph.
* ``vectors`` / ``vector_queries``: the embeddings and one query per label
  (the label's mean vector).
* ``history``: one analysis record per event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.fixed import APPROACH_GRAPH, APPROACH_LOOKUP
from callweave.session import materialized
from callweave.sources.tables import table


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


# --------------------------------------------------------------------------- DAG
def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, ("dag_edges", sf_dir), lambda: _dag_edges(spark, sf_dir))


def _dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    supplier = table(spark, sf_dir, "supplier")
    orders = table(spark, sf_dir, "orders")
    lineitem = table(spark, sf_dir, "lineitem")
    parts = [
        nation.select(_id("R", "n_regionkey").alias("src"), _id("N", "n_nationkey").alias("dst")),
        customer.select(_id("N", "c_nationkey").alias("src"), _id("C", "c_custkey").alias("dst")),
        supplier.select(_id("N", "s_nationkey").alias("src"), _id("S", "s_suppkey").alias("dst")),
        orders.select(_id("C", "o_custkey").alias("src"), _id("O", "o_orderkey").alias("dst")),
        lineitem.select(_id("O", "l_orderkey").alias("src"), _id("P", "l_partkey").alias("dst")),
        lineitem.select(_id("S", "l_suppkey").alias("src"), _id("P", "l_partkey").alias("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _node_rows(df: DataFrame, prefix: str, key: str, name, kind: str) -> DataFrame:
    k = F.col(key)
    return df.select(
        _id(prefix, key).alias("lookup_id"),
        name.cast("string").alias("name"),
        F.lit(kind).alias("module_name"),
        F.concat(F.lit(kind + "_"), (k % 4).cast("string"), F.lit(".py")).alias("file_name"),
        (k % 2 == 1).alias("is_async"),
        (k % 3 == 0).alias("has_error_handling"),
    )


def dag_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, ("dag_nodes", sf_dir), lambda: _dag_nodes(spark, sf_dir))


def _dag_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        _node_rows(t("region"), "R", "r_regionkey", F.col("r_name"), "region"),
        _node_rows(t("nation"), "N", "n_nationkey", F.col("n_name"), "nation"),
        _node_rows(t("customer"), "C", "c_custkey", F.col("c_name"), "customer"),
        _node_rows(t("supplier"), "S", "s_suppkey", F.col("s_name"), "supplier"),
        _node_rows(t("orders"), "O", "o_orderkey",
                   F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "orders"),
        _node_rows(t("part"), "P", "p_partkey", F.col("p_name"), "part"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


DAG_EDGES_SQL = """
SELECT DISTINCT src, dst FROM (
  SELECT 'R' || CAST(n_regionkey AS VARCHAR) AS src, 'N' || CAST(n_nationkey AS VARCHAR) AS dst FROM nation
  UNION ALL SELECT 'N' || CAST(c_nationkey AS VARCHAR), 'C' || CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'N' || CAST(s_nationkey AS VARCHAR), 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'C' || CAST(o_custkey AS VARCHAR), 'O' || CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'O' || CAST(l_orderkey AS VARCHAR), 'P' || CAST(l_partkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'S' || CAST(l_suppkey AS VARCHAR), 'P' || CAST(l_partkey AS VARCHAR) FROM lineitem
)"""


def _node_sql(tbl: str, prefix: str, key: str, name: str, kind: str) -> str:
    return (f"SELECT '{prefix}' || CAST({key} AS VARCHAR) AS lookup_id, CAST({name} AS VARCHAR) AS name, "
            f"'{kind}' AS module_name, '{kind}_' || CAST({key} % 4 AS VARCHAR) || '.py' AS file_name, "
            f"({key} % 2 = 1) AS is_async, ({key} % 3 = 0) AS has_error_handling FROM {tbl}")


DAG_NODES_SQL = "\n  UNION ALL ".join([
    _node_sql("region", "R", "r_regionkey", "r_name", "region"),
    _node_sql("nation", "N", "n_nationkey", "n_name", "nation"),
    _node_sql("customer", "C", "c_custkey", "c_name", "customer"),
    _node_sql("supplier", "S", "s_suppkey", "s_name", "supplier"),
    _node_sql("orders", "O", "o_orderkey", "'order ' || CAST(o_orderkey AS VARCHAR)", "orders"),
    _node_sql("part", "P", "p_partkey", "p_name", "part"),
])


# ------------------------------------------------------------- function records
def _fn_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    has_err = size % 3 == 0
    file_name = F.concat(F.lit("f"), (key % 50).cast("string"), F.lit(".py"))
    return p.select(
        F.concat(F.col("p_name"), F.lit("/"), F.col("p_brand")).alias("name"),
        _id("P", "p_partkey").alias("lookup_id"),
        F.concat(F.lit("src/"), F.lower(F.col("p_type")), F.lit("/"), file_name).alias("file_path"),
        file_name.alias("file_name"),
        F.concat(F.lit("repo"), (key % 5).cast("string")).alias("repository_name"),
        F.col("p_type").alias("module_name"),
        size.cast("int").alias("start_line"),
        (size + key % 40).cast("int").alias("end_line"),
        (size % 2 == 1).alias("is_async"),
        F.when(size % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("class_context"),
        F.when(size % 5 == 0, F.array(F.lit("cached")))
         .when(size % 5 == 1, F.array(F.lit("staticmethod"), F.lit("traced")))
         .otherwise(F.array().cast("array<string>")).alias("decorators"),
        F.struct(
            has_err.alias("has_try_catch"),
            F.when(has_err & (size % 2 == 0), F.array(F.lit("ValueError")))
             .when(has_err, F.array(F.lit("KeyError"), F.lit("TypeError")))
             .otherwise(F.array().cast("array<string>")).alias("error_types"),
        ).alias("error_handling"),
        F.concat(F.lit("def part_"), key.cast("string"), F.lit("(size="), size.cast("string"),
                 F.lit('):\n    """'), F.col("p_name"), F.lit(" by "), F.col("p_brand"),
                 F.lit('"""\n    return size * '), (key % 7).cast("string")).alias("code"),
        key.alias("seq"),
    )


HOT_ORDER_LINES = 100_000  # an order with more lines than this is paired by position


def fn_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller_id, callee_name), each once: a part calls the name of the part on the next line of its order."""
    return _call_rows(spark, sf_dir).distinct()


def _call_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fn_calls``, a row for each pair of lines: the readers make them distinct.

    Lines that agree in number and part name the same part, so further columns of the order of the
    lines (supplier, price) change no pair; they are not shuffled or sorted by.

    Ordinary orders pair lines with ``lead`` over a window per order. Orders with
    more than ``HOT_ORDER_LINES`` lines (counted first; at most lines / bound of
    them) are paired through a distributed sort and an equi join on position + 1,
    so no single task holds a huge order.
    """
    from callweave.operators.ranking import global_row_number
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    order = ["l_linenumber", "l_partkey"]
    sizes = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_n"))  # combined map-side
    hot = sizes.where(F.col("_n") > HOT_ORDER_LINES).select("l_orderkey")
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= 1_000_000 else hot  # broadcast only under a counted bound
    cold = li.join(hot, "l_orderkey", "left_anti") if n_hot else li
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    pairs = (cold.select(F.col("l_partkey").alias("caller"), F.lead("l_partkey").over(w).alias("callee"))
             .where(F.col("callee").isNotNull()))
    if n_hot:
        big = li.join(hot, "l_orderkey", "left_semi")
        pos = global_row_number(big, [F.col("l_orderkey")] + [F.col(c) for c in order], "pos")
        nxt = pos.select("l_orderkey", (F.col("pos") - 1).alias("pos"), F.col("l_partkey").alias("callee"))
        pairs = pairs.unionByName(pos.join(nxt, ["l_orderkey", "pos"])
                                  .select(F.col("l_partkey").alias("caller"), "callee"))
    names = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("callee"),
        F.concat(F.col("p_name"), F.lit("/"), F.col("p_brand")).alias("callee_name"))
    return (pairs.join(names, "callee")
               .select(_id("P", "caller").alias("lookup_id"), "callee_name"))


def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function records with ``calls`` = sorted distinct called names."""
    return materialized(spark, ("fn", sf_dir), lambda: fn_unwritten(spark, sf_dir))


def fn_unwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fn`` as a plan, for a query that reads it once: what none of its columns needs is not made."""
    calls = (_call_rows(spark, sf_dir).groupBy("lookup_id")
             .agg(F.array_sort(F.collect_set("callee_name")).alias("calls")))
    from callweave.functions.text import numbered_code
    return (_fn_base(spark, sf_dir).join(calls, "lookup_id", "left")
            .withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))
            .withColumn("code_with_line_numbers", numbered_code("code", "start_line")))


FN_SQL = """
SELECT p_name || '/' || p_brand AS name, 'P' || CAST(p_partkey AS VARCHAR) AS lookup_id,
       'src/' || lower(p_type) || '/f' || CAST(p_partkey % 50 AS VARCHAR) || '.py' AS file_path,
       'f' || CAST(p_partkey % 50 AS VARCHAR) || '.py' AS file_name,
       'repo' || CAST(p_partkey % 5 AS VARCHAR) AS repository_name, p_type AS module_name,
       CAST(p_size AS INTEGER) AS start_line, CAST(p_size + p_partkey % 40 AS INTEGER) AS end_line,
       (p_size % 2 = 1) AS is_async,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS class_context,
       CASE WHEN p_size % 5 = 0 THEN ['cached'] WHEN p_size % 5 = 1 THEN ['staticmethod', 'traced']
            ELSE CAST([] AS VARCHAR[]) END AS decorators,
       (p_size % 3 = 0) AS has_error_handling,
       CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN ['ValueError']
            WHEN p_size % 3 = 0 THEN ['KeyError', 'TypeError'] ELSE CAST([] AS VARCHAR[]) END AS error_types,
       'def part_' || CAST(p_partkey AS VARCHAR) || '(size=' || CAST(p_size AS VARCHAR) || '):' || chr(10)
         || '    ' || repeat(chr(34), 3) || p_name || ' by ' || p_brand || repeat(chr(34), 3) || chr(10)
         || '    return size * '
         || CAST(p_partkey % 7 AS VARCHAR) AS code,
       p_partkey AS seq
FROM part"""

FN_CALLS_SQL = """
SELECT DISTINCT 'P' || CAST(n.caller AS VARCHAR) AS lookup_id, p.p_name || '/' || p.p_brand AS callee_name
FROM (SELECT DISTINCT l_partkey AS caller, next_part AS callee FROM (
        SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey
               ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS next_part
        FROM lineitem) WHERE next_part IS NOT NULL) n
JOIN part p ON p.p_partkey = n.callee"""

# name resolution J1 in SQL: calls joined to functions by name, self excluded
FN_EDGES_SQL = f"""
SELECT DISTINCT c.lookup_id AS src, f.lookup_id AS dst
FROM ({FN_CALLS_SQL}) c JOIN ({FN_SQL}) f ON f.name = c.callee_name
WHERE c.lookup_id <> f.lookup_id"""


# ----------------------------------------------------------------------- vectors
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding"), F.col("label"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the element-wise mean of the label's vectors."""
    e = table(spark, sf_dir, "embeddings")
    exploded = e.select("label", F.posexplode("embedding").alias("i", "x"))
    means = exploded.groupBy("label", "i").agg(F.avg("x").alias("m"))
    return (means.groupBy("label")
            .agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s"))
            .select(F.col("label").alias("query_id"),
                    F.transform("s", lambda s: s["m"]).alias("embedding")))


VECTOR_QUERIES_SQL = """
SELECT label AS query_id, list(m ORDER BY i) AS embedding FROM (
  SELECT label, i, avg(x) AS m FROM (
    SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings)
  GROUP BY label, i) GROUP BY label"""


# ----------------------------------------------------------------------- history
def history_from_events(ev: DataFrame) -> DataFrame:
    """Map event rows (batch or stream) to analysis records."""
    eid = F.col("event_id")
    return ev.select(
        eid.alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("why does "), F.col("event_type"), F.lit(" fail for user "),
                 F.col("user_id").cast("string")).alias("query"),
        ((eid * 37) % 101 / 100.0).alias("confidence_score"),
        (F.col("user_id") % 7).cast("int").alias("functions_analyzed"),
        F.struct(F.col("event_type").alias("embedding"),
                 F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("llm"))
         .alias("services_used"),
        F.when(eid % 2 == 0, F.lit(APPROACH_LOOKUP)).otherwise(F.lit(APPROACH_GRAPH)).alias("approach"),
        F.col("value").alias("processing_seconds"),
        F.col("user_id"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_from_events(table(spark, sf_dir, "events"))


HISTORY_SQL = f"""
SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS "timestamp",
       'why does ' || event_type || ' fail for user ' || CAST(user_id AS VARCHAR) AS query,
       ((event_id * 37) % 101) / 100.0 AS confidence_score,
       CAST(user_id % 7 AS INTEGER) AS functions_analyzed,
       event_type AS embedding, 'm' || CAST(user_id % 3 AS VARCHAR) AS llm,
       CASE WHEN event_id % 2 = 0 THEN '{APPROACH_LOOKUP}' ELSE '{APPROACH_GRAPH}' END AS approach,
       value AS processing_seconds, user_id
FROM events"""
