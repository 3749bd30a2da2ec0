"""Call-graph goldens (hand-computed from the reference's rules) and brute-force checks."""

import random

import pytest
from pyspark.sql import functions as F

from callweave.operators import graph as G


def _fns(spark, rows):
    return spark.createDataFrame(rows, "lookup_id string, name string, calls array<string>")


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def _nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "lookup_id string")


F1 = [("func-1", "main_function", ["helper_function", "validator"]),
      ("func-2", "helper_function", ["utility_function"]),
      ("func-3", "utility_function", []),
      ("func-4", "validator", [])]

AUTH_EDGES = [("auth-001", "auth-002"), ("auth-001", "auth-006"), ("auth-002", "auth-003"),
              ("auth-002", "auth-007"), ("auth-003", "auth-004"), ("auth-003", "auth-005"),
              ("auth-006", "auth-008"), ("auth-007", "auth-009")]
AUTH_IDS = [f"auth-00{i}" for i in range(1, 10)]


def test_four_function_graph(spark):
    fns = _fns(spark, F1)
    edges = G.resolve_calls(fns)
    assert sorted(map(tuple, edges.collect())) == [("func-1", "func-2"), ("func-1", "func-4"),
                                                   ("func-2", "func-3")]
    g = G.build_graph(fns.select("lookup_id"), edges)
    st = G.graph_statistics(g).first().asDict()
    assert (st["total_nodes"], st["total_edges"], st["root_nodes"], st["leaf_nodes"], st["max_depth"]) == \
        (4, 3, 1, 2, 2)
    assert st["avg_calls_per_function"] == 0.75
    roots = g.where("is_root").select("lookup_id")
    paths = G.call_paths(edges, roots, _nodes(spark, ["func-3"]), 3).collect()
    assert [r.path for r in paths] == [["func-1", "func-2", "func-3"]]


def test_empty_and_single(spark):
    empty = _fns(spark, [])
    g = G.build_graph(empty.select("lookup_id"), G.resolve_calls(empty))
    st = G.graph_statistics(g).first().asDict()
    assert st["total_nodes"] == 0 and st["total_edges"] == 0 and st["max_depth"] == 0
    one = _fns(spark, [("solo", "alone", ["print"])])
    g = G.build_graph(one.select("lookup_id"), G.resolve_calls(one)).first()
    assert g.is_root and g.is_leaf and g.node_type == "root" and g.depth_level == 0


def test_builtins_and_self_excluded(spark):
    fns = _fns(spark, [("a", "len", ["len"]), ("b", "f", ["len", "f", "g"]), ("c", "g", [])])
    assert sorted(map(tuple, G.resolve_calls(fns).collect())) == [("b", "c")]


def test_auth_graph(spark):
    edges = _edges(spark, AUTH_EDGES)
    g = G.build_graph(_nodes(spark, AUTH_IDS), edges)
    st = G.graph_statistics(g).first().asDict()
    assert (st["total_nodes"], st["total_edges"], st["root_nodes"], st["leaf_nodes"], st["max_depth"]) == \
        (9, 8, 1, 4, 3)
    depth = {r.lookup_id: r.depth_level for r in g.collect()}
    assert depth == {"auth-001": 0, "auth-002": 1, "auth-006": 1, "auth-003": 2, "auth-007": 2,
                     "auth-008": 2, "auth-004": 3, "auth-005": 3, "auth-009": 3}
    roots = g.where("is_root").select("lookup_id")
    targets = _nodes(spark, ["auth-004", "auth-005", "auth-009", "auth-008"])
    paths = sorted(r.path for r in G.call_paths(edges, roots, targets, 3).collect())
    assert paths == [["auth-001", "auth-002", "auth-003", "auth-004"],
                     ["auth-001", "auth-002", "auth-003", "auth-005"],
                     ["auth-001", "auth-002", "auth-007", "auth-009"],
                     ["auth-001", "auth-006", "auth-008"]]
    # a depth limit of 2 edges keeps only the short path
    short = G.call_paths(edges, roots, targets, 2).collect()
    assert [r.path for r in short] == [["auth-001", "auth-006", "auth-008"]]
    # the context includes the target itself (count 3, not 2)
    ctx = G.reachable(edges, _nodes(spark, ["auth-003"]), 3)
    assert sorted((r.node, r.hops) for r in ctx.collect()) == [("auth-003", 0), ("auth-004", 1),
                                                                ("auth-005", 1)]
    attrs = spark.createDataFrame(
        [(i, f"n{i}", f"f{i[-1]}.py", "m" + str(int(i[-1]) % 2), i in ("auth-005",), False) for i in AUTH_IDS],
        "lookup_id string, name string, file_name string, module_name string, "
        "has_error_handling boolean, is_async boolean")
    s = G.context_summary(ctx, attrs).first()
    assert s.dependency_count == 3 and s.dependency_count_excl_self == 2 and s.max_hops == 1
    assert s.files_involved == ["f3.py", "f4.py", "f5.py"] and s.has_error_handling
    # change impact: everything that reaches auth-009
    imp = G.reachable(edges, _nodes(spark, ["auth-009"]), 3, reverse=True)
    assert sorted((r.node, r.hops) for r in imp.collect()) == [("auth-001", 3), ("auth-002", 2),
                                                                ("auth-007", 1), ("auth-009", 0)]
    crit = {r.lookup_id: r.criticality_rank for r in G.critical_functions(g, edges, 3).collect()}
    assert crit["auth-001"] == max(crit.values())


def test_target_that_is_root(spark):
    edges = _edges(spark, AUTH_EDGES)
    roots = _nodes(spark, ["auth-001"])
    assert [r.path for r in G.call_paths(edges, roots, roots, 3).collect()] == [["auth-001"]]


def test_depth_capped_on_cycle(spark):
    edges = _edges(spark, [("r", "a"), ("a", "b"), ("b", "a"), ("r", "c")])
    g = G.build_graph(_nodes(spark, ["r", "a", "b", "c"]), edges)
    rows = {r.lookup_id: (r.depth_level, r.depth_capped) for r in g.collect()}
    assert rows["c"] == (1, False) and rows["r"] == (0, False)
    assert rows["a"] == (1, True) and rows["b"] == (0, True)


def test_depth_has_no_limit(spark):
    """A chain longer than any round limit, entered half way too, and a cycle behind it."""
    n = 60
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(n)] + [("c000", f"c{n // 2:03}"), ("top", f"c{n - 1:03}")]
    ids = sorted({x for p in pairs for x in p})
    rows = {r.lookup_id: (r.depth_level, r.depth_capped) for r in G.build_graph(_nodes(spark, ids), _edges(spark, pairs)).collect()}
    assert rows == {**{f"c{i:03}": (i, False) for i in range(n + 1)}, "top": (0, False)}


def test_cycle_behind_a_dag(spark):
    """Nodes on and behind a cycle are flagged; a cycle no root reaches holds nobody back."""
    pairs = [("r", "a"), ("a", "b"), ("r", "b"), ("b", "x"), ("x", "y"), ("y", "x"), ("y", "z"), ("p", "q"), ("q", "p"), ("q", "b")]
    ids = sorted({x for p in pairs for x in p})
    rows = {r.lookup_id: (r.depth_level, r.depth_capped) for r in G.build_graph(_nodes(spark, ids), _edges(spark, pairs)).collect()}
    assert rows == {"r": (0, False), "a": (1, False), "b": (2, False), "x": (3, True), "y": (0, True), "z": (0, True), "p": (0, False), "q": (0, False)}


def test_rounds_move_no_edges(spark):
    """The kept layout of the edges is used as it is: only the frontier is exchanged."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        e = G._Expander(_edges(spark, AUTH_EDGES), "src")
        joined = e.join(_nodes(spark, AUTH_IDS).withColumnRenamed("lookup_id", "node"), "node")
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert plan.count("Exchange hashpartitioning") == 1
        e.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _uf_components(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_against_union_find(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(60)]
    pairs = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(45)]
    got = {r.lookup_id: r.component_id
           for r in G.connected_components(_nodes(spark, ids), _edges(spark, pairs)).collect()}
    assert got == _uf_components(ids, pairs)


def _brute_core(pairs):
    e = set(pairs)
    while True:
        srcs, dsts = {a for a, _ in e}, {b for _, b in e}
        nxt = {(a, b) for a, b in e if a in dsts and a in srcs and b in srcs and b in dsts}
        if nxt == e:
            return sorted(srcs)
        e = nxt


def test_cyclic_core_and_mutual_pairs(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "a"), ("e", "f"),
             ("f", "e"), ("g", "h")]
    edges = _edges(spark, pairs)
    core = sorted(r.lookup_id for r in G.cyclic_core(edges).collect())
    assert core == _brute_core(pairs) == ["a", "b", "c", "d", "e", "f"]
    assert sorted(map(tuple, G.mutual_pairs(edges).collect())) == [("e", "f")]


def test_known_endpoints(spark):
    edges = _edges(spark, [("a", "b"), ("a", "zz"), ("yy", "b")])
    kept = G.keep_known_endpoints(edges, _nodes(spark, ["a", "b"]))
    assert sorted(map(tuple, kept.collect())) == [("a", "b")]


def test_degree_invariant(spark):
    edges = _edges(spark, AUTH_EDGES)
    g = G.degrees(_nodes(spark, AUTH_IDS), edges)
    row = g.agg(F.sum("out_degree").alias("o"), F.sum("in_degree").alias("i")).first()
    assert row.o == row.i == len(AUTH_EDGES)


def test_external_calls_and_leaf_pruning(spark):
    fns = _fns(spark, F1 + [("func-5", "orphan", ["requests_get", "len", "validator"])])
    ext = sorted(map(tuple, G.external_calls(fns).collect()))
    assert ext == [("func-5", "requests_get")]
    edges = G.resolve_calls(fns)
    g = G.degrees(fns.select("lookup_id"), edges)
    kept = sorted(map(tuple, G.prune_leaves(edges, g).collect()))
    assert kept == [("func-1", "func-2")]


def test_context_functions_order(spark):
    edges = _edges(spark, AUTH_EDGES)
    ctx = G.reachable(edges, _nodes(spark, ["auth-002"]), 2)
    attrs = spark.createDataFrame([(i, f"n{i}") for i in AUTH_IDS], "lookup_id string, name string")
    rows = G.context_functions(ctx, attrs).orderBy("position").collect()
    assert rows[0].node == "auth-002" and rows[0].position == 0
    assert [r.node for r in rows] == ["auth-002", "auth-003", "auth-007", "auth-004", "auth-005", "auth-009"]


def test_salts_change_nothing(spark, monkeypatch):
    """A hub key dealt over another number of salts: results are unchanged."""
    hub = [("h", f"x{i}") for i in range(30)] + [(f"x{i}", f"y{i % 7}") for i in range(30)]
    edges = _edges(spark, hub + AUTH_EDGES + [("auth-009", "h")])
    targets = _nodes(spark, AUTH_IDS + ["h"])
    roots = _nodes(spark, ["auth-001"])
    base_ctx = sorted(map(tuple, G.reachable(edges, targets, 3).collect()))
    base_paths = sorted(tuple(r.path) for r in G.call_paths(edges, roots, targets, 3).collect())
    monkeypatch.setattr(G, "SALTS", 3)
    assert sorted(map(tuple, G.reachable(edges, targets, 3).collect())) == base_ctx
    assert sorted(tuple(r.path) for r in G.call_paths(edges, roots, targets, 3).collect()) == base_paths
    g = G.build_graph(_nodes(spark, AUTH_IDS), _edges(spark, AUTH_EDGES))
    assert {r.lookup_id: r.depth_level for r in g.collect()}["auth-009"] == 3


def test_fn_calls_hot_orders_same_pairs(spark, monkeypatch):
    """Pairing lines of huge orders by position gives the same calls as the window."""
    from callweave.plans import standins as S
    from tests.conftest import SF001
    base = sorted(map(tuple, S.fn_calls(spark, SF001).collect()))
    monkeypatch.setattr(S, "HOT_ORDER_LINES", 2)
    assert sorted(map(tuple, S.fn_calls(spark, SF001).collect())) == base


def _py_reach(adj, t, d):
    dist, frontier = {t: 0}, [t]
    for h in range(1, d + 1):
        nxt = []
        for u in frontier:
            for v in adj.get(u, ()):
                if v not in dist:
                    dist[v] = h
                    nxt.append(v)
        frontier = nxt
    return dist


def _py_paths(adj, roots, t, d):
    out = []

    def walk(u, path):
        if len(path) - 1 > d:
            return
        if u == t:
            out.append(list(path))
            return
        for v in adj.get(u, ()):
            if v not in path:
                walk(v, path + [v])
    for r in roots:
        walk(r, [r])
    return out


def _py_depth(adj, roots, ids):
    depth = {}

    def rec(u, k):
        if k > depth.get(u, -1):
            depth[u] = k
            for v in adj.get(u, ()):
                rec(v, k + 1)
    for r in roots:
        rec(r, 0)
    return {i: depth.get(i, 0) for i in ids}


@pytest.mark.parametrize("seed", [11, 12])
def test_random_dag_against_python(spark, seed):
    rnd = random.Random(seed)
    ids = [f"v{i:02d}" for i in range(25)]
    pairs = sorted({(ids[a], ids[b]) for a, b in ((rnd.randrange(25), rnd.randrange(25)) for _ in range(45)) if a < b})
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, []).append(b)
    edges, nodes = _edges(spark, pairs), _nodes(spark, ids)
    g = G.build_graph(nodes, edges)
    has_in = {b for _, b in pairs}
    roots = [i for i in ids if i not in has_in]
    assert {r.lookup_id: r.depth_level for r in g.collect()} == _py_depth(adj, roots, ids)
    ctx = G.reachable(edges, nodes, 3).collect()
    got = {}
    for r in ctx:
        got.setdefault(r.target, {})[r.node] = r.hops
    assert got == {t: _py_reach(adj, t, 3) for t in ids}
    paths = sorted(tuple(r.path) for r in G.call_paths(edges, _nodes(spark, roots), nodes, 3).collect())
    want = sorted(tuple(p) for t in ids for p in _py_paths(adj, roots, t, 3))
    assert paths == want
    for p in paths:  # properties: endpoints, no repeats, bounded length
        assert p[0] in roots and len(set(p)) == len(p) and len(p) <= 4


def test_heavy_keys_are_salted(spark, monkeypatch):
    hub = [("h", f"x{i}") for i in range(30)] + [(f"x{i}", f"y{i % 7}") for i in range(30)]
    edges, targets = _edges(spark, hub), _nodes(spark, ["h", "x3"])
    base = sorted(map(tuple, G.reachable(edges, targets, 2).collect()))
    monkeypatch.setattr(G, "HOT", 5)
    e = G._Expander(edges, "src")
    assert [r[0] for r in e.hot.collect()] == ["h"] and e.laid.where("src = 'h'").select("_salt").distinct().count() > 1
    assert e.laid.where("src <> 'h'").agg({"_salt": "max"}).first()[0] == 0
    e.close()
    assert sorted(map(tuple, G.reachable(edges, targets, 2).collect())) == base


def test_known_ends_move_no_edges(spark, monkeypatch):
    """Edges whose ends are all nodes are not joined to the nodes; few or many ends without one go, nulls too."""
    edges = _edges(spark, [("a", "b"), ("a", "zz"), ("yy", "b"), (None, "b"), ("a", None), ("b", "a"), ("b", "a")])
    nodes = _nodes(spark, ["a", "b"])
    for few in (G.FEW, 1):
        monkeypatch.setattr(G, "FEW", few)
        assert sorted(map(tuple, G.keep_known_endpoints(edges, nodes).collect())) == [("a", "b"), ("b", "a"), ("b", "a")]
    known = G.keep_known_endpoints(_edges(spark, [("a", "b"), ("b", "a")]), nodes)
    assert "Join" not in known._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_sort_no_edges(spark):
    """The kept edges are sorted as they are laid: a round sorts its frontier only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        e = G._Expander(_edges(spark, AUTH_EDGES), "src")
        joined = e.join(_nodes(spark, AUTH_IDS).withColumnRenamed("lookup_id", "node"), "node")
        assert joined.count() == len(AUTH_EDGES)
        assert joined._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0].count("Sort [") == 1
        e.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges_that_come_twice(spark):
    """An edge that comes twice counts twice as a degree and changes neither depths nor path counts."""
    pairs = [("r", "a"), ("r", "a"), ("a", "b"), ("r", "b"), ("b", "c"), ("c", "b"), ("c", "b"), ("b", "d"), ("r", "r2"), ("r2", "d")]
    ids = sorted({x for p in pairs for x in p})
    nodes, twice, once = _nodes(spark, ids), _edges(spark, pairs), _edges(spark, sorted(set(pairs)))
    rows = {r.lookup_id: r for r in G.build_graph(nodes, twice).collect()}
    assert rows["r"].out_degree == 4 and rows["a"].in_degree == 2
    assert {i: (r.depth_level, r.depth_capped) for i, r in rows.items()} == {r.lookup_id: (r.depth_level, r.depth_capped) for r in G.build_graph(nodes, once).collect()}
    counted = lambda e: sorted(map(tuple, G.call_path_counts(e, _nodes(spark, ["r", "b"]), nodes, 3).collect()))
    listed = G.call_paths(once, _nodes(spark, ["r", "b"]), nodes, 3).groupBy("target").count()
    assert counted(twice) == counted(once) == sorted(map(tuple, listed.collect()))
