"""Factorised edges, strong components and deep graphs against brute force."""

import random

import pytest

from callweave.operators import cycles as C
from callweave.operators import factorised as FC
from callweave.operators import graph as G


@pytest.fixture(autouse=True)
def small_shuffles(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def functions(spark, n, names, calls, seed):
    rng = random.Random(seed)
    pool = [f"n{i}" for i in range(names)]
    rows = []
    for i in range(n):
        name = "hot" if rng.random() < 0.3 else rng.choice(pool)
        rows.append((f"f{i:03d}", name, [rng.choice([*pool, "hot", "len", "nowhere", name]) for _ in range(rng.randrange(calls))]))
    return spark.createDataFrame(rows, "lookup_id string, name string, calls array<string>").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1])
def test_two_hops_give_what_the_edges_give(spark, seed):
    f = functions(spark, 60, 40, 3, seed)
    two, edges = FC.factorise(f), G.resolve_calls(f)
    nodes = f.select("lookup_id")
    assert rows(FC.edges_of(two)) == rows(edges)
    assert rows(FC.degrees(nodes, two)) == rows(G.degrees(nodes, edges))
    assert rows(FC.connected_components(nodes, two)) == rows(G.connected_components(nodes, edges))
    some = nodes.where("lookup_id < 'f008'")
    for back in (False, True):
        assert rows(FC.reachable(two, some, 3, back).select("target", "node", "hops")) == rows(G.reachable(edges, some, 3, back).select("target", "node", "hops"))
    assert rows(FC.nested_call_ids(f, two).select("lookup_id", "nested_call_ids")) == rows(G.nested_call_ids(f, edges).select("lookup_id", "nested_call_ids"))
    members = nodes.select("lookup_id")
    assert rows(FC.strong_components(two)) == rows(C.strong_components(edges, members))


def test_own_names_and_empty(spark):
    f = spark.createDataFrame([("a", "x", ["x"]), ("b", "x", []), ("c", "y", ["y"]), ("d", "z", ["len"])], "lookup_id string, name string, calls array<string>")
    two = FC.factorise(f)
    assert rows(FC.edges_of(two)) == [("a", "b")]
    g = {r.lookup_id: (r.out_degree, r.in_degree) for r in FC.degrees(f.select("lookup_id"), two).collect()}
    assert g == {"a": (1, 0), "b": (0, 1), "c": (0, 0), "d": (0, 0)}
    assert rows(FC.connected_components(f.select("lookup_id"), two)) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]
    assert rows(FC.strong_components(two)) == []
    none = f.limit(0)
    two = FC.factorise(none)
    assert FC.degrees(none.select("lookup_id"), two).count() == 0 and FC.connected_components(none.select("lookup_id"), two).count() == 0
    assert FC.strong_components(two).count() == 0 and FC.nested_call_ids(none, two).count() == 0


def test_lists_of_callees_are_not_shuffled(spark, monkeypatch):
    f = functions(spark, 60, 10, 4, 3)
    two = FC.factorise(f)
    n = FC.nested_call_ids(f, two).select("lookup_id", "nested_call_ids")
    plan = n._jdf.queryExecution().executedPlan().toString().split("\n")
    window = next(i for i, line in enumerate(plan) if " Window" in line)
    join = max(i for i, line in enumerate(plan[:window]) if "SortMergeJoin" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above = [x for i, x in enumerate(plan[join + 1:window], join + 1) if all(depth(y) > depth(x) for y in plan[i + 1:window + 1])]
    assert above and not [x for x in above if "Exchange" in x or "Sort " in x]  # between the window and the join to the functions
    listed = rows(n)
    monkeypatch.setattr(FC, "LISTED", 0)  # too many definers to broadcast
    assert rows(FC.nested_call_ids(f, two).select("lookup_id", "nested_call_ids")) == listed == rows(G.nested_call_ids(f, G.resolve_calls(f)).select("lookup_id", "nested_call_ids"))


def strong_by(pairs):
    """Components of two nodes or more, by closure."""
    reach = {}
    for a in {x for p in pairs for x in p}:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            for s, d in pairs:
                if s == x and d not in seen:
                    seen.add(d)
                    todo.append(d)
        reach[a] = seen
    out = []
    for a in reach:
        group = {b for b in reach[a] if a in reach[b]} | {a}
        if len(group) > 1:
            out.append((a, min(group), len(group)))
    return sorted(out)


def graphs():
    ring = [(f"r{i:02d}", f"r{(i + 1) % 20:02d}") for i in range(20)]
    yield "ring", ring
    yield "ring with a way in and out", ring + [("in", "r03"), ("r07", "out"), ("out", "end")]
    yield "two rings on a bridge", ring + [("s1", "s2"), ("s2", "s3"), ("s3", "s1"), ("r05", "s1")]
    yield "eight", [("m", "a1"), ("a1", "a2"), ("a2", "m"), ("m", "b1"), ("b1", "m")]
    yield "handles", [("h", "c1"), ("c1", "c2"), ("c2", "t"), ("t", "h"), ("h", "d1"), ("d1", "t"), ("x", "x")]
    yield "no cycle", [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")]
    # the ring above colours what lies behind it, so x is between h and t of a chain a round after its own loop was found
    above = [p for i in range(40) for p in ((f"z{i:02d}", f"z{(i + 1) % 40:02d}"), (f"z{(i + 1) % 40:02d}", f"z{i:02d}"))]
    yield "a loop inside a later chain", above + [("z00", "h"), ("h", "x"), ("h", "y"), ("x", "t"), ("y", "t"), ("t", "h"), ("x", "a"), ("a", "x")]
    rng = random.Random(5)
    for n, m in ((40, 45), (25, 80)):
        yield f"random {n} {m}", sorted({(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(m)})


@pytest.mark.parametrize("name,pairs", list(graphs()))
def test_strong_components(spark, name, pairs):
    got = rows(C.strong_components(spark.createDataFrame(pairs, "src string, dst string")))
    assert got == strong_by([p for p in pairs if p[0] != p[1]])


def test_cycles_inside_a_module_part_run_through_names(spark, tmp_path, monkeypatch):
    """Functions of a part that share names: the cycles are those of the edges, and no edge is listed."""
    from callweave.plans import catalog
    rng = random.Random(11)
    made = [(f"f{i:03d}", f"n{rng.randrange(2)}", sorted({f"n{rng.randrange(2)}" for _ in range(rng.randrange(3))}), rng.choice(["A", "B"]), rng.randrange(2)) for i in range(60)]
    made += made[:7]  # rows that come twice
    f = spark.createDataFrame(made, "lookup_id string, name string, calls array<string>, module_name string, start_line int").cache()
    part = {r[0]: (r[3], r[4] % 5) for r in made}
    pairs = [tuple(r) for r in G.resolve_calls(f.distinct()).collect()]
    want = strong_by(sorted({(a, b) for a, b in pairs if part[a] == part[b]}))
    monkeypatch.setattr(catalog.S, "fn", lambda s, d: f)
    monkeypatch.setattr(FC, "edges_of", None)
    assert want and rows(catalog.q_module_cycles(spark, str(tmp_path))) == want


def depth_rows(spark, pairs, ids=None):
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(i,) for i in ids or sorted({x for p in pairs for x in p})], "lookup_id string")
    g = G.build_graph(nodes, edges)
    return {r.lookup_id: (r.depth_level, r.depth_capped) for r in g.collect()}


def test_chain_of_ten_thousand_in_few_rounds(spark, monkeypatch):
    n = 10_000
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(n)] + [(f"c{i}", f"util{i % 3}") for i in range(0, n, 7)]
    jobs = []
    from callweave.operators import pointers
    for module in (G, pointers):
        real = module.cut_and_count
        monkeypatch.setattr(module, "cut_and_count", lambda df, name="round", real=real: jobs.append(name) or real(df, name))
    got = depth_rows(spark, pairs)
    assert len(jobs) < 40
    assert all(got[f"c{i}"] == (i, False) for i in range(n + 1))
    assert [got[f"util{u}"] for u in range(3)] == [(1 + max(i for i in range(0, n, 7) if i % 3 == u), False) for u in range(3)]


def peeled_by(pairs):
    """Longest walks by peeling one node after the other, as before contraction."""
    nodes = sorted({x for p in pairs for x in p})
    callers = {n: {a for a, b in pairs if b == n} for n in nodes}
    roots = [n for n in nodes if not callers[n]]
    reached, todo = set(roots), list(roots)
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in reached:
                reached.add(b)
                todo.append(b)
    depth, changed = {r: 0 for r in roots}, True
    while changed:
        changed = False
        for n in reached - set(depth):
            inside = callers[n] & reached
            if inside <= set(depth):
                depth[n], changed = 1 + max(depth[c] for c in inside), True
    out = {n: (depth[n], False) for n in depth}
    for n in reached - set(depth):
        known = [depth[c] + 1 for c in callers[n] & set(depth)]
        out[n] = (max(known, default=0), True)
    return {n: out.get(n, (0, False)) for n in nodes}


def deep_graphs():
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)]
    yield "chain into a ring", chain + [("c30", "x1"), ("x1", "x2"), ("x2", "c30"), ("x2", "y1"), ("y1", "y2")]
    yield "chain beside a lost ring", chain + [("z1", "z2"), ("z2", "z1"), ("z2", "z3"), ("z3", "c20")]
    yield "diamonds", [p for i in range(15) for p in ((f"d{i}", f"l{i}"), (f"d{i}", f"r{i}"), (f"l{i}", f"d{i + 1}"), (f"r{i}", f"d{i + 1}"))] + [("d3", "r9")]
    yield "ladder", [p for i in range(12) for p in ((f"a{i}", f"a{i + 1}"), (f"b{i}", f"b{i + 1}"), (f"a{i}", f"b{i + 1}"), (f"b{i}", f"a{i + 1}"))]
    yield "ring at the top", chain + [("c12", "c11"), ("c25", "w"), ("c02", "w")]
    rng = random.Random(9)
    for n in (40,):
        yield f"random {n}", chain + sorted({tuple(sorted((f"c{rng.randrange(31):02d}", f"q{rng.randrange(n):02d}"))) for _ in range(n)})


@pytest.mark.parametrize("name,pairs", list(deep_graphs()))
def test_deep_graphs(spark, name, pairs):
    assert depth_rows(spark, pairs) == peeled_by(pairs)


@pytest.mark.parametrize("n,m,seed", [(12, 40, 1), (10, 60, 2)])
def test_path_counts_and_both_ways_of_walking(spark, monkeypatch, n, m, seed):
    rng = random.Random(seed)
    pairs = sorted({(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(m)})
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(f"v{i}",) for i in range(n)], "lookup_id string")
    roots, targets = nodes.where("lookup_id IN ('v0', 'v1', 'v2')"), nodes.where("lookup_id <> 'v5'")
    lists = []
    for forward in (0, 10_000):  # at no roots a target, and always
        monkeypatch.setattr(G, "FORWARD", 1 if forward == 0 else 10_000)
        lists.append(sorted((r.target, tuple(r.path), r.depth) for r in G.call_paths(edges, roots, targets, 3).collect()))
    walked = []
    todo = [("v0",), ("v1",), ("v2",)]
    while todo:
        p = todo.pop()
        if p[-1] != "v5":
            walked.append((p[-1], p, len(p) - 1))
        if len(p) < 4:
            todo += [(*p, d) for s, d in pairs if s == p[-1] and d not in p]
    assert lists[0] == lists[1] == sorted(walked)
    for depth in range(4):
        want = {}
        for t, p, k in walked:
            if k <= depth:
                want[t] = want.get(t, 0) + 1
        counts = G.call_path_counts(edges, roots, targets, depth)
        assert {r.target: r.call_paths_count for r in counts.collect()} == want
        assert "path" not in counts.columns


@pytest.mark.parametrize("seed", [3])
def test_sums_through_names_are_those_of_the_edges(spark, seed):
    f = functions(spark, 40, 12, 4, seed)
    two, edges = FC.factorise(f), G.resolve_calls(f).cache()
    nodes = f.select("lookup_id")
    some = nodes.where("lookup_id < 'f012'")
    roots = FC.degrees(nodes, two).where("is_root").select("lookup_id")
    for begin in (roots, nodes.where("lookup_id >= 'f030'")):  # roots that have callers too
        for depth in (2, 3):
            assert rows(FC.call_path_counts(two, begin, some, depth)) == rows(G.call_path_counts(edges, begin, some, depth))
    assert rows(FC.mutual_pairs(two)) == rows(G.mutual_pairs(edges))
    assert rows(FC.cyclic_core(two)) == rows(G.cyclic_core(edges))
    for depth in (1, 3):
        want = G.reachable(edges, some, depth, reverse=True).groupBy("target", "hops").count()
        assert rows(FC.caller_counts(two, some, depth)) == rows(want)
    both = {(a, b) for a, b in rows(edges)} | {(b, a) for a, b in rows(edges)}
    assert rows(FC.linked(two, some)) == sorted(p for p in both if p[0] < "f012")
    twice = f.unionByName(f.where("lookup_id < 'f009'"))
    again = FC.factorise(twice)
    assert rows(FC.degrees(nodes, again, repeats=True)) == rows(G.degrees(nodes, G.resolve_calls(twice)))
    assert rows(FC.mutual_pairs(again)) == rows(G.mutual_pairs(G.resolve_calls(twice)))


def test_ids_of_two_names(spark):
    f = spark.createDataFrame([("a", "x", ["y", "z"]), ("b", "y", ["x"]), ("b", "z", ["x", "y"]), ("c", "z", [])], "lookup_id string, name string, calls array<string>")
    two, edges = FC.factorise(f), G.resolve_calls(f)
    some = f.select("lookup_id").distinct()
    assert not FC.one_name(two)
    assert rows(FC.mutual_pairs(two)) == rows(G.mutual_pairs(edges))
    assert rows(FC.call_path_counts(two, some, some, 2)) == rows(G.call_path_counts(edges, some, some, 2))
    assert rows(FC.caller_counts(two, some, 2)) == rows(G.reachable(edges, some, 2, reverse=True).groupBy("target", "hops").count())


def test_context_and_rerank_through_names(spark):
    from callweave.operators import search as SR
    f = functions(spark, 40, 12, 4, 5)
    two, edges = FC.factorise(f), G.resolve_calls(f)
    nodes = f.selectExpr("lookup_id", "name", "name AS file_name", "name AS module_name", "true AS is_async", "false AS has_error_handling")
    hits = spark.createDataFrame([(1, "f001", 8.0), (1, "f002", 3.0), (2, "f002", 5.0), (2, "f030", 5.0)], "query_id long, lookup_id string, score double")
    for depth in (2,):
        assert rows(SR.with_graph_context(hits, two, nodes, depth)) == rows(SR.with_graph_context(hits, edges, nodes, depth))
    assert rows(SR.graph_rerank(hits, two)) == rows(SR.graph_rerank(hits, edges))


def test_no_list_is_broadcast(spark):
    f = functions(spark, 40, 12, 4, 6)
    plan = FC.nested_call_ids(f, FC.factorise(f))._jdf.queryExecution().executedPlan().toString()
    lists = [line for line in plan.splitlines() if "BroadcastHashJoin [lookup_id" in line or "BroadcastHashJoin [name" in line and "Inner" in line]
    assert not lists and plan.count("SortMergeJoin") >= 2
    assert rows(FC.nested_call_ids(f, FC.calls_of(FC.factorise(f), f.where("lookup_id = 'f001'"))).where("lookup_id = 'f001'").select("nested_call_ids")) == \
        rows(FC.nested_call_ids(f, FC.factorise(f)).where("lookup_id = 'f001'").select("nested_call_ids"))


def test_lines_are_paired_by_number_and_part(spark, tmp_path, monkeypatch):
    """Suppliers and prices of tied lines change no pair: they are not read, with many lines an order too."""
    from callweave.plans import standins as S
    lines = [(1, 1, 10, 7, 2.0), (1, 1, 10, 3, 9.0), (1, 1, 11, 1, 1.0), (1, 2, None, 5, 5.0), (1, 3, 12, 1, 1.0), (1, 3, 12, 1, 1.0), (2, 1, 12, 2, 1.0), (2, 2, 10, 2, 1.0), (None, 1, 11, 1, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, f"n{k}", "b") for k in (10, 11, 12)], "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    want = [("P10", "n10/b"), ("P10", "n11/b"), ("P12", "n10/b"), ("P12", "n12/b"), (None, "n12/b")]
    for most in (S.HOT_ORDER_LINES, 3):
        monkeypatch.setattr(S, "HOT_ORDER_LINES", most)
        calls = S.fn_calls(spark, str(tmp_path))
        assert sorted(map(tuple, calls.collect()), key=repr) == sorted(want, key=repr)
        plan = [x for x in calls._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" not in x]
        assert not any(c in x for x in plan for c in ("l_suppkey", "l_extendedprice"))
