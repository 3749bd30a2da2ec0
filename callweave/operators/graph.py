"""Call-graph operators over an edge table ``edges(src string, dst string)``.

Iterative operators run one distributed frontier per round, which meets edges that
were salted and hash-partitioned once, so later rounds move only the frontier. Each round is cut with ``checkpoint()`` into
``spark.checkpoint.dir`` and counted; loops stop on an empty frontier or the hop
limit. No adjacency list is ever collected to the driver or into one task.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.fixed import BUILTIN_NAMES, DEFAULT_CONTEXT_DEPTH
from callweave.operators.pointers import follow
from callweave.operators.pointers import union as _union
from callweave.operators.ranking import global_dense_rank
from callweave.session import cut_and_count, cut_lineage


def _empty_strs():
    return F.array().cast("array<string>")


#: a key of more than ``HOT`` edges is spread over ``SALTS`` tasks (its edges are dealt by a hash of the edge)
SALTS, HOT = 8, 20_000


#: the edges that the last result to be read needs
_late: list[DataFrame] = []


class _Expander:
    """Joins a frontier to the loop-invariant edge table on ``key``.

    The edges are hash-partitioned and sorted once and kept (``persist``, so a lost part is made again
    from its source): later rounds move and sort only the frontier. Keys of more than ``HOT`` edges (counted first;
    at most edges / ``HOT`` of them, so they may be broadcast) are salted: their edges lie in ``SALTS``
    partitions, and a frontier row of such a key, and no other, is sent once per salt. ``like``: a table with
    the same keys as ``edges`` that is cheaper to count; ``counted``: (_hot, _n), these counts if they are there.
    Spark broadcasts a frontier that its size statistics call small. Without ``keep`` the edges are for one round.
    """

    def __init__(self, edges: DataFrame, key: str, like: DataFrame | None = None, counted: DataFrame | None = None, keep: bool = True):
        n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if counted is None:
            counted = (edges if like is None else like).groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
        hot = cut_lineage(counted.where(F.col("_n") > HOT).select("_hot"))
        self.hot = None if hot.isEmpty() else hot
        salt = F.pmod(F.xxhash64(*edges.columns), F.lit(SALTS)).cast("int")
        self.key, self.columns = key, edges.columns
        kept = lambda laid: laid.persist(StorageLevel.MEMORY_AND_DISK) if keep else laid
        if self.hot is None:
            self.laid = kept(edges.repartition(n, key).sortWithinPartitions(key))
            return
        salted = self._marked(edges, key).withColumn("_salt", F.when(F.col("_hot").isNotNull(), salt).otherwise(0)).drop("_hot")
        self.laid = kept(salted.repartition(n, key, "_salt").sortWithinPartitions(key, "_salt"))

    def _marked(self, rows: DataFrame, on: str) -> DataFrame:
        return rows.join(F.broadcast(self.hot), rows[on] == self.hot["_hot"], "left")

    def join(self, frontier: DataFrame, on: str) -> DataFrame:
        wanted = [*frontier.columns, *(c for c in self.columns if c not in frontier.columns)]
        if self.hot is None:
            return frontier.join(self.laid, frontier[on] == self.laid[self.key]).select(*wanted)
        salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        f = self._marked(frontier, on).withColumn("_s", F.explode(salts)).drop("_hot")
        both = f.join(self.laid, (f[on] == self.laid[self.key]) & (f["_s"] == self.laid["_salt"]))
        return both.select(*wanted)

    def close(self, late: bool = False) -> None:
        """Give up the kept edges; ``late``: a result that is still to be read needs them, so they stay until the next such call."""
        if late:
            _late.append(self.laid)
        for laid in _late[:-1] if late else [self.laid]:
            laid.unpersist()
        if late:
            del _late[:-1]


# ---------------------------------------------------------------- J1, J2, J8
def resolve_calls(functions: DataFrame, builtins: list[str] | None = None,
                  id_col: str = "lookup_id", name_col: str = "name",
                  calls_col: str = "calls") -> DataFrame:
    """Call names equi-joined to function names; self and built-ins excluded.

    Every function carrying the called name is a callee. ``lookup_id`` is a key
    of ``functions`` and ``calls`` is de-duplicated per row, so each (src, dst)
    comes out once without a separate distinct. A name held by a large share
    of functions is a skewed join key: AQE's skew join splits it.
    """
    builtins = BUILTIN_NAMES if builtins is None else builtins
    called = (functions.select(F.col(id_col).alias("src"),
                               F.explode(F.array_distinct(calls_col)).alias("callee_name"))
              .where(~F.col("callee_name").isin(builtins)))
    named = functions.select(F.col(id_col).alias("dst"), F.col(name_col).alias("callee_name"))
    return (called.join(named, "callee_name")
            .where(F.col("src") != F.col("dst"))
            .select("src", "dst"))


def nested_call_ids(functions: DataFrame, edges: DataFrame, id_col: str = "lookup_id") -> DataFrame:
    """``nested_call_ids`` = sorted callee ids per function (empty when none)."""
    # (src, dst) pairs from resolve_calls are unique, so a list is enough
    per_src = (edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("nested_call_ids"))
               .withColumnRenamed("src", id_col))
    return (functions.drop("nested_call_ids").join(per_src, id_col, "left")
            .withColumn("nested_call_ids", F.coalesce("nested_call_ids", _empty_strs())))


#: so many ids without a node are broadcast to take their edges out
FEW = 100_000


def with_ends(edges: DataFrame) -> DataFrame:
    return edges.where("src IS NOT NULL AND dst IS NOT NULL")


def unknown_ends(counts: DataFrame, nodes: DataFrame, id_col: str = "lookup_id") -> DataFrame:
    """(id) of the ends (``end_counts``) that are no node."""
    return counts.select(F.col("lookup_id").alias("id")).join(nodes.select(F.col(id_col).alias("id")), "id", "left_anti")


def keep_known_endpoints(edges: DataFrame, nodes: DataFrame, id_col: str = "lookup_id", unknown: DataFrame | None = None) -> DataFrame:
    """Keep an edge only when both ends are nodes.

    The distinct ends are looked up (``unknown``: their ``unknown_ends``, if they are there), not each
    edge: with every end a node, no edge is moved; a few ends without one (counted) are broadcast.
    Only with many are both ends of all edges joined to the nodes."""
    ended = with_ends(edges)
    if unknown is None:
        unknown = cut_lineage(unknown_ends(end_counts(ended), nodes, id_col))
    n = unknown.count()
    if n == 0:
        return ended
    ids, kind = (nodes.select(F.col(id_col).alias("_id")), "left_semi") if n > FEW else (F.broadcast(unknown.select(F.col("id").alias("_id"))), "left_anti")
    return (ended.join(ids, ended["src"] == ids["_id"], kind)
                 .join(ids, ended["dst"] == ids["_id"], kind))


def external_calls(functions: DataFrame, builtins: list[str] | None = None,
                   id_col: str = "lookup_id", name_col: str = "name", calls_col: str = "calls") -> DataFrame:
    """Called names that no function in the corpus defines (built-ins apart):
    ``(lookup_id, call)``. A left anti join on the name, so it scales like J1."""
    builtins = BUILTIN_NAMES if builtins is None else builtins
    called = (functions.select(F.col(id_col), F.explode(F.array_distinct(calls_col)).alias("call"))
              .where(~F.col("call").isin(builtins)))
    names = functions.select(F.col(name_col).alias("call")).distinct()
    return called.join(names, "call", "left_anti").select(id_col, "call")


def prune_leaves(edges: DataFrame, graph: DataFrame, id_col: str = "lookup_id") -> DataFrame:
    """Drop edges that end in a leaf (a function calling nothing)."""
    leaves = graph.where(F.col("is_leaf")).select(F.col(id_col).alias("dst"))
    return edges.join(leaves, "dst", "left_anti").select("src", "dst")


# ------------------------------------------------------------ G2, J7, G9, G3
def end_counts(edges: DataFrame) -> DataFrame:
    """(lookup_id, out_degree, in_degree) of every id at an end of an edge."""
    # one pass: each edge counts once for its source and once for its target
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return (ends.groupBy(F.col("e.n").alias("lookup_id"))
            .agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree")))


def degrees(nodes: DataFrame, edges: DataFrame, id_col: str = "lookup_id", counts: DataFrame | None = None) -> DataFrame:
    """G2 + J7 + G9: out/in degree, root and leaf flags, node type (isolated -> root).
    ``counts``: ``end_counts`` of the edges, if they are there."""
    deg = (end_counts(edges) if counts is None else counts).withColumnRenamed("lookup_id", id_col)
    g = (nodes.join(deg, id_col, "left")
         .withColumn("out_degree", F.coalesce("out_degree", F.lit(0)).cast("int"))
         .withColumn("in_degree", F.coalesce("in_degree", F.lit(0)).cast("int")))
    return with_node_types(g)


def with_node_types(g: DataFrame) -> DataFrame:
    """Root and leaf flags and the node type of a table with both degrees."""
    return (g.withColumn("is_root", F.col("in_degree") == 0)
             .withColumn("is_leaf", F.col("out_degree") == 0)
             .withColumn("node_type", F.when(F.col("is_root"), "root")
                         .when(F.col("is_leaf"), "leaf").otherwise("intermediate")))


#: topological levels that are peeled before chains are contracted
SHALLOW = 8
#: contraction goes on while it takes this share of the nodes that have callers
WORTH = 1 / 16


def longest_depth(roots: DataFrame, edges: DataFrame, id_col: str = "lookup_id", counts: DataFrame | None = None) -> DataFrame:
    """``depth_level`` = longest walk from any root (Q9), without a depth limit.

    Nodes are peeled in topological order: a node is final when its last caller is,
    and its edges are used once, in the round after. Between rounds only the *open*
    nodes (some callers final, some not) are kept, as the number of callers that are
    still missing and the depth so far. What is never peeled is on or behind a cycle:
    its longest walk is unbounded, so it is flagged ``depth_capped`` and carries the
    depth that its final callers give (0 without one). Callers that no root reaches
    (cycles of their own) hold nothing back. Nodes no root reaches are absent.

    A graph of more than ``SHALLOW`` levels is contracted first (``_contract_callers``): nodes with
    one caller hang on the node at the head of their chain, at a distance that pointer
    doubling finds, so chains and trees of any depth take a logarithmic number of rounds.
    ``edges`` are read several times, so they should be stored; an edge that comes twice is a caller
    twice and used twice. ``counts``: their ``end_counts``, if they are there.
    """
    e = edges.select("src", "dst").withColumn("w", F.lit(1))
    start = cut_lineage(roots.select(F.col(id_col).alias("node")).distinct())
    done, opened, ended = _peel(start, e, SHALLOW, counts)
    hung: list[DataFrame] = []
    if not ended:
        e, hung = _contract_callers(start, e)
        done, opened, _ = _peel(start, e)
    rest = None
    if not opened.isEmpty():  # a cycle, or a caller that no root reaches: count the callers inside only
        reached = _closure(start, e)
        done, opened, _ = _peel(start, e.join(reached.withColumnRenamed("node", "src"), "src", "left_semi"))
        rest = (reached.join(done.select("node"), "node", "left_anti").join(opened.select("node", "depth"), "node", "left")
                .select("node", F.coalesce("depth", F.lit(0)).alias("depth")))
    for members in reversed(hung):  # a member is final, or behind a cycle, as its head is
        head = members.withColumnRenamed("node", "member").withColumnRenamed("head", "node")
        done = cut_lineage(done.unionByName(head.join(done, "node").select(F.col("member").alias("node"), (F.col("depth") + F.col("dist")).alias("depth"))))
        if rest is not None:
            rest = cut_lineage(rest.unionByName(head.join(rest, "node").select(F.col("member").alias("node"), F.lit(0).alias("depth"))))
    level = lambda df, capped: df.select(F.col("node").alias(id_col), F.col("depth").cast("int").alias("depth_level"), F.lit(capped).alias("depth_capped"))
    return level(done, False) if rest is None else level(done, False).unionByName(level(rest, True))


def _contract_callers(start: DataFrame, edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Contract ``edges(src, dst, w)``: a node with a single caller (no start node) hangs on the first
    node up its chain that is none, and its own edges begin there, longer by its distance. Of
    parallel edges the longest stays (max-plus), which may leave other nodes with one caller,
    so this is repeated while it is worth it. Chains that come from no such node run in a ring
    that no start reaches; they go. (the edges, ``members(node, head, dist)`` of each pass)."""
    hung = []
    while True:
        callers = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("to"), F.min("w").alias("w"))
        callers, nodes = cut_and_count(callers.join(start.withColumnRenamed("node", "dst"), "dst", "left_anti"), "callers")
        single, n = cut_and_count(callers.where("n = 1").select(F.col("dst").alias("node"), "to", "w"), "single")
        if n == 0 or n < WORTH * nodes:
            return edges, hung
        ends, rings = follow(single)
        members = ends.select("node", F.col("end").alias("head"), "dist")
        hung.append(members)
        left = (edges.join(single.select(F.col("node").alias("dst")), "dst", "left_anti")
                .join(rings.select(F.col("node").alias("src")), "src", "left_anti")
                .join(members.withColumnRenamed("node", "src"), "src", "left")
                .select(F.coalesce("head", "src").alias("src"), "dst", (F.col("w") + F.coalesce("dist", F.lit(0))).alias("w")))
        edges = cut_lineage(left.groupBy("src", "dst").agg(F.max("w").alias("w")))


def _peel(start: DataFrame, edges: DataFrame, levels: int | None = None, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Topological peeling from ``start(node)`` over ``edges(src, dst, w)``: (final nodes with their longest
    walk, nodes that still miss callers with the depth so far, whether it came to its end
    within so many levels). A node's number of callers (of ``counts``, if they are there) meets what was
    counted of it in the round, so it is not carried by each edge."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    need = (edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("callers")) if counts is None
            else counts.where("in_degree > 0").select(F.col("lookup_id").alias("node"), F.col("in_degree").alias("callers")))
    need = need.repartition(parts, "node").sortWithinPartitions("node").persist(StorageLevel.MEMORY_AND_DISK)
    walk = _Expander(edges, "src", counted=None if counts is None else counts.select(F.col("lookup_id").alias("_hot"), F.col("out_degree").alias("_n")))
    final = cut_lineage(start.join(need, "node", "left_anti")
                        .select("node", F.lit(0).cast("long").alias("need"), F.lit(0).cast("long").alias("depth")))
    done, opened = [final], final.where("need > 0")
    while True:
        met = walk.join(final.select("node", "depth"), "node").select(
            F.col("dst").alias("node"), F.lit(None).cast("long").alias("need"), (F.col("depth") + F.col("w")).alias("depth"), F.lit(1).cast("long").alias("used"))
        # callers are counted down, so an open row's need is what is still missing
        state = (met.unionByName(opened.withColumn("used", F.lit(0).cast("long"))).groupBy("node")
                 .agg(F.max("need").alias("need"), F.sum("used").alias("used"), F.max("depth").alias("depth")))
        state, rows = cut_and_count(state.join(need, "node").select("node", (F.coalesce("need", "callers") - F.col("used")).alias("need"), "depth"), "depth")
        final, opened = state.where("need = 0"), state.where("need > 0")
        ended = rows == 0 or final.isEmpty()
        if ended or len(done) == levels:
            walk.close()
            need.unpersist()
            return _union(done).select("node", "depth"), opened, ended
        done.append(final)


def _closure(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes reachable from ``start(node)`` (itself included); ends when nothing is new."""
    e = _Expander(edges.select("src", "dst"), "src")
    seen, cur = [start], start
    while True:
        # one round behind is not enough to rule out an old node, so all levels are asked, in one semi join
        nxt, rows = cut_and_count(e.join(cur, "node").select(F.col("dst").alias("node")).distinct()
                                  .join(_union(seen), "node", "left_anti"), "closure")
        if rows == 0:
            e.close()
            return cut_lineage(_union(seen))
        seen.append(nxt)
        cur = nxt


def build_graph(nodes: DataFrame, edges: DataFrame, id_col: str = "lookup_id", counts: DataFrame | None = None) -> DataFrame:
    """G1: per-node table with degrees, root/leaf flags, type and depth. ``counts``: the ``end_counts``
    of ``edges``, if these are stored and have nodes at both ends."""
    if counts is None:
        edges = cut_lineage(with_ends(edges.select("src", "dst")))
        counts = cut_lineage(end_counts(edges))
        unknown = cut_lineage(unknown_ends(counts, nodes, id_col))
        if not unknown.isEmpty():
            edges = cut_lineage(keep_known_endpoints(edges, nodes, id_col, unknown))
            counts = cut_lineage(end_counts(edges))
    g, _ = cut_and_count(degrees(nodes, edges, id_col, counts), "degrees")
    depth = longest_depth(g.where("is_root").select(id_col), edges, id_col, counts)
    return (g.join(depth, id_col, "left")
             .withColumn("depth_level", F.coalesce("depth_level", F.lit(0)).cast("int"))
             .withColumn("depth_capped", F.coalesce("depth_capped", F.lit(False))))


def graph_statistics(graph: DataFrame) -> DataFrame:
    """R2: one row; ``total_edges`` = sum of out-degrees."""
    return graph.agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if(F.col("is_root")).alias("root_nodes"),
        F.count_if(F.col("is_leaf")).alias("leaf_nodes"),
        F.coalesce(F.max("depth_level"), F.lit(0)).alias("max_depth"),
        F.coalesce(F.sum("out_degree"), F.lit(0)).alias("total_edges"),
        F.round(F.coalesce(F.avg("out_degree"), F.lit(0.0)), 6).alias("avg_calls_per_function"),
    )


# ----------------------------------------------------------------- G5, G12
def reachable(edges: DataFrame, targets: DataFrame, max_depth: int = DEFAULT_CONTEXT_DEPTH,
              reverse: bool = False, id_col: str = "lookup_id") -> DataFrame:
    """G5 (callees) / G12 (callers, ``reverse=True``): ``(target, node, hops)``.

    Nodes at breadth-first distance <= ``max_depth``, the target included at 0
    hops (Q6, Q7). Order-independent, and a superset of any depth-first run.
    """
    e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse \
        else edges.select("src", "dst")
    e = _Expander(e, "src")
    frontier, rows = cut_and_count(targets.select(F.col(id_col).alias("target")).distinct()
                                   .withColumn("node", F.col("target")), "reach")
    levels = [frontier.withColumn("hops", F.lit(0))]
    for h in range(1, max_depth + 1):
        if rows == 0:
            break
        seen = _union(levels).select("target", "node")
        nxt, rows = cut_and_count(e.join(frontier, "node")
                                  .select("target", F.col("dst").alias("node")).distinct()
                                  .join(seen, ["target", "node"], "left_anti"), "reach")
        if rows == 0:
            break
        levels.append(nxt.withColumn("hops", F.lit(h)))
        frontier = nxt
    e.close()
    return _union(levels).withColumn("hops", F.col("hops").cast("int"))


# ----------------------------------------------------------------------- G7
def root_distance(edges: DataFrame, roots: DataFrame, max_depth: int,
                  id_col: str = "lookup_id") -> tuple[DataFrame, int]:
    """``(node, dist)``: fewest edges from any root to each node, up to ``max_depth``
    (a multi-source breadth-first search whose frontier holds distinct nodes),
    and its row count."""
    e = _Expander(edges.select("src", "dst"), "src")
    frontier, rows = cut_and_count(roots.select(F.col(id_col).alias("node")).distinct(), "rootdist")
    levels, total = [frontier.withColumn("dist", F.lit(0))], rows
    for h in range(1, max_depth + 1):
        if rows == 0:
            break
        seen = _union(levels).select("node")
        nxt, rows = cut_and_count(e.join(frontier, "node").select(F.col("dst").alias("node")).distinct()
                                  .join(seen, "node", "left_anti"), "rootdist")
        if rows:
            levels.append(nxt.withColumn("dist", F.lit(h)))
            total += rows
        frontier = nxt
    e.close()
    return _union(levels).withColumn("dist", F.col("dist").cast("int")), total


#: with so many targets for every root, paths are walked forwards from the roots
FORWARD = 100


def call_paths(edges: DataFrame, roots: DataFrame, targets: DataFrame,
               max_depth: int = DEFAULT_CONTEXT_DEPTH, id_col: str = "lookup_id") -> DataFrame:
    """Simple paths root -> target with at most ``max_depth`` edges (Q11).

    With few roots for the targets (both are counted) the paths are walked forwards from
    the roots, as nearly every path there ends at a target. Otherwise they are walked
    backwards from the targets and pruned exactly: a head more than the remaining number
    of hops away from every root (``root_distance``) cannot complete, so it is dropped
    before it is extended. The rows are the same. A target that is a root yields ``[target]``.
    Output ``(target, path array<string>, depth)``.
    """
    ends, n_t = cut_and_count(targets.select(F.col(id_col).alias("end")).distinct(), "targets")
    starts, n_r = cut_and_count(roots.select(F.col(id_col).alias("end")).distinct(), "roots")
    if n_t == 0 or n_r == 0:  # no target or no root: no path
        return edges.sparkSession.createDataFrame([], "target string, path array<string>, depth int")
    forward = n_r * FORWARD <= n_t
    begin, goal = (starts, ends) if forward else (ends, starts)
    dist = None if forward else root_distance(edges, roots, max_depth, id_col)[0].select(F.col("node").alias("end"), "dist")
    step = _Expander(edges.select(F.col("src" if forward else "dst").alias("at"), F.col("dst" if forward else "src").alias("next")), "at")
    longer = F.concat("path", F.array("next")) if forward else F.concat(F.array("next"), "path")

    def alive(paths: DataFrame, hops: int) -> DataFrame:
        """Paths whose open end may still come to a root within so many hops."""
        return paths if dist is None else paths.join(dist, "end").where(F.col("dist") <= hops).drop("dist")

    cur = alive(begin.select("end", F.array("end").alias("path")), max_depth)
    done = []
    for r in range(max_depth + 1):
        if r:
            cur = (step.join(cur, "end").where(~F.array_contains("path", F.col("next")))
                   .select(F.col("next").alias("end"), longer.alias("path")))
            cur = alive(cur, max_depth - r)
        if r < max_depth:  # the last step is not walked on from
            cur, rows = cut_and_count(cur, "paths")
        done.append(cur.join(goal, "end", "left_semi"))
        if r < max_depth and rows == 0:
            break
    step.close(late=True)  # the last step is walked when the result is read
    return _union(done).select(F.element_at("path", -1).alias("target"), "path", (F.size("path") - 1).alias("depth"))


def call_path_counts(edges: DataFrame, roots: DataFrame, targets: DataFrame,
                     max_depth: int = DEFAULT_CONTEXT_DEPTH, id_col: str = "lookup_id") -> DataFrame:
    """``(target, call_paths_count)``: how many rows ``call_paths`` gives each target that has any,
    without listing a path.

    Walks from the roots are counted by three sums over the edges. A walk of at most three edges
    repeats a node only by going to a neighbour and back, or around a triangle, so the walks
    r-a-b-t with r = b, with a = t (both at once added back) and with r = t, and the walks r-a-t with
    r = t, are counted by mutual calls and triangles and taken off. Longer walks are listed.
    """
    if max_depth > 3:
        return call_paths(edges, roots, targets, max_depth, id_col).groupBy("target").agg(F.count(F.lit(1)).alias("call_paths_count"))
    n = lambda c: c.cast("decimal(38,0)")  # noqa: E731 - products of degrees
    one = n(F.lit(1))
    root = cut_lineage(roots.select(F.col(id_col).alias("node")).distinct())
    parts = [root.withColumn("w", one)]
    if max_depth >= 1:
        # an edge and the one back meet under the same pair, so one exchange makes the edges distinct and tells the mutual ones
        pairs = (edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
                 .agg(F.bool_or(F.col("src") < F.col("dst")).alias("up"), F.bool_or(F.col("src") > F.col("dst")).alias("down")))
        way = lambda on, src, dst: F.when(F.col(on), F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("up") & F.col("down")).alias("mutual")))
        e = pairs.select(F.explode(F.array_compact(F.array(way("up", "a", "b"), way("down", "b", "a")))).alias("e")).select("e.*")
        walk = _Expander(e, "src", edges)  # the one layout that all sums read

    def along(values: DataFrame, only: str = "true") -> DataFrame:
        """(node, w): the values of a node's callers added up."""
        return cut_lineage(walk.join(values.select("node", "w"), "node").where(only).groupBy(F.col("dst").alias("node")).agg(n(F.sum("w")).alias("w")))

    minus = lambda df: df.select("node", (-F.col("w")).alias("w"))
    if max_depth >= 1:
        first = along(parts[0])
        parts.append(first)
    if max_depth >= 2:
        second = along(first)
        # mutual calls: both ends of each, and those with a root at the other end
        mutual = cut_lineage(walk.laid.where("mutual").groupBy(F.col("src").alias("node")).agg(n(F.count(F.lit(1))).alias("w")))
        of_root = cut_lineage(mutual.join(root, "node", "left_semi"))
        parts += [second, minus(of_root)]
    if max_depth >= 3:
        detour = first.join(mutual.withColumnRenamed("w", "m"), "node").select("node", (F.col("w") * F.col("m")).cast("decimal(38,0)").alias("w"))  # a = t
        parts += [along(second), minus(along(of_root)), minus(detour), along(parts[0], "mutual")]  # r = b; both
        called = cut_lineage(walk.laid.select(F.col("dst").alias("node")).distinct().join(root, "node", "left_semi"))  # only these roots lie on a triangle
        if not called.isEmpty():
            e = walk.laid.select("src", "dst")
            ring = (e.join(called.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("t"), F.col("dst").alias("a"))
                    .join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), "a").where("b <> t")
                    .join(e.select(F.col("src").alias("b"), F.col("dst").alias("t")), ["b", "t"]))
            parts.append(minus(cut_lineage(ring.groupBy(F.col("t").alias("node")).agg(n(F.count(F.lit(1))).alias("w")))))
    if max_depth >= 1:
        walk.close()
    total = _union([p.select("node", n(F.col("w")).alias("w")) for p in parts]).groupBy("node").agg(F.sum("w").cast("long").alias("call_paths_count")).where("call_paths_count > 0")
    return total.join(targets.select(F.col(id_col).alias("node")).distinct(), "node", "left_semi").withColumnRenamed("node", "target")


# ------------------------------------------------------------- G6, G8, R3
def context_functions(context: DataFrame, nodes: DataFrame, id_col: str = "lookup_id") -> DataFrame:
    """The functions of each target's context, the target first (``position`` 0)."""
    c = context.join(nodes.withColumnRenamed(id_col, "node"), "node")
    w = Window.partitionBy("target").orderBy(F.col("hops"), F.col("node"))
    return c.withColumn("position", F.row_number().over(w) - 1)


def context_summary(context: DataFrame, nodes: DataFrame, paths: DataFrame | None = None,
                    id_col: str = "lookup_id", name_col: str = "name") -> DataFrame:
    """One row per target.

    ``dependency_count`` counts the target itself (Q7; ``dependency_count_excl_self``
    does not); ``graph_depth`` is the context size (Q8) and ``max_hops`` the depth.
    """
    attrs = nodes.select(F.col(id_col).alias("node"), "file_name", "module_name",
                         "has_error_handling", "is_async")
    c = context.join(attrs, "node", "left")
    s = c.groupBy("target").agg(
        F.count(F.lit(1)).alias("dependency_count"),
        F.max("hops").alias("max_hops"),
        F.array_sort(F.collect_set("file_name")).alias("files_involved"),
        F.array_sort(F.collect_set("module_name")).alias("modules_involved"),
        F.coalesce(F.bool_or("has_error_handling"), F.lit(False)).alias("has_error_handling"),
        F.count_if(F.col("is_async")).alias("async_functions"),
    )
    s = (s.withColumn("dependency_count_excl_self", F.col("dependency_count") - 1)
          .withColumn("graph_depth", F.col("dependency_count"))
          .withColumn("total_functions", F.col("dependency_count")))
    names = nodes.select(F.col(id_col).alias("target"), F.col(name_col).alias("primary_function"))
    s = s.join(names, "target", "left")
    if paths is not None:  # listed paths, or their counts
        pc = paths if "call_paths_count" in paths.columns else paths.groupBy("target").agg(F.count(F.lit(1)).alias("call_paths_count"))
        s = (s.join(pc, "target", "left")
              .withColumn("call_paths_count", F.coalesce("call_paths_count", F.lit(0))))
    return s


# ---------------------------------------------------------------- G10, G11
def _contract(edges: DataFrame) -> DataFrame:
    """One min-label step: with L(u) = min(u, neighbours of u), the edge set
    {(L(u), L(v)) : (u, v) in E} plus {(u, L(u))} has exactly the components of E
    (u-L(u) is an edge or a node; L(u)-u-v-L(v) is a path), and usually far fewer
    distinct pairs. L is a min-aggregate (combined map-side); its lookups are
    joins that AQE turns into broadcasts when L is small."""
    e0 = edges.where(F.col("src") != F.col("dst")).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = e0.unionByName(e0.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lab, _ = cut_and_count(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "labels")
    la = lab.select(F.col("a"), F.col("m").alias("ma"))
    lb = lab.select(F.col("a").alias("b"), F.col("m").alias("mb"))
    contracted = (e0.join(la, "a").join(lb, "b")
                  .where(F.col("ma") != F.col("mb"))
                  .select(F.greatest("ma", "mb").alias("a"), F.least("ma", "mb").alias("b")))
    links = lab.where(F.col("a") != F.col("m")).select("a", F.col("m").alias("b"))
    return contracted.unionByName(links).distinct()


def _components_core(nodes: DataFrame, edges: DataFrame, id_col: str = "lookup_id",
                     max_rounds: int = 64) -> DataFrame:
    """G10 core: weakly connected components: one min-label contraction, then
    alternating large-star / small-star (Kiveris et al., SoCC 2014) to a star
    forest. ``component_id`` = smallest id in the component.

    Edges are kept as ``(a, b)`` with ``a > b``; every step is a min-aggregate
    (combined map-side) and an equi join, so a hub node never has its neighbour
    list gathered in one place. Converged when no parent is also a child.
    """
    e, _ = cut_and_count(_contract(edges), "stars")
    for _ in range(max_rounds):
        parents = e.select(F.col("b").alias("a")).distinct()
        if e.join(parents, "a", "left_semi").isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: each neighbour above u links to m(u) = min(u, N(u))
        m1 = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        ls = (both.where(F.col("b") > F.col("a")).join(m1, "a")
              .select(F.col("b").alias("a"), F.col("m").alias("b"))
              .where(F.col("a") != F.col("b")).distinct())
        # small star: u and its smaller neighbours link to their minimum
        m2 = ls.groupBy("a").agg(F.min("b").alias("m"))
        ss = (ls.join(m2, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
              .unionByName(m2.select("a", F.col("m").alias("b")))
              .where(F.col("a") != F.col("b")).distinct())
        e, _ = cut_and_count(ss, "stars")
    else:
        raise RuntimeError("connected components did not converge")
    comp = e.select(F.col("a").alias(id_col), F.col("b").alias("component_id"))
    return (nodes.select(id_col).join(comp, id_col, "left")
            .withColumn("component_id", F.coalesce("component_id", F.col(id_col))))


def star_components(nodes: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """Weakly connected components of integer ids (no hashing step); every row of ``nodes``
    once with ``component_id``, the smallest id of its component."""
    return _components_core(nodes, edges, id_col)


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """Pairs calling each other, reported once as ``(a, b)`` with ``a < b``."""
    fwd = edges.where(F.col("src") < F.col("dst")).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.where(F.col("src") > F.col("dst")).select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return fwd.join(back, ["a", "b"], "left_semi")


def _cyclic_core(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Nodes left after repeatedly removing nodes without callers or callees
    among the remaining edges: the cycles and everything that lies between them."""
    e, size = cut_and_count(edges.select("src", "dst").distinct(), "core")
    for _ in range(max_rounds):
        srcs = e.select(F.col("src").alias("n")).distinct()
        dsts = e.select(F.col("dst").alias("n")).distinct()
        alive = srcs.join(dsts, "n", "left_semi")
        nxt = (e.join(alive.withColumnRenamed("n", "src"), "src", "left_semi")
                .join(alive.withColumnRenamed("n", "dst"), "dst", "left_semi"))
        nxt, n = cut_and_count(nxt, "core")
        if n == size:
            break
        e, size = nxt, n
    else:  # never hand back a half-peeled graph
        raise RuntimeError(f"cyclic core did not settle in {max_rounds} rounds")
    return e.select(F.col("src").alias("lookup_id")).distinct()


def _hash_codec(edges: DataFrame, extra_ids: DataFrame | None = None) -> DataFrame | None:
    """``(id, h)`` with ``h = xxhash64(id)`` for every id in the edges (and ``extra_ids``),
    or None when two ids share a hash. Long keys halve the shuffle and hashing
    cost of every later round; the check keeps the result exact."""
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    if extra_ids is not None:
        ids = ids.unionByName(extra_ids.select(F.col(extra_ids.columns[0]).alias("id")))
    codec, n = cut_and_count(ids.distinct().withColumn("h", F.xxhash64("id")), "codec")
    if codec.select("h").distinct().count() != n:
        return None
    return codec


def _hashed(edges: DataFrame) -> DataFrame:
    return edges.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"))


def connected_components(nodes: DataFrame, edges: DataFrame, id_col: str = "lookup_id",
                         max_rounds: int = 64) -> DataFrame:
    """Weakly connected components; ``component_id`` = smallest id in the component.

    Runs on 64-bit hashes of the ids when they are collision-free on this graph
    (checked), then maps back: each component is labelled with its smallest
    original id. Otherwise it runs on the ids themselves.
    """
    edges = edges.select("src", "dst")
    codec = _hash_codec(edges, nodes.select(id_col))
    if codec is None:
        return _components_core(nodes, edges, id_col, max_rounds)
    comp = _components_core(codec.select(F.col("h").alias(id_col)), _hashed(edges), id_col, max_rounds)
    named = comp.join(codec.withColumnRenamed("h", id_col), id_col).select(
        F.col("id").alias(id_col), F.col("component_id").alias("_c"))
    label = named.groupBy("_c").agg(F.min(id_col).alias("component_id"))
    return (named.join(label, "_c").join(nodes.select(id_col), id_col, "left_semi")
            .select(id_col, "component_id"))


def cyclic_core(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Nodes left after repeatedly removing nodes without callers or callees
    among the remaining edges: the cycles and everything that lies between them.
    Runs on checked 64-bit hashes of the ids when collision-free."""
    edges = edges.select("src", "dst")
    codec = _hash_codec(edges)
    if codec is None:
        return _cyclic_core(edges, max_rounds)
    core = _cyclic_core(_hashed(edges), max_rounds)
    return core.join(codec.withColumnRenamed("h", "lookup_id"), "lookup_id") \
               .select(F.col("id").alias("lookup_id"))


# --------------------------------------------------------------- G13, R10
def critical_functions(graph: DataFrame, edges: DataFrame, max_depth: int = DEFAULT_CONTEXT_DEPTH,
                       id_col: str = "lookup_id") -> DataFrame:
    """Rank by dependents, then by transitive callers within ``max_depth`` hops, which
    are counted as sets of bits (``bitsets``), not as a row for each function and caller."""
    from callweave.operators.bitsets import reach_counts
    callers = (reach_counts(edges, graph, max_depth, reverse=True, id_col=id_col)
               .where(F.col("hops") > 0).groupBy(id_col)
               .agg(F.sum("functions").alias("transitive_callers")))
    g = (graph.select(id_col, "in_degree").join(callers, id_col, "left")
         .withColumn("transitive_callers", F.coalesce("transitive_callers", F.lit(0))))
    return global_dense_rank(g, ["in_degree", "transitive_callers"], [False, False],
                             "criticality_rank")


def graph_quality(graph: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Coverage % (nodes with any edge), average degree, component count."""
    q = graph.agg(
        F.round(100.0 * F.count_if((F.col("in_degree") + F.col("out_degree")) > 0)
                / F.count(F.lit(1)), 6).alias("coverage_pct"),
        F.round(F.avg("out_degree"), 6).alias("avg_out_degree"),
        F.round(F.avg(F.col("in_degree") + F.col("out_degree")), 6).alias("avg_degree"),
    )
    if components is not None:
        n = components.agg(F.countDistinct("component_id")).first()[0]  # one number
        q = q.withColumn("components", F.lit(n).cast("long"))
    return q


def depth_histogram(graph: DataFrame) -> DataFrame:
    """Nodes per depth level."""
    return graph.groupBy("depth_level").agg(F.count(F.lit(1)).alias("nodes"))
