"""Traversals: breadth-first levels, shortest and all simple paths, layered chains, cycles, depth, components.

Loops are rounds of joins on a frontier. Each round's state is a table in the
shared folder; visited nodes leave by an anti-join, so cyclic graphs end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..storage import materialize, release


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    if direction == "down":
        return edges
    return edges.withColumnsRenamed({"src": "_s", "dst": "_d"}).withColumnsRenamed({"_s": "dst", "_d": "src"})


def bfs_levels(edges: DataFrame, origins: DataFrame, direction: str = "down", max_depth: int | None = None) -> DataFrame:
    """``origin, node, level``: least number of hops from each origin (column ``id``), level 0 being itself.

    All origins advance together, keyed by origin.
    """
    hop = _directed(edges, direction).select("src", "dst").distinct()
    seen = materialize(origins.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.lit(0).alias("level")).distinct(), "bfs")
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(hop, frontier["node"] == hop["src"]).select("origin", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen, ["origin", "node"], "left_anti").withColumn("level", F.lit(depth)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``path, hops`` of the lexicographically least of the shortest paths; no row if there is none.

    Each round keeps one path a node: of least hops, and least among those.
    """
    spark = edges.sparkSession
    hop = edges.select("src", "dst").distinct()
    seen = spark.createDataFrame([(src, [src])], "node string, path array<string>")
    frontier = seen = materialize(seen, "path")
    while frontier.where(F.col("node") == dst).isEmpty():
        step = frontier.join(hop, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        step = step.groupBy("node").agg(F.min("path").alias("path"))
        frontier = materialize(step.join(seen, "node", "left_anti"), "path")
        if frontier.isEmpty():
            return frontier.select("path", F.lit(0).alias("hops"))
        seen = seen.unionByName(frontier)
    return frontier.where(F.col("node") == dst).select("path", (F.size("path") - 1).alias("hops"))


def path_cost(confidence: Column) -> Column:
    """1 / confidence; a missing one counts as 0.5, one that is not positive costs 100."""
    c = F.coalesce(confidence, F.lit(config.PATH_DEFAULT_CONFIDENCE))
    return F.when(c > 0, 1 / c).otherwise(F.lit(config.NON_POSITIVE_COST))


def weighted_distances(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """``origin, node, cost, path``: cheapest paths by Bellman-Ford rounds; ties go to the least path."""
    hop = edges.groupBy("src", "dst").agg(F.min(path_cost(F.col("confidence"))).alias("w"))
    best = materialize(origins.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.lit(0.0).alias("cost"), F.array("id").alias("path")), "dist")
    changed = table = best
    while True:
        step = changed.join(hop, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"), F.round(F.col("cost") + F.col("w"), 9).alias("cost"), F.array_append("path", F.col("dst")).alias("path"))
        both = best.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False)))
        new = both.groupBy("origin", "node").agg(F.min(F.struct("cost", "path")).alias("b"), F.min(F.when(F.col("old"), F.struct("cost", "path"))).alias("o"))
        new = materialize(new.select("origin", "node", "b.cost", "b.path", (F.col("o").isNull() | (F.col("b") < F.col("o"))).alias("is_new")), "dist")
        release(table)
        table = new
        changed = new.where("is_new").drop("is_new")
        best = new.drop("is_new")
        if changed.isEmpty():
            return best


def simple_paths(edges: DataFrame, origins: DataFrame, max_length: int, target: Column | None = None) -> DataFrame:
    """``path, hops`` of simple paths from ``origins`` of at most ``max_length`` edges, as many as there are; none for a length under 1.

    Paths grow with the graph's fan-out to the power of the length: callers
    bound the length or the origins. With ``target`` (a condition on ``node``) paths end at their first arrival
    there and only these are returned.
    """
    hop = edges.select("src", "dst").distinct()
    frontier = origins.select(F.col("id").alias("node"), F.array("id").alias("path"))
    found = frontier.limit(0)
    for _ in range(max_length):
        step = frontier.join(hop, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = materialize(step.select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")), "paths")
        found = found.unionByName(step if target is None else step.where(target))
        frontier = step if target is None else step.where(~target)
        if frontier.isEmpty():
            break
    return found.select("path", (F.size("path") - 1).alias("hops"))


def call_chains(edges: DataFrame, nodes: DataFrame, start: str, end: str | None = None, max_depth: int = config.CHAIN_DEPTH, max_paths: int = config.MAX_PATHS) -> DataFrame:
    """``path, node_types, edge_types, depth`` in path order, at most ``max_paths``; without ``end`` the direct edges of ``start``.

    Depth is clamped to the hard limit; a limit on paths that is not positive
    becomes the default.
    """
    max_paths = max_paths if max_paths > 0 else config.MAX_PATHS
    spark = edges.sparkSession
    origin = spark.createDataFrame([(start,)], "id string")
    if end is None:
        paths = simple_paths(edges.where(F.col("src") == start), origin, 1)
    else:
        paths = simple_paths(edges, origin, min(max_depth, config.HARD_DEPTH), F.col("node") == end)
    paths = paths.orderBy("path").limit(max_paths)
    types = edges.groupBy("src", "dst").agg(F.sort_array(F.collect_set("relation")).alias("types"))
    hops = paths.select("path", F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as src, path[i] as dst))")).alias("k", "e"))
    hops = hops.join(types, (F.col("e.src") == F.col("src")) & (F.col("e.dst") == F.col("dst")), "left")
    hops = hops.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("types", F.array(F.lit("unknown"))).alias("types")))).alias("h"))
    named = paths.select("path", F.posexplode("path").alias("k", "id")).join(nodes.select("id", "type"), "id", "left")
    named = named.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("k", "type"))).alias("n"))
    return paths.join(named, "path").join(hops, "path").select("path", F.col("n.type").alias("node_types"), F.col("h.types").alias("edge_types"), F.col("hops").alias("depth")).orderBy("path")


def neighbours_with_depth(edges: DataFrame, nodes: DataFrame, origins: DataFrame, direction: str, max_depth: int) -> DataFrame:
    """``origin, node, type, depth, relation, confidence``: transitive predecessors (up) or successors (down), direct ones at depth 0.

    Relation and confidence are those of the edge by which a node is first
    reached; ties go to the least relation and neighbour.
    """
    levels = materialize(bfs_levels(edges, origins, direction, max_depth), "levels")
    hop = _directed(edges, direction)
    near = levels.select("origin", F.col("node").alias("src"), (F.col("level") + 1).alias("level"))
    via = near.join(hop, "src").select("origin", F.col("dst").alias("node"), "level", F.struct("relation", "src", "confidence").alias("e"))
    first = levels.where("level > 0").join(via, ["origin", "node", "level"]).groupBy("origin", "node", "level").agg(F.min("e").alias("e"))
    out = first.join(nodes.select(F.col("id").alias("node"), "type"), "node", "left")
    return out.select("origin", "node", "type", (F.col("level") - 1).alias("depth"), "e.relation", "e.confidence")


def dependency_chains(edges: DataFrame, nodes: DataFrame, origins: DataFrame, layers: tuple[tuple[str, ...], ...]) -> DataFrame:
    """``path, length``: walks over successors whose type is of the next layer, ended where none is."""
    spark = edges.sparkSession
    order = spark.createDataFrame([(i, t) for i, ts in enumerate(layers) for t in ts], "layer int, type string")
    typed = nodes.select("id", "type").join(F.broadcast(order), "type").select("id", "layer")
    hop = edges.select("src", "dst").distinct().join(typed.select(F.col("id").alias("dst"), F.col("layer").alias("to_layer")), "dst")
    frontier = origins.select("id").join(typed, "id").select(F.col("id").alias("node"), "layer", F.array("id").alias("path"))
    ended = None
    for _ in layers:
        nxt = frontier.join(hop, (F.col("node") == F.col("src")) & (F.col("to_layer") == F.col("layer") + 1), "left")
        nxt = materialize(nxt, "chains")
        done = nxt.where("dst is null").select("path")
        ended = done if ended is None else ended.unionByName(done)
        frontier = nxt.where("dst is not null").select(F.col("dst").alias("node"), F.col("to_layer").alias("layer"), F.array_append("path", F.col("dst")).alias("path"))
    return ended.unionByName(frontier.select("path")).select("path", F.size("path").alias("length"))


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``origin, node``: every pair with a path of one edge or more; semi-naive rounds."""
    hop = edges.select("src", "dst").distinct()
    seen = frontier = materialize(hop.select(F.col("src").alias("origin"), F.col("dst").alias("node")), "closure")
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(hop, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen, ["origin", "node"], "left_anti"), "closure")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def trim_acyclic(edges: DataFrame) -> DataFrame:
    """The edges that can lie on a cycle: nodes without predecessors or successors go, round by round."""
    left = materialize(edges.select("src", "dst").distinct(), "trim")
    n = left.count()
    while True:
        both = left.select(F.col("src").alias("id")).distinct().join(left.select(F.col("dst").alias("id")).distinct(), "id")
        kept = left.join(both.withColumnRenamed("id", "src"), "src", "left_semi").join(both.withColumnRenamed("id", "dst"), "dst", "left_semi")
        kept = materialize(kept, "trim")
        m = kept.count()
        release(left)
        if m == n or not m:
            return kept
        left, n = kept, m


def _least_reaching(edges: DataFrame) -> DataFrame:
    """``node, colour``: the least node that reaches it (itself included); only nodes whose colour fell tell their successors."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    state = materialize(ends.select("node", F.col("node").alias("colour"), F.lit(True).alias("fell")), "colour")
    while True:
        told = state.where("fell").join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("colour").alias("c"))
        nxt = state.join(told, F.col("node") == F.col("dst"), "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.coalesce("c", "colour") < F.col("colour")).alias("fell"))
        nxt = materialize(nxt, "colour")
        release(state)
        state = nxt
        if state.where("fell").isEmpty():
            return state


def cycle_members(edges: DataFrame) -> DataFrame:
    """``node, component``: nodes on a cycle and the least node of their strongly connected component.

    By colours, with one row a node as state: every node takes the least node
    that reaches it; what reaches the colour's own node along edges of one
    colour is its component; components leave, and the rest is trimmed and
    coloured again. A self-loop is a cycle.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    left, found = trim_acyclic(edges), None
    while not left.isEmpty():
        colours = _least_reaching(left).select("node", "colour")
        near = left.join(colours.withColumnsRenamed({"node": "src", "colour": "a"}), "src").join(colours.withColumnsRenamed({"node": "dst", "colour": "b"}), "dst")
        back = materialize(near.where("a = b").select(F.col("dst").alias("_d"), F.col("src").alias("_s"), F.col("a").alias("component")), "scc-edges")
        part = frontier = materialize(colours.where("node = colour").select("node", F.col("colour").alias("component")), "scc")
        while not frontier.isEmpty():
            step = frontier.join(back, (F.col("node") == F.col("_d")) & (frontier["component"] == back["component"])).select(F.col("_s").alias("node"), back["component"]).distinct()
            frontier = materialize(step.join(part, "node", "left_anti"), "scc")
            part = part.unionByName(frontier)
        release(back)
        part = materialize(part, "scc")
        sizes = part.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        real = part.join(sizes, "component", "left_semi").unionByName(part.join(loops, "node", "left_semi").join(sizes, "component", "left_anti"))
        found = real if found is None else found.unionByName(real)
        done = part.select("node")
        rest = left.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti")
        rest = trim_acyclic(rest)
        release(left)
        left = rest
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    return found.select("node", "component")


def cycle_paths(edges: DataFrame, max_length: int = config.CHAIN_DEPTH) -> DataFrame:
    """``path, hops`` of the elementary cycles of at most ``max_length`` edges, each once, from its least node and back to it.

    Only edges within strongly connected components are walked, and only over
    nodes greater than the start.
    """
    members = materialize(cycle_members(edges), "cycle-members")
    own = edges.select("src", "dst").distinct().join(members.withColumnsRenamed({"node": "src", "component": "a"}), "src").join(members.withColumnsRenamed({"node": "dst", "component": "b"}), "dst")
    hop = materialize(own.where("a = b").select("src", "dst"), "cycle-edges")
    frontier = members.select(F.col("node").alias("start"), "node", F.array("node").alias("path"))
    found = frontier.limit(0).select("path")
    for k in range(max_length):
        step = frontier.join(hop, F.col("node") == F.col("src"))
        step = materialize(step.where((F.col("dst") == F.col("start")) | (F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")), "cycles")
        found = found.unionByName(step.where("node = start").select("path"))
        frontier = step.where("node <> start")
        if frontier.isEmpty():
            break
    return found.select("path", (F.size("path") - 1).alias("hops"))


def dag_depth(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, depth``: longest path to a leaf (a leaf: 0); null for nodes that reach a cycle.

    Leaves go first. Each round sends the newly settled depths along their
    in-edges and settles the nodes all of whose successors have reported; only
    open nodes are carried on.
    """
    hop = materialize(edges.select("src", "dst").distinct(), "depth-edges")
    waiting = materialize(hop.groupBy("src").agg(F.count("*").alias("left"), F.lit(0).alias("best")), "depth")
    fresh = nodes.select(F.col("id").alias("node")).join(waiting, F.col("node") == F.col("src"), "left_anti").withColumn("depth", F.lit(0))
    settled = fresh = materialize(fresh, "depth")
    table = waiting
    while True:
        told = hop.join(fresh, F.col("dst") == F.col("node")).groupBy("src").agg(F.count("*").alias("k"), (F.max("depth") + 1).alias("d"))
        waiting = waiting.join(told, "src", "left").select("src", (F.col("left") - F.coalesce("k", F.lit(0))).alias("left"), F.greatest("best", F.coalesce("d", F.lit(0))).alias("best"))
        waiting = materialize(waiting, "depth")
        fresh = materialize(waiting.where("left = 0").select(F.col("src").alias("node"), F.col("best").alias("depth")), "depth")
        release(table)
        table = waiting
        if fresh.isEmpty():
            return nodes.select(F.col("id").alias("node")).join(settled, "node", "left")
        settled = settled.unionByName(fresh)
        waiting = waiting.where("left > 0")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component``: least id of the undirected component.

    Large-star and small-star steps in turn: each keeps, of a node's
    neighbours, the least, and points the others at it, so the depth of the
    graph halves or better; neighbours are reduced by partial aggregation and
    never gathered. The end is seen by the edges' count and checksum. Rounds
    run on numbers in the order of the ids.
    """
    every = nodes.select("id").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("id"))).where("id is not null").distinct()
    ids = materialize(every.orderBy("id").withColumn("k", F.monotonically_increasing_id()), "cc-ids")
    links = edges.select("src", "dst").join(ids.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst")
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    state, before = materialize(links, "cc"), None
    while True:
        mark = tuple(state.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).head())
        if mark == before:
            break
        before = mark
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = materialize(nxt, "cc")
        release(state, large)
        state = nxt
    labels = state.join(ids.select(F.col("id").alias("component"), F.col("k").alias("v")), "v").select(F.col("u").alias("k"), "component")
    own = ids.join(nodes.select("id").distinct(), "id", "left_semi")
    return own.join(labels, "k", "left").select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component"))
