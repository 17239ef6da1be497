"""Degree, centrality, impact, coverage and summary figures of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..storage import materialize, release
from . import traverse


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, in_degree, out_degree, degree``; a self-loop adds one to each side. One aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    per = ends.groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    out = nodes.select(F.col("id").alias("node")).join(per, "node", "left")
    zero = F.lit(0).cast("long")
    out = out.select("node", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def type_weight(type_col: Column, weights: dict[str, int] = config.TYPE_WEIGHTS) -> Column:
    out = F.lit(1)
    for w in sorted(set(weights.values())):
        out = F.when(type_col.isin([t for t, v in weights.items() if v == w]), F.lit(w)).otherwise(out)
    return out


def severity(score: Column) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


def impact_scores(reached: DataFrame, nodes: DataFrame, origins: DataFrame, weights: dict[str, int] = config.TYPE_WEIGHTS) -> DataFrame:
    """``origin, affected, score, severity`` from ``reached`` (origin, node): mean type weight of what an origin reaches, over 5, in percent."""
    typed = reached.join(nodes.select(F.col("id").alias("node"), "type"), "node")
    per = typed.groupBy("origin").agg(F.count("*").alias("affected"), F.sum(type_weight(F.col("type"), weights)).alias("w"))
    raw = F.coalesce(F.col("w") / (F.col("affected") * 5) * 100, F.lit(0.0))
    out = origins.select(F.col("id").alias("origin")).join(per, "origin", "left")
    return out.select("origin", F.coalesce("affected", F.lit(0).cast("long")).alias("affected"), F.round(raw, 2).alias("score"), severity(raw).alias("severity"))


#: Reached nodes of one origin that are held as one array; origins that may reach more, or reach a cycle, go by pairs.
MOST_REACHED = 100_000
#: Members of arrays that one step puts together, so that its shuffle is bounded.
STEP_MEMBERS = 100_000_000


def reached_by_arrays(ids: DataFrame, hop: DataFrame, kinds: list[int], most: int, step: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables ``k, affected, w, r`` of the nodes that reach at most about ``most`` nodes and no cycle, and ``s, d, w`` of the edges from all others.

    Nodes are done from the sinks up: once all that a node points to is done,
    what it reaches is the union of their arrays and themselves, so each edge
    is used once. A member is a node's number times the number of weights
    (``kinds``), plus its weight's place; nodes that nothing points to get no
    array, since nobody asks for it.
    """
    weight = F.array(*[F.lit(x).cast("long") for x in kinds])
    code = F.col("d") * len(kinds) + F.array_position(weight, F.col("w")) - 1
    asked = materialize(hop.select(F.col("d").alias("k")).distinct(), "impact-asked")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    sinks = ids.join(hop.select(F.col("s").alias("k")).distinct(), "k", "left_anti")
    done = [materialize(sinks.select("k", zero.alias("affected"), zero.alias("w"), none.alias("r")), "impact-reached")]
    left = hop
    while True:
        sizes = reduce(DataFrame.unionByName, [x.select(F.col("k").alias("d"), "affected") for x in done])
        known = left.join(sizes, "d", "left").groupBy("s").agg(F.count("affected").alias("n"), F.count("*").alias("of"), F.sum(F.col("affected") + 1).alias("members"))
        ready = materialize(known.where((F.col("n") == F.col("of")) & (F.col("members") <= most)).select("s", "members"), "impact-ready")
        members = ready.agg(F.sum("members")).head()[0]
        if members is None:
            release(ready, asked)
            return done, left
        parts = -(-members // step)
        reached = reduce(DataFrame.unionByName, [x.where("r is not null").select(F.col("k").alias("d"), "r") for x in done])
        for part in range(parts):
            now = left.join(ready.where(F.pmod(F.xxhash64("s"), F.lit(parts)) == part).select("s"), "s", "left_semi")
            each = now.join(reached, "d").select("s", F.concat(F.array(code), "r").alias("r"))
            whole = each.groupBy(F.col("s").alias("k")).agg(F.array_distinct(F.flatten(F.collect_list("r"))).alias("r"))
            counted = whole.select("k", F.size("r").cast("long").alias("affected"), F.aggregate("r", zero, lambda n, x: n + F.get(weight, F.pmod(x, F.lit(len(kinds))).cast("int"))).alias("w"), "r")
            kept = counted.join(asked.withColumn("asked", F.lit(True)), "k", "left").withColumn("r", F.when(F.col("asked"), F.col("r"))).drop("asked")
            done.append(materialize(kept, "impact-reached"))
        after = materialize(left.join(ready.select("s"), "s", "left_anti"), "impact-left")
        release(ready, left)
        left = after


def impact_of_all(nodes: DataFrame, edges: DataFrame, weights: dict[str, int] = config.TYPE_WEIGHTS, direction: str = "down", most: int = MOST_REACHED, step: int = STEP_MEMBERS) -> DataFrame:
    """``impact_scores`` of every node over everything that it reaches.

    Nodes are numbered. What a node reaches is an array where it is bounded and
    without cycles (``reached_by_arrays``); the other origins, those above a
    cycle or over ``most``, go by rounds over pairs of longs. For a few origins
    use ``traverse.bfs_levels`` and ``impact_scores``.
    """
    ids = materialize(nodes.select("id", "type").dropDuplicates(["id"]).select("id", type_weight(F.col("type"), weights).cast("long").alias("w"), F.monotonically_increasing_id().alias("k")), "impact-ids")
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    hop = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a <> _b").distinct()
    hop = hop.join(ids.select(F.col("id").alias("_a"), F.col("k").alias("s")), "_a").join(ids.select(F.col("id").alias("_b"), F.col("k").alias("d"), "w"), "_b")
    hop = materialize(hop.select("s", "d", "w"), "impact-edges")
    arrays, left = reached_by_arrays(ids, hop.select("s", "d", "w"), sorted({1, *weights.values()}), most, step)
    per = reduce(DataFrame.unionByName, [x.select("k", "affected", "w") for x in arrays])
    seen = frontier = left.select(F.col("s").alias("o"), F.col("d").alias("n"), "w")
    while not frontier.isEmpty():
        ahead = frontier.join(hop.select("s", "d", F.col("w").alias("x")), F.col("n") == F.col("s")).where("o <> d").select("o", F.col("d").alias("n"), F.col("x").alias("w"), F.lit(0).alias("old"))
        # one aggregation in place of a distinct and an anti-join: pairs that no earlier round has
        both = ahead.unionByName(seen.withColumn("old", F.lit(1)))
        frontier = materialize(both.groupBy("o", "n").agg(F.max("w").alias("w"), F.max("old").alias("old")).where("old = 0").drop("old"), "impact")
        seen = seen.unionByName(frontier)
    per = per.unionByName(seen.groupBy(F.col("o").alias("k")).agg(F.count("*").alias("affected"), F.sum("w").alias("w")))
    out = ids.select("id", "k").join(per, "k", "left")
    raw = F.coalesce(F.col("w") / F.nullif(F.col("affected") * 5, F.lit(0)) * 100, F.lit(0.0))
    return out.select(F.col("id").alias("origin"), F.coalesce("affected", F.lit(0).cast("long")).alias("affected"), F.round(raw, 2).alias("score"), severity(raw).alias("severity"))


def sampled(nodes: DataFrame, sources: int | None) -> DataFrame:
    """All nodes, or the ``sources`` first by a hash of their id: the origins of a centrality."""
    return nodes if sources is None else nodes.orderBy(F.xxhash64("id"), "id").limit(sources)


def betweenness(edges: DataFrame, nodes: DataFrame, sources: int | None = None) -> DataFrame:
    """``node, betweenness``: directed, over (n-1)(n-2). Brandes' counts for all sources at once, level by level, then back.

    Exact by default: nodes times nodes of state, for graphs of that size. With
    ``sources`` (an extension) the paths of so many origins are counted and
    scaled up, with nodes times ``sources`` of state.
    """
    hop = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "btw")
    n = nodes.count()
    origins = sampled(nodes, sources)
    levels = [materialize(origins.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.lit(1.0).alias("paths")), "btw")]
    seen = levels[0].select("origin", "node")
    while True:
        step = levels[-1].join(hop, F.col("node") == F.col("src")).groupBy("origin", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        nxt = materialize(step.join(seen, ["origin", "node"], "left_anti"), "btw")
        if nxt.isEmpty():
            break
        levels.append(nxt)
        seen = seen.unionByName(nxt.select("origin", "node"))
    later, total = None, None
    for lower, upper in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        own = upper.withColumn("share", F.lit(0.0)) if later is None else upper.join(later, ["origin", "node"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        through = own.select("origin", F.col("node").alias("dst"), ((1 + F.col("share")) / F.col("paths")).alias("unit")).join(hop, "dst").select("origin", F.col("src").alias("node"), "unit")
        later = materialize(lower.join(through, ["origin", "node"]).groupBy("origin", "node").agg(F.sum(F.col("paths") * F.col("unit")).alias("share")), "btw")
        total = later if total is None else total.unionByName(later)
    base = nodes.select(F.col("id").alias("node"))
    scale = (n - 1) * (n - 2) * (1.0 if sources is None else min(1.0, sources / max(1, n)))
    if total is None or scale <= 0:
        return base.withColumn("betweenness", F.lit(0.0))
    per = total.where("origin <> node").groupBy("node").agg((F.sum("share") / scale).alias("betweenness"))
    return base.join(per, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def closeness(edges: DataFrame, nodes: DataFrame, sources: int | None = None) -> DataFrame:
    """``node, closeness``: from incoming distances, scaled by the share of nodes that reach it.

    Exact by default; with ``sources`` (an extension) from the distances of so many origins.
    """
    n = nodes.count() if sources is None else sources + 1
    far = traverse.bfs_levels(edges, sampled(nodes, sources)).where("level > 0").groupBy("node").agg(F.count("*").alias("r"), F.sum("level").alias("d"))
    out = nodes.select(F.col("id").alias("node")).join(far, "node", "left")
    return out.select("node", F.coalesce(F.col("r") / F.lit(max(1, n - 1)) * F.col("r") / F.col("d"), F.lit(0.0)).alias("closeness"))


def critical_nodes(nodes: DataFrame, edges: DataFrame, top_n: int = 10, weights: dict[str, int] = config.TYPE_WEIGHTS) -> DataFrame:
    """``node, degree, betweenness, impact, criticality``: the ``top_n`` by 0.3 degree + 30 betweenness + 0.4 impact; ties by node."""
    reach = traverse.bfs_levels(edges, nodes).where("level > 0").select("origin", "node")
    score = impact_scores(reach, nodes, nodes, weights).select(F.col("origin").alias("node"), F.col("score").alias("impact"))
    out = degrees(nodes, edges).select("node", "degree").join(betweenness(edges, nodes), "node").join(score, "node")
    out = out.withColumn("criticality", F.round(0.3 * F.col("degree") + 30 * F.col("betweenness") + 0.4 * F.col("impact"), 2))
    return out.orderBy(F.desc("criticality"), "node").limit(top_n)


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees, neighbours and centralities (4 places) of every node."""
    preds = edges.groupBy(F.col("dst").alias("node")).agg(F.array_join(F.sort_array(F.collect_set("src")), ",").alias("predecessors"))
    succs = edges.groupBy(F.col("src").alias("node")).agg(F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("successors"))
    out = degrees(nodes, edges).join(preds, "node", "left").join(succs, "node", "left").join(betweenness(edges, nodes), "node").join(closeness(edges, nodes), "node")
    none = F.lit("")
    return out.select("node", "in_degree", "out_degree", "degree", F.coalesce("predecessors", none).alias("predecessors"), F.coalesce("successors", none).alias("successors"), F.round("betweenness", 4).alias("betweenness"), F.round("closeness", 4).alias("closeness"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, density (4 places), mean degree (2 places), largest degree, components and their largest size."""
    cc = traverse.components(edges, nodes).groupBy("component").agg(F.count("*").alias("s")).agg(F.count("*").alias("components"), F.max("s").alias("largest"))
    n = nodes.agg(F.count("*").alias("n"), F.countDistinct("type").alias("types"))
    m = edges.agg(F.count("*").alias("m"), F.countDistinct("relation").alias("relations"))
    top = degrees(nodes, edges).agg(F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("orphans"), F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") > 0)).alias("sources"), F.count_if((F.col("out_degree") == 0) & (F.col("in_degree") > 0)).alias("sinks"))
    out = n.crossJoin(m).crossJoin(top).crossJoin(cc)  # one row each
    density = F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(F.lit(0.0))
    mean = F.when(F.col("n") > 0, 2 * F.col("m") / F.col("n")).otherwise(F.lit(0.0))
    return out.select("n", "m", "types", "relations", F.round(density, 4).alias("density"), F.round(mean, 2).alias("average_degree"), "max_degree", "orphans", "sources", "sinks", "components", "largest")


def coverage(nodes: DataFrame, edges: DataFrame, rules: list[tuple[str, str | None]]) -> DataFrame:
    """``type, total, covered, ratio`` (2 places): nodes of a type with an out-edge of the relation, or any if None."""
    relations = edges.groupBy("src").agg(F.collect_set("relation").alias("relations"))
    with_out = nodes.select("id", "type").join(relations, F.col("id") == F.col("src"), "left")
    has = F.lit(False)
    for t, relation in rules:
        ok = F.col("relations").isNotNull() if relation is None else F.coalesce(F.array_contains("relations", relation), F.lit(False))
        has = F.when(F.col("type") == t, ok).otherwise(has)
    out = with_out.where(F.col("type").isin([t for t, _ in rules])).groupBy("type").agg(F.count("*").alias("total"), F.count_if(has).alias("covered"))
    return out.withColumn("ratio", F.round(F.col("covered") / F.col("total"), 2))


def confidence_bands(edges: DataFrame) -> DataFrame:
    """``band, edges``: high from 0.9, medium from 0.7, low; always three rows. A missing confidence is 1."""
    c = F.coalesce("confidence", F.lit(1.0))
    one = edges.agg(F.count_if(c >= config.HIGH_CONFIDENCE).alias("high"), F.count_if((c < config.HIGH_CONFIDENCE) & (c >= config.MEDIUM_CONFIDENCE)).alias("medium"), F.count_if(c < config.MEDIUM_CONFIDENCE).alias("low"))
    return one.unpivot([], ["high", "medium", "low"], "band", "edges")
