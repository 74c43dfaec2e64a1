"""Correlation networks as joins over an edge table (P-45 to P-50, P-61).

``edges``: x, y, rho (one row per unordered pair). Iterations write each round to the
checkpoint folder, so a plan never grows and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.operators.scan import attach, with_group_aggs
from colloquy.session import cut


def both_ways(edges: DataFrame) -> DataFrame:
    ab = edges.select(F.col("x").alias("a"), F.col("y").alias("b"), F.abs("rho").alias("w"), "rho")
    return ab.unionByName(ab.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "rho"))


def network_edges(corr: DataFrame, min_rho: float, max_p: float | None = None, min_n: int = 3) -> DataFrame:
    """P-45: edges strong, significant and supported enough."""
    e = corr.where((F.abs("rho") >= min_rho) & (F.col("n") >= min_n) & (F.col("x") != F.col("y")))
    return e if max_p is None else e.where(F.col("p") <= max_p)


def degrees(edges: DataFrame) -> DataFrame:
    """P-45: degree and weighted degree."""
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("weighted_degree"))


def network_summary(edges: DataFrame) -> DataFrame:
    """P-45: nodes, edges, density, share of positive edges."""
    e = edges.agg(F.count("*").alias("n_edges"), F.avg((F.col("rho") > 0).cast("double")).alias("positive_share"))
    n = both_ways(edges).agg(F.countDistinct("a").alias("n_nodes"))
    o = attach(e, n, [])
    return o.withColumn("density", F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """P-46: smallest node name reachable. Labels also jump to their label's label, so
    the number of rounds follows the logarithm of the longest path."""
    e = edges.select(F.col("x").alias("a"), F.col("y").alias("b"))
    e = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    ids = e.select(F.col("a").alias("node")).distinct()
    ids = ids if nodes is None else ids.unionByName(nodes).distinct()
    lab = cut(ids.withColumn("component", F.col("node")))
    while True:
        near = e.join(lab.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_n"))
        nxt = lab.join(near, "node", "left").select("node", F.col("component").alias("_old"), F.least("component", "_n").alias("component"))
        jump = lab.select(F.col("node").alias("component"), F.col("component").alias("_j"))
        nxt = cut(nxt.join(jump, "component").select("node", "_old", F.least("component", "_j").alias("component")))
        if nxt.where("component != _old").isEmpty():
            return nxt.select("node", "component")
        lab = nxt.select("node", "component")


def hop_distance(edges: DataFrame, source: str) -> DataFrame:
    """P-46: number of edges from one node (reached nodes only)."""
    e = cut(both_ways(edges).select("a", "b"))
    seen = cut(e.where(F.col("a") == source).select(F.col("a").alias("node")).distinct().withColumn("hops", F.lit(0)))
    front, h = seen, 0
    while not front.isEmpty():
        h += 1
        nxt = front.select(F.col("node").alias("a")).join(e, "a").select(F.col("b").alias("node")).distinct()
        front = cut(nxt.join(seen, "node", "left_anti").withColumn("hops", F.lit(h)))
        seen = cut(seen.unionByName(front))
    return seen


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """P-47: weighted clustering (geometric mean of triangle weights over the largest).

    Each triangle is found once from its smallest two edges: edges point from the node of
    lower degree, so a hub does not list all pairs of its neighbours.
    """
    d = degrees(edges).select("node", "degree")
    e = with_group_aggs(edges.select("x", "y", F.abs("rho").alias("w")), [], _mx=F.max("w"))
    e = e.withColumn("w", F.col("w") / F.col("_mx")).drop("_mx")
    e = e.join(d.select(F.col("node").alias("x"), F.col("degree").alias("dx")), "x").join(d.select(F.col("node").alias("y"), F.col("degree").alias("dy")), "y")
    up = F.struct("dx", "x") < F.struct("dy", "y")
    o = cut(e.select(F.when(up, F.col("x")).otherwise(F.col("y")).alias("u"), F.when(up, F.col("y")).otherwise(F.col("x")).alias("v"), "w"))
    p, q, r = (o.select(F.col("u").alias(a), F.col("v").alias(b), F.col("w").alias(c)) for a, b, c in (("u", "v", "w1"), ("u", "z", "w2"), ("v", "z", "w3")))
    tri = p.join(q, "u").join(r, ["v", "z"]).select(F.explode(F.array("u", "v", "z")).alias("node"), F.pow(F.col("w1") * F.col("w2") * F.col("w3"), F.lit(1 / 3)).alias("g"))
    t = tri.groupBy("node").agg(F.sum("g").alias("g"), F.count("*").alias("triangles"))
    o = d.join(t, "node", "left").na.fill(0, ["g", "triangles"])
    k = F.col("degree")
    return o.select("node", "degree", "triangles", F.when(k > 1, 2.0 * F.col("g") / (k * (k - 1))).otherwise(0.0).alias("clustering"))


def eigenvector_centrality(edges: DataFrame, rounds: int = 100, tol: float = 1e-9) -> DataFrame:
    """P-48: weighted power iteration on A + I, unit length, until no entry moves by ``tol`` or more.

    ``residual`` is the largest move of the last round and ``converged`` tells whether it is below ``tol``.
    """
    e = cut(both_ways(edges).select("a", "b", "w"))
    v = cut(e.select(F.col("a").alias("node")).distinct().withColumn("c", F.lit(1.0)))
    gap = None
    for _ in range(rounds):
        s = e.join(v.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node")).agg(F.sum(F.col("w") * F.col("c")).alias("_s"))
        n = v.join(s, "node").select("node", F.col("c").alias("_old"), (F.col("c") + F.col("_s")).alias("c"))
        n = with_group_aggs(n, [], _l=F.sqrt(F.sum(F.col("c") ** 2))).select("node", "_old", (F.col("c") / F.col("_l")).alias("c"))
        n = cut(n)
        gap = n.agg(F.max(F.abs(F.col("c") - F.col("_old")))).first()[0]
        v = n.select("node", "c")
        if gap is None or gap < tol:
            break
    done = gap is None or gap < tol
    return v.select("node", F.col("c").alias("eigenvector"), F.lit(gap).cast("double").alias("residual"), F.lit(done).alias("converged"))


def bridge_nodes(edges: DataFrame, family: DataFrame) -> DataFrame:
    """P-49: edges and weight of each node to other families. ``family``: node, family."""
    e = both_ways(edges).join(family.select(F.col("node").alias("a"), F.col("family").alias("fa")), "a")
    e = e.join(family.select(F.col("node").alias("b"), F.col("family").alias("fb")), "b").where("fa != fb")
    return e.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("cross_edges"), F.sum("w").alias("cross_weight"), F.countDistinct("fb").alias("n_families"))


def communities(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """P-50: label propagation; a node takes the heaviest label around it, smallest on ties.

    Own label counts with the node's mean edge weight, which stops two-cycles. Longer cycles
    are possible, so ``converged`` tells whether the labels were stable before ``rounds``.
    """
    e = cut(both_ways(edges).select("a", "b", "w"))
    self_w = e.groupBy("a").agg(F.avg("w").alias("w")).select(F.col("a"), F.col("a").alias("b"), "w")
    e = cut(e.unionByName(self_w))
    lab = cut(e.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    done = False
    for _ in range(rounds):
        votes = e.join(lab.select(F.col("node").alias("b"), "community"), "b").groupBy("a", "community").agg(F.round(F.sum("w"), 9).alias("v"))
        best = votes.groupBy(F.col("a").alias("node")).agg(F.min_by("community", F.struct(-F.col("v"), F.col("community"))).alias("_n"))
        n = cut(lab.join(best, "node").select("node", F.col("community").alias("_old"), F.col("_n").alias("community")))
        done = n.where("community != _old").isEmpty()
        lab = n.select("node", "community")
        if done:
            break
    return lab.withColumn("converged", F.lit(done))


def ranked_nodes(measures: DataFrame, measure: str, k: int) -> DataFrame:
    """P-61: the k highest nodes of a measure."""
    return measures.orderBy(F.desc(measure), "node").limit(k).select("node", measure)
