"""Company graphs as edge DataFrames (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cols import total, with_totals
from ..session import reliable

c = F.col


def similarity_edges(nodes: DataFrame, cols: list[str], segment: str, threshold: float = 0.5) -> DataFrame:
    """.5 same segment + .3 max(0, corr of the metric vectors) + .2 x .5 for all node pairs above the threshold.

    Nodes of different segments (or none) reach .4 at most, so above that threshold only nodes of one segment
    are paired.  At .4 or below the result itself is all pairs: the caller asks for it with the threshold.
    """
    k = len(cols)
    m = total([c(x) for x in cols]) / k
    z = nodes.select("node", segment, *[(c(x) - m).alias(x) for x in cols])
    z = z.withColumn("_n", F.sqrt(total([c(x) * c(x) for x in cols])))
    a = z.select(c("node").alias("src"), c(segment).alias("_sa"), c("_n").alias("_na"), *[c(x).alias(f"_a{i}") for i, x in enumerate(cols)])
    b = z.select(c("node").alias("dst"), c(segment).alias("_sb"), c("_n").alias("_nb"), *[c(x).alias(f"_b{i}") for i, x in enumerate(cols)])
    same = (c("_sa") == c("_sb")) if threshold > 0.4 else F.lit(True)
    p = a.join(b, same & (c("src") < c("dst")))
    r = F.coalesce(total([c(f"_a{i}") * c(f"_b{i}") for i in range(k)]) / F.nullif(c("_na") * c("_nb"), F.lit(0.0)), F.lit(0.0))
    w = F.when(c("_sa") == c("_sb"), 0.5).otherwise(0.0) + 0.3 * F.greatest(r, F.lit(0.0)) + 0.1
    return p.select("src", "dst", w.alias("weight")).where(c("weight") > threshold)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(c("dst").alias("src"), c("src").alias("dst"), "weight"))


def degree(edges: DataFrame) -> DataFrame:
    """Degree, strength and degree centrality of nodes with at least one edge."""
    g = both_ways(edges).groupBy(c("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    return with_totals(g, g.agg(F.count(F.lit(1)).alias("_n"))).withColumn("centrality", c("degree") / F.nullif(c("_n") - 1, F.lit(0))).drop("_n")


def density(edges: DataFrame, n_nodes: DataFrame) -> DataFrame:
    n = n_nodes.agg(F.count(F.lit(1)).cast("double").alias("n"))
    return with_totals(edges.agg(F.count(F.lit(1)).alias("edges")), n).withColumn("density", 2 * c("edges") / F.nullif(c("n") * (c("n") - 1), F.lit(0.0)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components by minimum label with label jumping, until nothing changes; lineage is cut every round.

    Labels are combined with min on the map side, so a hub never gathers its
    neighbours in one task.
    """
    e = reliable(both_ways(edges).select("src", "dst"))
    lab = reliable(e.groupBy(c("src").alias("node")).agg(F.least(F.min("dst"), F.min("src")).alias("label")))
    while True:
        near = e.join(lab, e.dst == c("node")).groupBy("src").agg(F.min("label").alias("_m"))
        nxt = lab.join(near, lab.node == near.src, "left").select("node", F.least(c("label"), F.coalesce("_m", "label")).alias("label"))
        # jump: take the label of the label
        up = nxt.select(c("node").alias("_l"), c("label").alias("_ll"))
        nxt = reliable(nxt.join(up, c("label") == c("_l"), "left").select("node", F.least(c("label"), F.coalesce("_ll", "label")).alias("label")))
        changed = nxt.join(lab.withColumnRenamed("label", "_o"), "node").where(c("label") != c("_o")).limit(1).count()
        lab = nxt
        if changed == 0:
            return lab


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles per node and clustering coefficient; edges point from lower to higher degree, so that
    every wedge starts at its lowest-degree corner and hubs emit few pairs."""
    d = degree(edges).select("node", "degree")
    a = edges.join(d.select(c("node").alias("src"), c("degree").alias("_ds")), "src").join(d.select(c("node").alias("dst"), c("degree").alias("_dd")), "dst")
    up = (c("_ds") < c("_dd")) | ((c("_ds") == c("_dd")) & (c("src") < c("dst")))
    o = a.select(F.when(up, c("src")).otherwise(c("dst")).alias("u"), F.when(up, c("dst")).otherwise(c("src")).alias("v"))
    w = o.alias("x").join(o.alias("y"), c("x.u") == c("y.u")).where(c("x.v") < c("y.v")).select(c("x.u").alias("u"), c("x.v").alias("v"), c("y.v").alias("w"))
    o2 = o.select(F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b"))
    t = w.join(o2, (c("v") == c("_a")) & (c("w") == c("_b")))
    per = t.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    j = d.join(per, "node", "left").na.fill(0, ["triangles"])
    return j.withColumn("clustering", F.when(c("degree") > 1, 2 * c("triangles") / (c("degree") * (c("degree") - 1))).otherwise(0.0))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Modularity of a node partition from within-group weight and group degree sums."""
    m = edges.agg(F.sum("weight").alias("m"))
    a = membership.select(c("node").alias("src"), c("label").alias("_a"))
    b = membership.select(c("node").alias("dst"), c("label").alias("_b"))
    ins = edges.join(a, "src").join(b, "dst").where(c("_a") == c("_b")).groupBy(c("_a").alias("label")).agg(F.sum("weight").alias("_in"))
    deg = degree(edges).select("node", "strength").join(membership, "node").groupBy("label").agg(F.sum("strength").alias("_d"))
    g = with_totals(deg.join(ins, "label", "left"), m)
    return g.agg(F.sum(F.coalesce(c("_in"), F.lit(0.0)) / c("m") - F.pow(c("_d") / (2 * c("m")), F.lit(2.0))).alias("modularity"), F.count(F.lit(1)).alias("groups"))


def eigenvector(edges: DataFrame, rounds: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """Eigenvector centrality by power iteration joins (shifted by the identity, so that it converges on
    bipartite graphs as well).

    Done when no entry has moved by ``tolerance`` in four rounds; raises if ``rounds`` do not suffice.
    """
    e = reliable(both_ways(edges))
    x = last = reliable(e.select(c("src").alias("node")).distinct().withColumn("x", F.lit(1.0)))
    for i in range(rounds):
        s = e.join(x, e.dst == x.node).groupBy(c("src").alias("_n")).agg(F.sum(c("weight") * c("x")).alias("_s"))
        y = x.join(s, x.node == c("_n"), "left").select("node", (c("x") + F.coalesce(c("_s"), F.lit(0.0))).alias("x"))
        x = with_totals(y, y.agg(F.sqrt(F.sum(c("x") * c("x"))).alias("_l"))).select("node", (c("x") / c("_l")).alias("x"))
        if i % 4 == 3:
            x = reliable(x)
            moved = x.join(last.withColumnRenamed("x", "_o"), "node").agg(F.max(F.abs(c("x") - c("_o"))).alias("m")).first()["m"]
            if moved is None or moved < tolerance:
                return x.withColumnRenamed("x", "eigenvector")
            last = x
    raise RuntimeError(f"eigenvector centrality has not settled in {rounds} rounds")
