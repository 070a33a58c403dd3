"""Tag co-occurrence networks: edges and nodes as DataFrames.

Edges are undirected, written (a, b) with a < b, and weighted by distinct posts. Measures
that look at the whole graph go over the edge table in rounds; no task holds the graph.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import scratch
from . import numbering


def pairs(tags: DataFrame, key: str = "id", tag: str = "tag") -> DataFrame:
    """(key, a, b): the tag pairs of each post, built inside the post's own tag array (a post holds few tags)."""
    sets = tags.groupBy(key).agg(F.sort_array(F.collect_set(tag)).alias("_t")).where(F.size("_t") > 1)
    both = F.flatten(F.transform("_t", lambda x, i: F.transform(F.slice(F.col("_t"), i + 2, F.size("_t")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(key, F.explode(both).alias("p")).select(key, "p.a", "p.b")


def edges(pairs_: DataFrame, *by: str) -> DataFrame:
    """(by, a, b, weight)."""
    return pairs_.groupBy(*by, "a", "b").agg(F.count("*").alias("weight"))


def ego(tags: DataFrame, center: str, key: str = "id", tag: str = "tag") -> DataFrame:
    """The tags of posts that hold the center tag."""
    return tags.join(tags.where(F.col(tag) == center).select(key), key, "left_semi")


def node_counts(tags: DataFrame, *by: str, key: str = "id", tag: str = "tag") -> DataFrame:
    return tags.groupBy(*by, tag).agg(F.count_distinct(key).alias("n"))


def jaccard(edge_list: DataFrame, nodes: DataFrame, tag: str = "tag") -> DataFrame:
    """edge_list with n_a, n_b and weight / (n_a + n_b - weight)."""
    out = edge_list.join(nodes.select(F.col(tag).alias("a"), F.col("n").alias("n_a")), "a", "left").join(nodes.select(F.col(tag).alias("b"), F.col("n").alias("n_b")), "b", "left")
    return out.withColumn("jaccard", F.try_divide("weight", F.col("n_a") + F.col("n_b") - F.col("weight")))


def ends(edge_list: DataFrame) -> DataFrame:
    """(node, other, weight): each edge from both sides."""
    return edge_list.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "weight"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))).alias("x")).select("x.*")


def degrees(edge_list: DataFrame) -> DataFrame:
    return ends(edge_list).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def summary(edge_list: DataFrame) -> DataFrame:
    """(nodes, edges, density, mean_weight)."""
    d = degrees(edge_list).agg(F.count("*").alias("nodes"))
    e = edge_list.agg(F.count("*").alias("edges"), F.avg("weight").alias("mean_weight"))
    density = F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1))
    return e.join(d).select("nodes", "edges", density.alias("density"), "mean_weight")


def clustering(edge_list: DataFrame) -> DataFrame:
    """(node, clustering): closed pairs of neighbours over all pairs; 0 below two neighbours.

    Edges are led from the node of fewer neighbours to that of more, so no node begins more
    than sqrt(2 * edges) of them and a hub's neighbours are not paired with each other.
    """
    k = degrees(edge_list).select("node", "degree")
    side = lambda c: k.select(F.col("node").alias(c), F.struct("degree", "node").alias(f"_{c}"))
    led = edge_list.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    e = led.select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v"))
    wedges = e.alias("x").join(e.alias("y"), F.col("x.u") == F.col("y.u")).where(F.col("x.v") < F.col("y.v"))
    wedges = wedges.select(F.col("x.u").alias("m"), F.col("x.v").alias("u"), F.col("y.v").alias("v"))
    hits = wedges.join(e, ["u", "v"]).select(F.explode(F.array("m.node", "u.node", "v.node")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    k = k.join(hits, "node", "left").fillna(0, ["t"])
    return k.select("node", F.when(F.col("degree") < 2, 0.0).otherwise(F.try_divide(2.0 * F.col("t"), F.col("degree") * (F.col("degree") - 1))).alias("clustering"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def eigenvector(edge_list: DataFrame, rounds: int = 1000, tolerance: float = 1e-9, step: int = 4) -> DataFrame:
    """(node, centrality) by power iteration on A + I, unit length.

    A round is the product of the edge table and the node table: a join on one end and a sum by the other.
    Every `step` rounds the vector is written, and the driver gets two numbers, its length and how far it has moved;
    it stops below tolerance per node. A network without an edge has no row.
    """
    sides = ends(edge_list).select("node", "other", F.col("weight").cast("double").alias("w"))
    own = sides.select("node", F.col("node").alias("other"), F.lit(1.0).alias("w")).distinct()
    both = kept(sides.unionByName(own).groupBy("node", "other").agg(F.sum("w").alias("w")), "edges")
    now = both.where("node = other").select("node", F.lit(1.0).alias("c"))
    n, length = now.count(), 1.0
    for _ in range(0, rounds if n else 0, step):
        new = now
        for _ in range(step):
            new = both.join(new.select(F.col("node").alias("other"), "c"), "other").groupBy("node").agg(F.sum(F.col("w") * F.col("c")).alias("c"))
        new = kept(new, "vector")
        length = new.agg(F.sqrt(F.sum(F.col("c") * F.col("c")))).first()[0]
        new = new.select("node", (F.col("c") / length).alias("c"))
        far = new.join(now.withColumnRenamed("c", "_was"), "node").agg(F.sum(F.abs(F.col("c") - F.col("_was")))).first()[0]
        now = new
        if far <= n * tolerance:
            break
    return now.withColumnRenamed("c", "centrality")


def _moves(both: DataFrame, degree: DataFrame, members: DataFrame, total: float) -> DataFrame:
    """(node, to): moves of nodes to other groups that gain modularity and are the best one for both groups."""
    links = both.join(members.select(F.col("node").alias("o"), F.col("community").alias("c")), "o").groupBy("node", "c").agg(F.sum("w").alias("w"))
    sums = members.join(degree, "node").groupBy(F.col("community").alias("c")).agg(F.sum("d").alias("dc"))
    own = members.join(degree, "node").join(links.withColumnsRenamed({"c": "community", "w": "inside"}), ["node", "community"], "left").join(sums.withColumnsRenamed({"c": "community", "dc": "dh"}), "community")
    options = links.join(own, "node").where("c != community").join(sums, "c")
    gain = (F.col("w") - F.coalesce("inside", F.lit(0.0))) / total - F.col("d") * (F.col("dc") - F.col("dh") + F.col("d")) / (2 * total * total)
    options = options.select("node", "community", "c", gain.alias("gain")).where("gain > 1e-12")
    best = options.select(F.explode(F.array("community", "c")).alias("g"), F.struct((-F.col("gain")).alias("loss"), "node", "c").alias("p")).groupBy("g").agg(F.min("p").alias("p"))
    return best.groupBy("p.node", F.col("p.c").alias("to")).agg(F.count("*").alias("n")).where("n = 2").drop("n")


def communities(edge_list: DataFrame, moves: int = 30) -> DataFrame:
    """(node, community): groups of high modularity, numbered by size, then by their first node.

    In every round all pairs of groups that are each other's best gain in modularity merge at once (of equal gains the
    pair of the first names), and the edge table is summed up by group; it ends when no pair gains. Nodes
    with one neighbour join it before the first round, where they are best in any case. The best pair
    of all is always such a pair, so each round merges at least one. Then single nodes move in up to `moves` rounds, at most
    one out of and one into a group in each, so that gains add up. Only counts pass the driver.
    """
    e = edge_list.where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").cast("double").alias("w"))
    e = kept(e, "edges")
    half = lambda x: x.select(F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("o"), "w"), F.struct(F.col("b").alias("g"), F.col("a").alias("o"), "w"))).alias("x")).select("x.*")
    degree = kept(half(e).groupBy(F.col("g").alias("node")).agg(F.sum("w").alias("d"), F.count("*").alias("k"), F.min("o").alias("o")), "degrees")
    both, total = half(e).withColumnRenamed("g", "node"), e.agg(F.sum("w")).first()[0] or 1.0
    # A node with one neighbour goes to it; of two such nodes that have each other the first stays.
    one = degree.where("k = 1").select(F.col("node").alias("g"), "o")
    pairs_ = one.join(one.select(F.col("g").alias("o"), F.lit(True).alias("_both")), "o", "left").where("_both IS NULL OR o < g")
    merges = pairs_.select("g", F.col("o").alias("to"))
    members, step = degree.select("node", F.col("node").alias("community")), 0
    degree = degree.select("node", "d")
    while True:
        merges, step = kept(merges, "merges"), step + 1
        to = lambda c, name: merges.select(F.col("g").alias(c), F.col("to").alias(name))
        if step > 1 and not merges.count():
            break
        # What lies inside a group stays as its own edge, so that its degree remains the sum of its edges' ends.
        e = e.join(to("a", "_a"), "a", "left").join(to("b", "_b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "w")
        e = kept(e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")), "edges")
        members = members.join(to("community", "_c"), "community", "left").select("node", F.coalesce("_c", "community").alias("community"))
        members = members if step % 8 else kept(members, "members")
        d = half(e).groupBy("g").agg(F.sum("w").alias("d"))
        side = lambda c: d.select(F.col("g").alias(c), F.col("d").alias(f"d{c}"))
        gains = e.where("a != b").join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("w") / total - F.col("da") * F.col("db") / (2 * total * total)).alias("gain")).where("gain > 0")
        best = gains.select(F.explode(F.array("a", "b")).alias("g"), F.struct((-F.col("gain")).alias("loss"), "a", "b").alias("p")).groupBy("g").agg(F.min("p").alias("p"))
        mutual = best.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where("n = 2")
        merges = mutual.select(F.col("b").alias("g"), F.col("a").alias("to"))
    members = kept(members, "members")
    for _ in range(moves):
        better = kept(_moves(both, degree, members, total), "moves")
        if not better.count():
            break
        members = kept(members.join(better, "node", "left").select("node", F.coalesce("to", "community").alias("community")), "members")
    sizes = members.groupBy("community").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    numbers = numbering.numbered(sizes, [F.col("n").desc(), F.col("first")], "number").select("community", F.col("number").cast("int").alias("number"))
    return members.join(numbers, "community").select("node", F.col("number").alias("community"))


def modularity(edge_list: DataFrame, member: DataFrame) -> DataFrame:
    """One row: Σ over communities of inner weight / m - (degree / 2m)²."""
    side = lambda c, n: member.select(F.col("node").alias(c), F.col("community").alias(n))
    rows = edge_list.join(side("a", "ca"), "a").join(side("b", "cb"), "b")
    per = rows.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "weight", F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0).alias("inner")), F.struct(F.col("cb").alias("c"), "weight", F.lit(0).cast("long").alias("inner")))).alias("x")).select("x.*")
    per = per.groupBy("c").agg(F.sum("weight").alias("d"), F.sum("inner").alias("i"))
    total = per.agg((F.sum("d") / 2).alias("m"))
    return per.join(F.broadcast(total)).agg(F.sum(F.col("i") / F.col("m") - (F.col("d") / (2 * F.col("m"))) ** 2).alias("modularity"))


def induced(edge_list: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among nodes (node)."""
    return edge_list.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", "weight")


def pair_lifecycle(pairs_: DataFrame, before: Column, after: Column) -> DataFrame:
    """(a, b, lifecycle): 1 retained, 2 new, 0 gone."""
    p = pairs_.groupBy("a", "b").agg(F.bool_or(before).alias("_b"), F.bool_or(after).alias("_a"))
    return p.select("a", "b", F.when(F.col("_b") & F.col("_a"), 1).when(F.col("_a"), 2).otherwise(0).alias("lifecycle"))
