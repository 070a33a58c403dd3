"""Measures of whole networks against dense matrices and against greedy merging in plain Python."""

import math

import numpy as np
import pytest

from tidelens.operators import network


def frame(spark, edges):
    return spark.createDataFrame([(*sorted(p), int(w)) for p, w in edges.items()], "a string, b string, weight long")


def blocks(seed, sizes, inside, outside):
    rng = np.random.default_rng(seed)
    group = [g for g, n in enumerate(sizes) for _ in range(n)]
    out = {}
    for i in range(len(group)):
        for j in range(i + 1, len(group)):
            if rng.random() < (inside if group[i] == group[j] else outside):
                out[f"n{i:03d}", f"n{j:03d}"] = rng.integers(1, 4)
    return out


def ring(cliques, size):
    out = {(f"c{c:02d}{i}", f"c{c:02d}{j}"): 1 for c in range(cliques) for i in range(size) for j in range(i + 1, size)}
    return out | {(f"c{c:02d}0", f"c{(c + 1) % cliques:02d}1"): 1 for c in range(cliques)}


FIXTURES = {
    "blocks": blocks(1, (12, 9, 15, 7), 0.6, 0.05),
    "ring": ring(8, 5),
    "hubs": blocks(2, (10, 10), 0.7, 0.1) | {(f"n00{h}", f"leaf{h}{i:02d}"): 1 for h in (0, 1) for i in range(30)} | {("far1", "far2"): 3},
}


def matrix(edges):
    names = sorted({x for p in edges for x in p})
    m = np.zeros((len(names), len(names)))
    for (a, b), w in edges.items():
        m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = w
    return names, m


def quality(edges, group):
    names, m = matrix(edges)
    g = np.array([group[n] for n in names])
    k = m.sum(1)
    return float(((m - np.outer(k, k) / k.sum()) * (g[:, None] == g)).sum() / k.sum())


def greedy(edges):
    """The best pair of all, again and again."""
    names, m = matrix(edges)
    e = m / m.sum()
    groups = {i: [n] for i, n in enumerate(names)}
    while len(groups) > 1:
        alive = sorted(groups)
        gain, i, j = max((2 * (e[i, j] - e[i].sum() * e[j].sum()), -i, -j) for i in alive for j in alive if i < j)
        if gain <= 0:
            break
        i, j = -i, -j
        groups[i] += groups.pop(j)
        e[i] += e[j]
        e[:, i] += e[:, j]
        e[j] = 0
        e[:, j] = 0
    return {n: c for c, g in groups.items() for n in g}


@pytest.mark.parametrize("name", FIXTURES)
def test_communities(spark, name):
    edges = FIXTURES[name]
    df = frame(spark, edges)
    got = network.communities(df).collect()
    group = {r.node: r.community for r in got}
    assert len(got) == len(group) == len(matrix(edges)[0])
    assert quality(edges, group) >= quality(edges, greedy(edges)) - 0.01
    assert math.isclose(network.modularity(df, spark.createDataFrame(got)).first().modularity, quality(edges, group), abs_tol=1e-9)
    sizes = [sum(c == k for c in group.values()) for k in range(max(group.values()) + 1)]
    assert sizes == sorted(sizes, reverse=True) and min(sizes) > 0
    if name == "ring":
        assert {r.node: r.community for r in network.communities(df.repartition(5)).collect()} == group
    if name == "hubs":
        assert group["far1"] == group["far2"] and all(group[f"leaf0{i:02d}"] == group["n000"] for i in range(30))


def test_eigenvector(spark):
    edges = blocks(4, (8, 9), 0.6, 0.3)
    names, m = matrix(edges)
    v = np.abs(np.linalg.eigh(m)[1][:, -1])
    got = {r.node: r.centrality for r in network.eigenvector(frame(spark, edges), tolerance=1e-8, step=10).collect()}
    assert set(got) == set(names) and all(math.isclose(got[n], x, abs_tol=1e-6) for n, x in zip(names, v, strict=True))


def test_network_without_edges(spark):
    none = spark.createDataFrame([], "a string, b string, weight long")
    assert network.eigenvector(none).collect() == [] and network.communities(none).collect() == []


def test_numbering_over_several_ranges(spark):
    from pyspark.sql import functions as F

    from tidelens.operators import numbering

    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("x"), F.lit(1).alias("other")).repartition(6)
    rows = sorted((r.x, r.at) for r in numbering.numbered(df, [F.col("x")], "at").collect())
    assert [a for _, a in rows] == list(range(1000))
    down = sorted((r.at, r.x) for r in numbering.numbered(df, [F.col("x").desc()], "at").collect())
    assert [x for _, x in down] == sorted((x for x, _ in rows), reverse=True)
