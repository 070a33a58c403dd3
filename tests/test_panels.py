"""Panel models from merged sums, against the whole design matrix in numpy."""

import math

import numpy as np
import pandas as pd
import pytest

from tidelens.functions import dist
from tidelens.operators import panels, solve


def cluster(x, e, bread, groups):
    names, at = np.unique(groups, return_inverse=True)
    u = np.zeros((len(names), x.shape[1]))
    np.add.at(u, at, x * e[:, None])
    g, n, k = len(names), len(e), np.linalg.matrix_rank(x)
    return bread @ (u.T @ u) @ bread * (g / (g - 1)) * ((n - 1) / (n - k))


def by_time(x, e, bread, time, lags):
    names, at = np.unique(time, return_inverse=True)
    u = np.zeros((len(names), x.shape[1]))
    np.add.at(u, at, x * e[:, None])
    return solve.hac(u, np.ones(len(u)), bread, lags)


def pooled(p, weights=None, lags=8):
    p = p.dropna().sort_values(["g", "t"])
    t = p.t.to_numpy(float)
    x0 = np.c_[solve.its_design(t), pd.get_dummies(p.g, drop_first=True).to_numpy(float)]
    beta, e, bread, x = solve.solve(x0, p.y.to_numpy(float), p.n.to_numpy(float) if weights else None)
    return beta, {"cluster": cluster(x, e, bread, p.g.to_numpy()), "hac": solve.hac(x, e, bread, lags), "driscoll_kraay": by_time(x, e, bread, t, lags)}


def study(p, weights=None, ref=-1):
    p = p.dropna().sort_values(["g", "bin"])
    bins = sorted(set(p["bin"]) - {ref})
    x0 = np.c_[np.ones(len(p)), (p["bin"].to_numpy()[:, None] == np.array(bins)).astype(float), pd.get_dummies(p.g, drop_first=True).to_numpy(float)]
    beta, e, bread, x = solve.solve(x0, p.y.to_numpy(float), p.n.to_numpy(float) if weights else None)
    se = np.sqrt(np.diag(cluster(x, e, bread, p.g.to_numpy())))
    return {b: (beta[k + 1], se[k + 1]) for k, b in enumerate(bins)}


def unbalanced(seed=2, groups=9, reach=40):
    """Entities of different spans, one of them shorter than the lags, one null value."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        low, high = -rng.integers(10, reach), rng.integers(10, reach)
        shock = rng.normal()
        for t in range(low, high) if g != 4 else range(-2, 2):
            if rng.random() < 0.85 or t == -1:
                rows.append((f"g{g}", t, float(1 + shock + 0.01 * t + 0.2 * (t >= 0) + rng.normal() * 0.3), int(rng.integers(1, 50))))
    rows.append(("g1", 99, None, 3))
    return pd.DataFrame(rows, columns=["g", "t", "y", "n"]).assign(y=lambda d: d.y.astype(object).where(d.y.notna(), None))


def frame(spark, p):
    return spark.createDataFrame([tuple(r) for r in p.itertuples(index=False)], "g string, t int, y double, n int" + (", bin int" if "bin" in p else ""))


@pytest.mark.parametrize("weights", [None, "n"])
@pytest.mark.parametrize("block", [10_000, 40])
def test_pooled(spark, monkeypatch, weights, block):
    """Also with lag windows of few rows, over several entities' ends."""
    monkeypatch.setattr(panels, "BLOCK", block)
    p = unbalanced()
    beta, covs = pooled(p, weights)
    got = {(r["cov"], r.term): r for r in panels.pooled(frame(spark, p), "g", weights=weights).collect()}
    assert len(got) == 12
    for name, c in covs.items():
        for i, term in enumerate(panels.TERMS):
            r = got[name, term]
            assert math.isclose(r.coef, beta[i], rel_tol=1e-8) and math.isclose(r.se, math.sqrt(c[i, i]), rel_tol=1e-8), (name, term)
            assert math.isclose(r.z, r.coef / r.se) and math.isclose(r.p, dist.normal_p(r.z), rel_tol=1e-9, abs_tol=1e-300)


def test_effect_curve(spark):
    p = unbalanced(5)
    beta, covs = pooled(p)
    c = covs["cluster"]
    for log in (True, False):
        for r in panels.effect_curve(frame(spark, p), "g", [-8, 0, 12], log=log).collect():
            d = (r.t >= 0) * (beta[2] + r.t * beta[3])
            se = math.sqrt((r.t >= 0) * (c[2, 2] + r.t**2 * c[3, 3] + 2 * r.t * c[2, 3]))
            want = (math.expm1(d) * 100, 100 * math.exp(d) * se) if log else (d, se)
            assert math.isclose(r.effect, want[0], rel_tol=1e-8, abs_tol=1e-12) and math.isclose(r.se, want[1], rel_tol=1e-8, abs_tol=1e-12)


@pytest.mark.parametrize("weights", [None, "n"])
def test_studies_on_an_unbalanced_panel(spark, weights):
    p = unbalanced(7).assign(bin=lambda d: d.t // 5)
    whole, rows = study(p, weights), frame(spark, p)

    def check(got, want):
        assert {r.bin for r in got} == {*want, -1}
        for r in got:
            if r.bin == -1:
                assert (r.coef, r.se, r.z, r.p) == (0, 0, 0, 1)
            elif want[r.bin][1] > 1e-9:
                assert math.isclose(r.coef, want[r.bin][0], rel_tol=1e-7, abs_tol=1e-9) and math.isclose(r.se, want[r.bin][1], rel_tol=1e-7)

    check(panels.studies(rows, [], "g", "bin", weights=weights).collect(), whole)
    out = panels.studies(rows, [], "g", "bin", weights=weights, left_out=True).collect()
    names = sorted(set(p.g))
    assert sorted({r.left_out for r in out}) == names
    for g in names[:4]:
        rest = p[p.g != g]
        check([r for r in out if r.left_out == g and (r.bin == -1 or r.bin in set(rest.dropna()["bin"]))], study(rest, weights))
    half = p.assign(bin=lambda d: d.t // 9)
    two = rows.selectExpr("1 AS m", "g", "bin", "y", "n").union(frame(spark, half).selectExpr("2 AS m", "g", "bin", "y", "n"))
    both = panels.studies(two, ["m"], "g", "bin", weights=weights).collect()
    check([r for r in both if r.m == 1], whole)
    check([r for r in both if r.m == 2], study(half, weights))


def test_empty_and_degenerate_panels(spark):
    none = spark.createDataFrame([], "g string, t int, y double, n int, bin int")
    assert panels.pooled(none, "g").collect() == [] and panels.effect_curve(none, "g", [0, 1]).collect() == []
    assert panels.studies(none, [], "g", "bin").collect() == [] and panels.studies(none, [], "g", "bin", left_out=True).collect() == []
    one = spark.createDataFrame([("a", t, 1.0 + t, 1, t) for t in range(-3, 3)], "g string, t int, y double, n int, bin int")
    flat = {r.bin: r for r in panels.studies(one, [], "g", "bin").collect()}
    assert len(flat) == 6 and math.isclose(flat[2].coef, 3.0)
    line = {(r["cov"], r.term): r for r in panels.pooled(one, "g").collect()}
    assert math.isclose(line["hac", "time"].coef, 1.0) and abs(line["hac", "time"].se) < 1e-9


def test_inverse_of_singular_matrices(spark):
    from pyspark.sql import functions as F

    a = np.array([[4.0, 2, 0], [2, 3, 0], [0, 0, 0]])
    got = spark.createDataFrame([(a.tolist(),)], "a array<array<double>>").select(panels.inverse(F.col("a")).alias("i")).first().i
    want = np.zeros((3, 3))
    want[:2, :2] = np.linalg.inv(a[:2, :2])
    assert np.allclose(got, want)


def test_normal_p_as_an_expression(spark):
    from pyspark.sql import functions as F

    z = [0.0, 1e-9, 0.5, 1.959963985, -2.8, 2.83, 6.0, -9.5, 37.0]
    got = spark.createDataFrame([(v,) for v in z] + [(None,)], "z double").select("z", dist.normal_p_col(F.col("z")).alias("p")).collect()
    assert all(r.p is None if r.z is None else math.isclose(r.p, dist.normal_p(r.z), rel_tol=1e-12) for r in got)
