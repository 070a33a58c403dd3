"""Distribution functions, solvers and identities."""

import math

import numpy as np
import pytest

from tidelens.functions import dist
from tidelens.operators import closed, smooth, solve


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (dist.normal_p(1.959963985), 0.05),
        (dist.t_p(2.228138852, 10), 0.05),
        (dist.t_p(12.70620474, 1), 0.05),
        (dist.f_p(4.964602744, 1, 10), 0.05),
        (dist.f_p(3.10587524, 5, 12), 0.05),
        (dist.chi2_p(3.841458821, 1), 0.05),
        (dist.chi2_p(18.30703805, 10), 0.05),
        (dist.chi2_p(0.5, 3), 0.91889),
        (1 - dist.t_p(dist.t_quantile(0.975, 7), 7) / 2, 0.975),
        (dist.t_quantile(0.975, 1e6), 1.959966),
        (dist.t_quantile(0.025, 7), -2.364624),
    ],
)
def test_known_values(got, want):
    assert math.isclose(got, want, rel_tol=2e-5)


def series(seed=1, n=60):
    rng = np.random.default_rng(seed)
    t = np.arange(-n // 2, n // 2)
    return t, 1 + 0.01 * t + 0.3 * (t >= 0) + 0.02 * np.maximum(t, 0) + rng.normal(size=n) * 0.1


def test_saturated_model_is_two_lines(spark):
    t, y = series()
    df = spark.createDataFrame([("a", int(i), float(v)) for i, v in zip(t, y, strict=True)], "g string, t int, y double")
    r = closed.its_points(df, ["g"]).first()
    beta, e, bread, x = solve.solve(solve.its_design(t.astype(float)), y)
    assert np.allclose([r.const, r.pre_trend, r.level, r.slope], beta)
    rows = {x.term: x for x in solve.its(df, "g", cov="classical").collect()}
    s2 = e @ e / (len(y) - 4)
    assert np.allclose([rows[k].se for k in solve.ITS_TERMS], np.sqrt(np.diag(bread) * s2))
    pooled = closed.pooled_points(df, "g").first()
    assert np.allclose([pooled.pre_trend, pooled.level, pooled.slope], beta[1:])


def test_covariances_agree_in_special_cases():
    t, y = series()
    _, e, bread, x = solve.solve(solve.its_design(t.astype(float)), y)
    white = bread @ (x * e[:, None]).T @ (x * e[:, None]) @ bread
    assert np.allclose(solve.hac(x, e, bread, 0), white)
    assert (np.diag(solve.hc3(x, e, bread)) > np.diag(white)).all()


def test_adding_a_constant_moves_the_intercept_only(spark):
    t, y = series()
    df = spark.createDataFrame([("a", int(i), float(v), float(v + 7)) for i, v in zip(t, y, strict=True)], "g string, t int, y double, z double")
    a, b = ({r.term: r for r in solve.its(df, "g", c).collect()} for c in ("y", "z"))
    assert math.isclose(b["const"].coef - a["const"].coef, 7, rel_tol=1e-9)
    assert all(math.isclose(a[k].coef, b[k].coef, abs_tol=1e-9) and math.isclose(a[k].se, b[k].se, rel_tol=1e-6) for k in ("time", "post", "post_time"))


def test_did_is_the_triple_interaction(spark):
    rng = np.random.default_rng(4)
    rows = [(int(t), bool(g), float(rng.normal() + 0.1 * t * g)) for t in range(-20, 20) for g in (0, 1)]
    r = closed.did(spark.createDataFrame(rows, "t int, g boolean, y double"), [], "y", "t", __import__("pyspark").sql.functions.col("g")).first()
    t, g, y = (np.array([x[i] for x in rows], float) for i in range(3))
    p = (t >= 0).astype(float)
    beta, e, bread, _ = solve.solve(np.c_[np.ones(len(t)), t, p, g, t * p, t * g, p * g, t * p * g], y)
    assert math.isclose(r.effect, beta[7], rel_tol=1e-8)
    assert math.isclose(r.se, math.sqrt(bread[7, 7] * (e @ e) / (len(y) - 8)), rel_tol=1e-8)


def test_short_and_degenerate_series(spark):
    rows = [("one", 0, 1.0), *(("flat", t, 2.0) for t in range(-5, 5)), *(("null", t, None) for t in range(-5, 5))]
    df = spark.createDataFrame(rows, "g string, t int, y double")
    assert {r.g for r in solve.its(df, "g").collect()} == {"flat"}
    assert closed.ols(df, ["g"], "y", "t").count() == 3
    assert closed.chow(df, ["g"], "y", "t", __import__("pyspark").sql.functions.col("t") < 0).count() == 3
    with pytest.raises(ValueError, match="covariance"):
        solve.its(df, "g", cov="none")


def by_the_book(x, y, share, rounds):
    """Each row against all others."""
    n = len(x)
    k, robust, out = min(n, max(2, int(share * n + 1e-10))), np.ones(n), y.copy()
    for r in range(rounds + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            near = np.argsort(d, kind="stable")[:k]
            w = np.clip(1 - (d[near] / max(d[near].max(), 1e-12)) ** 3, 0, 1) ** 3 * robust[near]
            if w.sum() <= 0:
                continue
            xm, ym = w @ x[near] / w.sum(), w @ y[near] / w.sum()
            sxx = w @ (x[near] - xm) ** 2
            out[i] = ym + (w @ ((x[near] - xm) * (y[near] - ym)) / sxx if sxx > 1e-12 else 0.0) * (x[i] - xm)
        if r < rounds:
            s = 6 * np.median(np.abs(y - out))
            robust = np.clip(1 - (np.abs(y - out) / s) ** 2, 0, 1) ** 2 if s > 0 else np.ones(n)
    return out


def test_smoother(spark):
    """Lines stay; uneven places, ties and an outlier are as by the book; groups of other sizes do not matter."""
    rng = np.random.default_rng(8)
    x = np.sort(np.r_[rng.uniform(0, 30, 45), [3.0, 3.0, 3.0]])
    y = np.sin(x / 4) + rng.normal(size=len(x)) * 0.1
    y[20] = 9.0
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    rows = [("line", float(i), 2.0 * i + 1) for i in range(30)] + [("wave", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("one", 1.0, 5.0), ("none", 1.0, None)]
    got = smooth.lowess(spark.createDataFrame(rows, "g string, x double, y double").repartition(3), "g", "x", "y", 0.3, 2).collect()
    assert all(math.isclose(r.smooth, 2 * r.x + 1, abs_tol=1e-8) for r in got if r.g == "line") and [r.smooth for r in got if r.g == "one"] == [5.0]
    want = by_the_book(x, y, 0.3, 2)
    assert np.allclose(sorted(r.smooth for r in got if r.g == "wave"), np.sort(want), atol=1e-9) and len(got) == 79
