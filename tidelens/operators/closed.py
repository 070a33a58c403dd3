"""Estimators in closed form: plain aggregates, so Catalyst plans them and SQL can check them.

A regression on a saturated indicator is one line per segment, and its residual sum of
squares is syy * (1 - r2); so interrupted series, Chow tests and differences of
differences need one pass with conditional regr_* aggregates and no design matrix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import Z95


def line(y: Column, x: Column, prefix: str = "", when: Column | None = None) -> list[Column]:
    """Aggregates of a simple regression, as {prefix}n, slope, icpt, xm, sxx, rss (over rows where `when` holds)."""
    if when is not None:
        y = F.when(when, y)
    y, x = y.cast("double"), x.cast("double")
    r2 = F.coalesce(F.regr_r2(y, x), F.lit(0.0))
    return [
        F.regr_count(y, x).alias(f"{prefix}n"),
        F.regr_slope(y, x).alias(f"{prefix}slope"),
        F.regr_intercept(y, x).alias(f"{prefix}icpt"),
        F.regr_avgx(y, x).alias(f"{prefix}xm"),
        F.regr_sxx(y, x).alias(f"{prefix}sxx"),
        (F.regr_syy(y, x) * (1 - r2)).alias(f"{prefix}rss"),
        F.regr_r2(y, x).alias(f"{prefix}r2"),
    ]


def ols(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """(by, n, slope, icpt, r2, se, t): t has n - 2 degrees of freedom."""
    out = df.groupBy(*by).agg(*line(F.col(y), F.col(x)))
    se = F.sqrt(F.try_divide(F.try_divide("rss", F.col("n") - 2), F.col("sxx")))
    return out.withColumn("se", se).withColumn("t", F.try_divide("slope", "se"))


def wls(df: DataFrame, by: list[str], y: str, x: str, w: str) -> DataFrame:
    """(by, n, slope, icpt, se) of a weighted simple regression."""
    wx, yv, wv = F.col(x), F.col(y), F.col(w)
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(wv).alias("w"), F.sum(wv * wx).alias("wx"), F.sum(wv * yv).alias("wy"), F.sum(wv * wx * wx).alias("wxx"), F.sum(wv * wx * yv).alias("wxy"), F.sum(wv * yv * yv).alias("wyy"))
    sxx, sxy, syy = (F.col(a) - F.col(b) * F.col(c) / F.col("w") for a, b, c in (("wxx", "wx", "wx"), ("wxy", "wx", "wy"), ("wyy", "wy", "wy")))
    s = s.withColumn("sxx", sxx).withColumn("sxy", sxy).withColumn("syy", syy).withColumn("slope", F.try_divide("sxy", "sxx"))
    s = s.withColumn("icpt", (F.col("wy") - F.col("slope") * F.col("wx")) / F.col("w"))
    s = s.withColumn("se", F.sqrt(F.try_divide(F.try_divide(F.col("syy") - F.col("slope") * F.col("sxy"), F.col("n") - 2), F.col("sxx"))))
    return s.select(*by, "n", "slope", "icpt", "se")


def mean_se(x: Column, n: str = "n", xm: str = "xm", sxx: str = "sxx", rss: str = "rss") -> Column:
    """Standard error of the fitted mean at x."""
    return F.sqrt(F.col(rss) / (F.col(n) - 2) * (1 / F.col(n) + (x - F.col(xm)) ** 2 / F.col(sxx)))


def chow(df: DataFrame, by: list[str], y: str, x: str, before: Column) -> DataFrame:
    """(by, n_pre, n_post, f, df1, df2, level, slope change): is there a break between the rows where `before` holds and the rest?"""
    yc, xc = F.col(y), F.col(x)
    out = df.groupBy(*by).agg(*line(yc, xc, "a_"), *line(yc, xc, "b_", before), *line(yc, xc, "c_", ~before))
    split = F.col("b_rss") + F.col("c_rss")
    f = F.try_divide((F.col("a_rss") - split) / 2, F.try_divide(split, F.col("a_n") - 4))
    return out.select(
        *by,
        F.col("b_n").alias("n_pre"),
        F.col("c_n").alias("n_post"),
        f.alias("f"),
        F.lit(2).alias("df1"),
        (F.col("a_n") - 4).alias("df2"),
        (F.col("c_icpt") - F.col("b_icpt")).alias("level_change"),
        (F.col("c_slope") - F.col("b_slope")).alias("slope_change"),
    )


def its_points(df: DataFrame, by: list[str], y: str = "y", t: str = "t") -> DataFrame:
    """Coefficients of y ~ t + post + post·t per entity: (n_obs, const, pre_trend, level, slope)."""
    pre, post = F.col(t) < 0, F.col(t) >= 0
    out = df.groupBy(*by).agg(*line(F.col(y), F.col(t), "b_", pre), *line(F.col(y), F.col(t), "c_", post))
    return out.select(*by, (F.col("b_n") + F.col("c_n")).alias("n_obs"), F.col("b_icpt").alias("const"), F.col("b_slope").alias("pre_trend"), (F.col("c_icpt") - F.col("b_icpt")).alias("level"), (F.col("c_slope") - F.col("b_slope")).alias("slope"))


def pooled_points(df: DataFrame, entity: str, y: str = "y", t: str = "t") -> DataFrame:
    """One row: y ~ t + post + post·t with an effect per entity, by within-entity means (three regressors in normal equations)."""
    rows = df.select(entity, F.col(y).cast("double").alias("y"), F.col(t).cast("double").alias("x1"), (F.col(t) >= 0).cast("double").alias("x2"), (F.greatest(F.col(t), F.lit(0))).cast("double").alias("x3"))
    w = Window.partitionBy(entity)
    d = rows.select(*((F.col(c) - F.avg(c).over(w)).alias(c) for c in ("y", "x1", "x2", "x3")))
    names = ("x1", "x2", "x3")
    s = d.agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"s_{a}{b}") for i, a in enumerate(names) for b in names[i:]), *(F.sum(F.col(a) * F.col("y")).alias(f"s_{a}y") for a in names))
    m = lambda a, b: F.col(f"s_{min(a, b)}{max(a, b)}")

    def det(r: list[list[Column]]) -> Column:
        return r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])

    a = [[m(p, q) for q in names] for p in names]
    solved = []
    for k in range(3):
        b = [[F.col(f"s_{names[i]}y") if j == k else a[i][j] for j in range(3)] for i in range(3)]
        solved.append(F.try_divide(det(b), det(a)))
    return s.select("n", solved[0].alias("pre_trend"), solved[1].alias("level"), solved[2].alias("slope"))


def did(df: DataFrame, by: list[str], y: str, t: str, treated: Column) -> DataFrame:
    """Slope change of treated minus that of control: (by, n, effect, se, t); 8 parameters, classical errors."""
    yc, tc = F.col(y), F.col(t)
    cells = {"tp": treated & (tc >= 0), "tb": treated & (tc < 0), "cp": ~treated & (tc >= 0), "cb": ~treated & (tc < 0)}
    out = df.groupBy(*by).agg(*(c for k, when in cells.items() for c in line(yc, tc, f"{k}_", when)))
    n = sum((F.col(f"{k}_n") for k in cells), F.lit(0))
    rss = sum((F.col(f"{k}_rss") for k in cells), F.lit(0.0))
    inv = sum((F.try_divide(F.lit(1.0), F.col(f"{k}_sxx")) for k in cells), F.lit(0.0))
    effect = F.col("tp_slope") - F.col("tb_slope") - (F.col("cp_slope") - F.col("cb_slope"))
    out = out.select(*by, n.alias("n"), effect.alias("effect"), F.sqrt(F.try_divide(rss, n - 8) * inv).alias("se"))
    return out.withColumn("t", F.try_divide("effect", "se"))


def meta(df: DataFrame, by: list[str], effect: str = "effect", se: str = "se") -> DataFrame:
    """(by, k, fixed, fixed_se, q, i2, tau2, random, random_se): inverse-variance and DerSimonian-Laird means."""
    rows = df.where(F.col(effect).isNotNull() & (F.col(se) > 0)).withColumn("_w", 1 / F.col(se) ** 2).withColumn("_e", F.col(effect))
    s = rows.groupBy(*by).agg(F.count("*").alias("k"), F.sum("_w").alias("w"), F.sum(F.col("_w") ** 2).alias("ww"), F.sum(F.col("_w") * F.col("_e")).alias("we"), F.sum(F.col("_w") * F.col("_e") ** 2).alias("wee"))
    s = s.withColumn("fixed", F.col("we") / F.col("w")).withColumn("fixed_se", F.sqrt(1 / F.col("w"))).withColumn("q", F.col("wee") - F.col("we") ** 2 / F.col("w"))
    dof = F.col("k") - 1
    s = s.withColumn("i2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(100 * (F.col("q") - dof), F.col("q")), F.lit(0.0))))
    s = s.withColumn("tau2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - dof, F.col("w") - F.col("ww") / F.col("w")), F.lit(0.0)))).select(*by, "k", "fixed", "fixed_se", "q", "i2", "tau2")
    back = rows.join(s, by) if by else rows.join(F.broadcast(s))
    r = F.lit(1.0) / (F.col(se) ** 2 + F.col("tau2"))
    return back.groupBy(*by, "k", "fixed", "fixed_se", "q", "i2", "tau2").agg((F.sum(r * F.col("_e")) / F.sum(r)).alias("random"), F.sqrt(1 / F.sum(r)).alias("random_se"))


def egger(df: DataFrame, by: list[str], effect: str = "effect", se: str = "se", least: int = 10) -> DataFrame:
    """(by, n, intercept, se, t) of effect/se on 1/se where there are enough studies."""
    rows = df.where(F.col(se) > 0).select(*by, (F.col(effect) / F.col(se)).alias("_y"), (1 / F.col(se)).alias("_x"))
    out = rows.groupBy(*by).agg(*line(F.col("_y"), F.col("_x"))).where(F.col("n") >= least)
    se_i = F.sqrt(F.col("rss") / (F.col("n") - 2) * (1 / F.col("n") + F.col("xm") ** 2 / F.col("sxx")))
    return out.select(*by, "n", F.col("icpt").alias("intercept"), se_i.alias("se")).withColumn("t", F.try_divide("intercept", "se"))


def bin_effects(df: DataFrame, by: list[str], bin_: str, y: str, w: str | None = None, ref: int = -1) -> DataFrame:
    """(by, bin, coef): weighted mean of each bin minus that of the reference bin, which is listed with 0."""
    weight = F.col(w) if w else F.lit(1.0)
    means = df.groupBy(*by, bin_).agg((F.sum(weight * F.col(y)) / F.sum(weight)).alias("_m"))
    base = F.max(F.when(F.col(bin_) == ref, F.col("_m"))).over(Window.partitionBy(*(by or [F.lit(1)])))
    return means.withColumn("coef", F.col("_m") - base).where("coef is not null").drop("_m")


def bin_study(df: DataFrame, by: list[str], bin_: str, y: str, w: str, ref: int = -1) -> DataFrame:
    """(by, bin, coef, se, t, df) of a weighted regression on bins alone: weighted means against the reference bin's.

    df: the residual degrees of freedom. The reference bin is listed with 0; errors are classical, null without a degree of freedom.
    """
    yc, wc = F.col(y).cast("double"), F.col(w).cast("double")
    cells = df.groupBy(*by, bin_).agg(F.count("*").alias("_n"), F.sum(wc).alias("_w"), F.sum(wc * yc).alias("_wy"), F.sum(wc * yc * yc).alias("_wyy"))
    cells = cells.withColumn("_m", F.col("_wy") / F.col("_w")).withColumn("_ss", F.col("_wyy") - F.col("_wy") * F.col("_m"))
    every = Window.partitionBy(*(by or [F.lit(1)]))
    at_ref = lambda c: F.max(F.when(F.col(bin_) == ref, F.col(c))).over(every)
    dof = F.sum("_n").over(every) - F.count("*").over(every)
    out = cells.withColumn("df", dof).withColumn("_s2", F.try_divide(F.sum("_ss").over(every), F.col("df")))
    var = F.when(F.col(bin_) == ref, F.lit(0.0)).otherwise(F.col("_s2") * (1 / F.col("_w") + 1 / at_ref("_w")))
    out = out.select(*by, bin_, (F.col("_m") - at_ref("_m")).alias("coef"), F.sqrt(F.when(F.col("df") > 0, var)).alias("se"), "df")
    return out.where("coef is not null").select(*by, bin_, "coef", "se", F.try_divide("coef", "se").alias("t"), "df")


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, r, t) with n - 2 degrees of freedom."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    out = df.where(xc.isNotNull() & yc.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.corr(xc, yc).alias("r"))
    return out.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") ** 2)))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson of average ranks. Ranks need the rows of a group in order: use it on panels, not on raw rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    keys = by or [F.lit(1)]
    for c in (x, y):
        w, ties = Window.partitionBy(*keys), Window.partitionBy(*keys, c)
        rows = rows.withColumn(f"_r_{c}", F.rank().over(w.orderBy(c)) + (F.count("*").over(ties) - 1) / 2)
    return pearson(rows, by, f"_r_{x}", f"_r_{y}")


def durbin_watson(df: DataFrame, by: list[str], order: str, residual: str) -> DataFrame:
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order)
    d = df.withColumn("_d", F.col(residual) - F.lag(residual).over(w))
    return d.groupBy(*by).agg(F.try_divide(F.sum(F.col("_d") ** 2), F.sum(F.col(residual) ** 2)).alias("dw"))


def its_residuals(df: DataFrame, by: list[str], y: str = "y", t: str = "t") -> DataFrame:
    """df with resid of y ~ t + post + post·t: two lines per entity, by windows."""
    side = (F.col(t) >= 0).cast("int")
    w = Window.partitionBy(*by, side)
    yc, tc = F.col(y).cast("double"), F.col(t).cast("double")
    return df.withColumn("resid", yc - F.regr_intercept(yc, tc).over(w) - F.regr_slope(yc, tc).over(w) * tc)


def one_sample_t(x: Column) -> Column:
    return F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))


def ci95(beta: str, se: str) -> list[Column]:
    return [(F.col(beta) - Z95 * F.col(se)).alias("ci_low"), (F.col(beta) + Z95 * F.col(se)).alias("ci_high")]


def synthetic_series(cells: DataFrame, entity: str, t: str, base: float, trend: float, level: float, slope: float, noise: float, seed: int = 0) -> DataFrame:
    """(entity, t, y): interrupted series with known coefficients and normal noise in the cells of a panel, the same for the same seed on any machine."""
    rows = cells.select(F.col(entity).alias("entity"), F.col(t).alias("t")).distinct()
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), "entity", F.col("t")))
    uniform = lambda start: (F.conv(F.substring(h, start, 8), 16, 10).cast("double") + 1) / 4294967297.0
    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(9))
    post = (F.col("t") >= 0).cast("int")
    return rows.select("entity", "t", (base + trend * F.col("t") + level * post + slope * post * F.col("t") + noise * normal).alias("y"))
