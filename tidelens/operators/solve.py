"""Estimators that need a design matrix: robust covariances over small panels.

Panels have one row per entity and bin, hundreds to some ten thousand rows, whatever the
size of the raw data: the aggregation before them is distributed, the solve is numpy in one
applyInPandas group per entity. Models over all entities are in panels.py.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist


def solve(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, residuals, bread, weighted design); a rank-deficient design uses the pseudo-inverse."""
    r = np.ones(len(y)) if w is None else np.sqrt(w)
    xw, yw = x * r[:, None], y * r
    bread = np.linalg.pinv(xw.T @ xw)
    beta = bread @ (xw.T @ yw)
    return beta, yw - xw @ beta, bread, xw


def classical(x: np.ndarray, e: np.ndarray, bread: np.ndarray) -> np.ndarray:
    return bread * (e @ e) / max(1, len(e) - np.linalg.matrix_rank(x))


def hac(x: np.ndarray, e: np.ndarray, bread: np.ndarray, lags: int) -> np.ndarray:
    """Bartlett weights, no small-sample factor; lags run over rows as they are ordered."""
    u = x * e[:, None]
    s = u.T @ u
    for k in range(1, min(lags, len(u) - 1) + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    return bread @ s @ bread


def hc3(x: np.ndarray, e: np.ndarray, bread: np.ndarray) -> np.ndarray:
    h = np.einsum("ij,jk,ik->i", x, bread, x)
    u = x * (e / np.maximum(1 - h, 1e-12))[:, None]
    return bread @ (u.T @ u) @ bread


def its_design(t: np.ndarray) -> np.ndarray:
    post = (t >= 0).astype(float)
    return np.c_[np.ones(len(t)), t, post, post * t]


ITS_TERMS = ("const", "time", "post", "post_time")


def _table(terms: list[str], beta: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    z = np.divide(beta, se, out=np.full(len(beta), np.nan), where=se > 0)
    p = [dist.normal_p(v) if v == v else None for v in z]
    return pd.DataFrame({"term": terms, "coef": beta, "se": se, "z": z, "p": p})


TERMS = "term string, coef double, se double, z double, p double"


def _covariance(cov: str, lags: int, x: np.ndarray, e: np.ndarray, bread: np.ndarray) -> np.ndarray:
    if cov == "hac":
        return hac(x, e, bread, lags)
    return hc3(x, e, bread) if cov == "hc3" else classical(x, e, bread)


def its(panel: DataFrame, by: str, y: str = "y", t: str = "t", weights: str | None = None, cov: str = "hac", lags: int = 4) -> DataFrame:
    """(by, term, coef, se, z, p) of y ~ t + post + post·t for each entity."""
    if cov not in ("hac", "hc3", "classical"):
        raise ValueError(f"unknown covariance {cov!r}")
    columns = list(dict.fromkeys([by, y, t, *([weights] if weights else [])]))
    kind = panel.schema[by].dataType.simpleString()

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna().sort_values(t)
        if len(p) < 5:
            return pd.DataFrame(columns=[by, "term", "coef", "se", "z", "p"])
        beta, e, bread, x = solve(its_design(p[t].to_numpy(float)), p[y].to_numpy(float), p[weights].to_numpy(float) if weights else None)
        out = _table(list(ITS_TERMS), beta, _covariance(cov, lags, x, e, bread))
        out.insert(0, by, p[by].iloc[0])
        return out

    return panel.select(*columns).groupBy(by).applyInPandas(fit, f"{by} {kind}, {TERMS}")


STUDY = "bin int, coef double, se double, z double, p double"


def its_models(panel: DataFrame, by: str, widths: tuple[int, ...], y: str = "y", t: str = "t", weights: str = "n_func", lags: int = 8) -> DataFrame:
    """(by, term, coef, se, z, p, model): each entity's weighted series with HAC errors, and plain ones on narrower windows with HC3."""
    kind = panel.schema[by].dataType.simpleString()

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p, out = p.dropna().sort_values(t), []
        models = [(f"wls_hac{lags}", p, weights, "hac"), *((f"hc3_{k}", p[p[t].between(-k, k)], None, "hc3") for k in widths)]
        for name, q, w, cov in models:
            if len(q) < 5:
                continue
            beta, e, bread, x = solve(its_design(q[t].to_numpy(float)), q[y].to_numpy(float), q[w].to_numpy(float) if w else None)
            one = _table(list(ITS_TERMS), beta, _covariance(cov, lags, x, e, bread))
            one.insert(0, by, p[by].iloc[0])
            out.append(one.assign(model=name))
        return pd.concat(out) if out else pd.DataFrame(columns=[by, "term", "coef", "se", "z", "p", "model"])

    return panel.select(by, y, t, weights).groupBy(by).applyInPandas(fit, f"{by} {kind}, {TERMS}, model string")


def bin_study_hac(panel: DataFrame, by: str, bin_: str, t: str, lags: int, ref: int | None = -1, y: str = "y", weights: str | None = None) -> DataFrame:
    """(by, bin, coef, se, z, p) of y on bins alone with HAC errors; ref None: the first bin. Bins without an error go."""
    kind = panel.schema[by].dataType.simpleString()

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna().sort_values(t)
        base = p[bin_].min() if ref is None else ref
        bins = sorted(set(p[bin_]) - {base})
        if base not in set(p[bin_]) or not bins:
            return pd.DataFrame(columns=[by, "bin", "coef", "se", "z", "p"])
        x0 = np.c_[np.ones(len(p)), (p[bin_].to_numpy()[:, None] == np.array(bins)).astype(float)]
        beta, e, bread, x = solve(x0, p[y].to_numpy(float), p[weights].to_numpy(float) if weights else None)
        out = _table(["const", *map(str, bins)], beta, hac(x, e, bread, lags)).iloc[1:].dropna()
        out["bin"] = out["term"].astype(int)
        out.insert(0, by, p[by].iloc[0])
        return out[[by, "bin", "coef", "se", "z", "p"]]

    columns = list(dict.fromkeys([by, bin_, t, y, *([weights] if weights else [])]))
    return panel.select(*columns).groupBy(by).applyInPandas(fit, f"{by} {kind}, {STUDY}")


def spline(panel: DataFrame, by: str, knots: tuple[int, ...] = (0, 52, 104), y: str = "y", t: str = "t", lags: int = 4) -> DataFrame:
    """(by, term, coef, se, z, p) of a piecewise line: y ~ t + max(t - knot, 0), HAC errors."""
    kind = panel.schema[by].dataType.simpleString()

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna().sort_values(t)
        tv = p[t].to_numpy(float)
        beta, e, bread, x = solve(np.c_[np.ones(len(tv)), tv, *(np.maximum(tv - k, 0) for k in knots)], p[y].to_numpy(float))
        out = _table(["const", "t", *(f"after_{k}" for k in knots)], beta, hac(x, e, bread, lags))
        out.insert(0, by, p[by].iloc[0])
        return out

    return panel.select(by, y, t).groupBy(by).applyInPandas(fit, f"{by} {kind}, {TERMS}")


def diagnostics(panel: DataFrame, by: str, y: str = "y", t: str = "t", lags: int = 4) -> DataFrame:
    """(by, dw, bg, bg_p, bp, bp_p) of the interrupted-series residuals: Durbin-Watson, Breusch-Godfrey, Breusch-Pagan."""
    kind = panel.schema[by].dataType.simpleString()

    def r2(x: np.ndarray, v: np.ndarray) -> float:
        _, e, _, _ = solve(x, v)
        return 1 - (e @ e) / ((v - v.mean()) @ (v - v.mean()))

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna().sort_values(t)
        x = its_design(p[t].to_numpy(float))
        _, e, _, _ = solve(x, p[y].to_numpy(float))
        past = np.column_stack([np.r_[np.zeros(k), e[:-k]] for k in range(1, lags + 1)])
        n = len(e)
        bg, bp = n * r2(np.c_[x, past], e), n * r2(x, e**2)
        return pd.DataFrame({by: [p[by].iloc[0]], "dw": [float((np.diff(e) ** 2).sum() / (e @ e))], "bg": [bg], "bg_p": [dist.chi2_p(bg, lags)], "bp": [bp], "bp_p": [dist.chi2_p(bp, 3)]})

    return panel.select(by, y, t).groupBy(by).applyInPandas(fit, f"{by} {kind}, dw double, bg double, bg_p double, bp double, bp_p double")
