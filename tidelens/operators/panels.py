"""Panel models with entity effects, from sums that merge.

Entity effects are taken out by each entity's own sums, so what is solved has the size of the
regressors (three) or of the bins, whatever the number of entities and rows. A row's
influence on the coefficients is (inverse moments) x (its regressors without the entity's
mean) x (weighted residual); every sandwich covariance is a sum over influences:

* by entity, squared: cluster errors;
* in the order of entity and time, with the rows up to `lags` before, under Bartlett weights: HAC;
* by time, then the same: Driscoll-Kraay.

Everything is a DataFrame expression; the systems are solved inside one row by elimination on arrays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..sources.adapters import scratch

TERMS = ("const", "time", "post", "post_time")
#: Entities whose sums are broadcast, a few numbers each.
SENT = 100_000
BLOCK = 10_000  # rows of a lag window


def _bind(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def times(matrix: Column, vector: Column) -> Column:
    return F.transform(matrix, lambda r: dot(r, vector))


def inverse(a: Column) -> Column:
    """The inverse of a symmetric matrix without negative directions, an array of rows; what the others determine gets zeros."""
    n = F.size(a)
    start = F.transform(a, lambda r, i: F.concat(r, F.transform(r, lambda _, j: F.when(i == j, F.lit(1.0)).otherwise(F.lit(0.0)))))

    def step(m: Column, k: Column) -> Column:
        pivot = F.get(F.get(m, k), k)
        some = pivot > 1e-10 * F.get(F.get(a, k), k)
        row = F.transform(F.get(m, k), lambda v: F.when(some, F.try_divide(v, pivot)).otherwise(F.lit(0.0)))
        return _bind(row, lambda p: F.transform(m, lambda r, i: F.when(i == k, p).otherwise(_bind(F.get(r, k), lambda c: F.zip_with(r, p, lambda v, w: v - c * w)))))

    return F.transform(F.aggregate(F.sequence(F.lit(0), n - 1), start, step), lambda r: F.slice(r, n + 1, n))


def _kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: a panel is small, what it comes from is not, and it is read several times."""
    path = f"{scratch(df.sparkSession)}/panel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _sent(df: DataFrame, rows: int = SENT) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def _design(panel: DataFrame, entity: str, y: str, t: str, weights: str | None) -> DataFrame:
    """(e, t, y, w, x): rows without nulls, x the three regressors."""
    tv = F.col(t).cast("double")
    x = F.array(tv, (tv >= 0).cast("double"), F.greatest(tv, F.lit(0.0)))
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    return _kept(panel.select(F.col(entity).alias("e"), tv.alias("t"), F.col(y).cast("double").alias("y"), w.alias("w"), x.alias("x")).dropna(subset=["e", "t", "y", "w"]))


def _fit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sums of each entity, one row with the coefficients, the inverse and what covariances need)."""
    x, k = [F.get("x", F.lit(i)) for i in range(3)], range(3)
    w, y = F.col("w"), F.col("y")
    own = rows.groupBy("e").agg(
        F.count("*").alias("n"),
        F.sum(w).alias("sw"),
        F.sum(w * y).alias("sy"),
        F.array(*(F.sum(w * x[i]) for i in k)).alias("sx"),
        F.array(*(F.sum(w * x[i] * y) for i in k)).alias("sxy"),
        F.array(*(F.array(*(F.sum(w * x[i] * x[j]) for j in k)) for i in k)).alias("sxx"),
    )
    sx, at = [F.get("sx", F.lit(i)) for i in k], lambda c, i, j: F.get(F.get(c, F.lit(i)), F.lit(j))
    all_ = own.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("entities"),
        F.array(*(F.array(*(F.sum(at("sxx", i, j) - sx[i] * sx[j] / F.col("sw")) for j in k)) for i in k)).alias("a"),
        F.array(*(F.sum(F.get("sxy", F.lit(i)) - sx[i] * F.col("sy") / F.col("sw")) for i in k)).alias("b"),
        F.min_by(F.struct("e", "sw", "sy", "sx"), "e").alias("first"),
    )
    one = all_.where("n > 0").withColumn("inv", inverse(F.col("a"))).withColumn("beta", times(F.col("inv"), F.col("b")))
    rank = F.size(F.filter("inv", lambda r: F.exists(r, lambda v: v != 0)))
    return own, one.select("n", "entities", "inv", "beta", "first", (rank + F.col("entities")).alias("rank"))


def _influences(rows: DataFrame, own: DataFrame, fit: DataFrame) -> DataFrame:
    """(e, t, p0 .. p3): each row's influence on const, time, post and post_time; const is the first entity's."""
    d = rows.join(_sent(own.select("e", "sw", "sy", "sx")), "e").crossJoin(F.broadcast(fit))  # one row
    centred = F.zip_with("x", "sx", lambda a, s: a - s / F.col("sw"))
    d = d.withColumn("c", centred)
    u = F.col("w") * (F.col("y") - F.col("sy") / F.col("sw") - dot(F.col("beta"), F.col("c")))
    d = d.withColumn("u", u).withColumn("p", times(F.col("inv"), F.transform("c", lambda v: v * F.col("u"))))
    of_first = F.when(F.col("e") == F.col("first.e"), F.col("u") / F.col("first.sw")).otherwise(0.0)
    p0 = of_first - dot(F.col("p"), F.col("first.sx")) / F.col("first.sw")
    return d.select("e", "t", p0.alias("p0"), *(F.get("p", F.lit(i)).alias(f"p{i + 1}") for i in range(3)))


_P = ("p0", "p1", "p2", "p3")


def _squares(df: DataFrame, other: tuple[str, ...] | None = None) -> list[Column]:
    """Sums of products of the influences as v_ij; with other, also of each with the weighted ones before it, both ways."""
    out = []
    for i in range(4):
        for j in range(i, 4):
            term = F.col(_P[i]) * F.col(_P[j])
            if other:
                term = term + F.col(_P[i]) * F.col(other[j]) + F.col(other[i]) * F.col(_P[j])
            out.append(F.sum(term).alias(f"v{i}{j}"))
    return out


def _bartlett(rows: DataFrame, lags: int) -> DataFrame:
    """The sums over rows (at, p0 .. p3), at counting from 0, with those up to `lags` places before.

    Windows are blocks of places; the last rows of a block stand once more before the next.
    """
    size = max(BLOCK, 4 * lags)
    home = F.floor(F.col("at") / size)
    rows = rows.withColumn("_b", F.explode(F.array(home, F.when(F.col("at") % size >= size - lags, home + 1)))).where("_b IS NOT NULL")
    before = Window.partitionBy("_b").orderBy("at")
    lagged = [sum((F.coalesce(F.lag(p, k).over(before), F.lit(0.0)) * (1 - k / (lags + 1)) for k in range(1, lags + 1)), F.lit(0.0)).alias(f"m{p}") for p in _P]
    both = rows.select("_b", "at", *_P, *lagged).where(F.floor(F.col("at") / size) == F.col("_b"))
    return both.agg(*_squares(both, tuple(f"m{p}" for p in _P)))


def _covariances(rows: DataFrame, own: DataFrame, fit: DataFrame, kinds: tuple[str, ...], lags: int) -> DataFrame:
    """(cov, v00 .. v33): the upper half of each covariance."""
    psi, out = _influences(rows, own, fit), []
    summed = [F.sum(p).alias(p) for p in _P]
    for kind in kinds:
        if kind == "cluster":
            by = psi.groupBy("e").agg(*summed)
            v = by.agg(*_squares(by)).crossJoin(F.broadcast(fit.select("n", "entities", "rank")))
            factor = F.col("entities") / F.greatest(F.lit(1), F.col("entities") - 1) * (F.col("n") - 1) / F.greatest(F.lit(1), F.col("n") - F.col("rank"))
            v = v.select(*((F.col(c) * factor).alias(c) for c in v.columns if c.startswith("v")))
        elif kind == "hac":
            # A row's place is its entity's first place and its own in the entity: the entities are few, a window over them is small.
            first = own.select("e", (F.sum("n").over(Window.orderBy("e")) - F.col("n")).alias("_f"))
            placed = psi.withColumn("_r", F.row_number().over(Window.partitionBy("e").orderBy("t"))).join(_sent(first), "e")
            v = _bartlett(placed.select((F.col("_f") + F.col("_r") - 1).alias("at"), *_P), lags)
        else:
            by = psi.groupBy("t").agg(*summed)
            v = _bartlett(by.select((F.row_number().over(Window.orderBy("t")) - 1).alias("at"), *_P), lags)
        out.append(v.withColumn("cov", F.lit(kind)))
    all_ = out[0]
    for v in out[1:]:
        all_ = all_.unionByName(v)
    return all_


def pooled(panel: DataFrame, entity: str, y: str = "y", t: str = "t", weights: str | None = None, lags: int = 8, kinds: tuple[str, ...] = ("cluster", "hac", "driscoll_kraay")) -> DataFrame:
    """(cov, term, coef, se, z, p): y ~ t + post + post·t with an effect per entity, under several errors.

    const is the effect of the first entity. Rows with a null take no part; without rows there is no result. Cluster
    errors have the factor G/(G-1) · (N-1)/(N-K), the others none.
    """
    rows = _design(panel, entity, y, t, weights)
    own, fit = _fit(rows)
    first = F.col("first")
    coef = F.concat(F.array((first["sy"] - dot(F.col("beta"), first["sx"])) / first["sw"]), F.col("beta"))
    v = _covariances(rows, own, fit, kinds, lags).crossJoin(F.broadcast(fit.select(coef.alias("c"))))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("term"), F.get("c", F.lit(i)).alias("coef"), F.sqrt(F.greatest(F.col(f"v{i}{i}"), F.lit(0.0))).alias("se")) for i, name in enumerate(TERMS))))
    out = v.select("cov", each.alias("_t")).select("cov", "_t.*").withColumn("z", F.when(F.col("se") > 0, F.col("coef") / F.col("se")))
    return out.withColumn("p", dist.normal_p_col(F.col("z")))


def effect_curve(panel: DataFrame, entity: str, grid: list[int], y: str = "y", t: str = "t", log: bool = True) -> DataFrame:
    """(t, effect, se): post + t·post_time over a grid by the delta method, cluster errors, in percent if log; 0 before the event."""
    rows = _design(panel, entity, y, t, None)
    own, fit = _fit(rows)
    v = _covariances(rows, own, fit, ("cluster",), 0).crossJoin(F.broadcast(fit.select("beta")))
    g = v.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    on, at = (F.col("t") >= 0).cast("double"), F.col("t").cast("double")
    d = on * (F.get("beta", F.lit(1)) + at * F.get("beta", F.lit(2)))
    se = F.sqrt(F.greatest(on * (F.col("v22") + at * at * F.col("v33") + 2 * at * F.col("v23")), F.lit(0.0)))
    return g.select("t", (F.expm1(d) * 100 if log else d).alias("effect"), (100 * F.exp(d) * se if log else se).alias("se"))


def studies(cells: DataFrame, models: list[str], entity: str, bin_: str, y: str = "y", weights: str | None = None, ref: int = -1, left_out: bool = False) -> DataFrame:
    """(models, bin, coef, se, z, p): effects of bins against the reference bin, with an effect per entity and cluster errors.

    One model per value of the columns `models`, all from one aggregation: the moments of an
    entity's bins are its weights less their product, and a model's are their sum. left_out: a column
    left_out instead, a model without each entity, whose moments are taken from the whole.
    The reference bin has 0, 0, 0 and p 1; a bin that the entities' effects explain has 0 and no error.
    Cells with a null take no part; several cells of an entity and bin count as one row each.
    """
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    named, models = models, [f"_{m}" for m in models]  # no column here has such a name
    rows = cells.select(*(F.col(m).alias(k) for m, k in zip(named, models, strict=True)), F.col(entity).alias("e"), F.col(bin_).cast("int").alias("b"), F.col(y).cast("double").alias("y"), w.alias("w")).dropna(subset=["e", "b", "y", "w"])
    one = _kept(rows.groupBy(*models, "e", "b").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.count("*").alias("n")))
    # Per entity the sums of its bins, as an array: as long as there are bins.
    own = one.groupBy(*models, "e").agg(F.sort_array(F.collect_list(F.struct("b", "w", "wy"))).alias("cells"), F.sum("n").alias("n"), F.sum("w").alias("sw"), F.sum("wy").alias("sy"))
    bins = one.groupBy(*models).agg(F.array_sort(F.collect_set("b")).alias("bins"))
    names = F.filter("bins", lambda b: b != ref)
    own = (own.join(F.broadcast(bins), models) if models else own.crossJoin(F.broadcast(bins))).withColumn("bins", names)  # bins: a line per model

    def over(f) -> Column:
        """An array over the bins: f of the entity's sums there, 0 where it has none."""
        known = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["b"], c)))
        return _bind(known, lambda m: F.transform("bins", lambda b: _bind(F.element_at(m, b), lambda c: F.coalesce(f(c), F.lit(0.0)))))

    own = own.select(*models, "e", "n", "sw", "bins", over(lambda c: c["w"]).alias("w"), over(lambda c: c["wy"] - c["w"] * F.col("sy") / F.col("sw")).alias("q"))
    product = lambda i, j: F.when(i["k"] == j["k"], i["w"]).otherwise(F.lit(0.0)) - i["w"] * j["w"] / F.col("sw")
    marked = F.filter(F.transform("w", lambda v, k: F.struct(k.alias("k"), v.alias("w"))), lambda x: x["w"] != 0)
    pairs = own.select(*models, "e", "sw", F.explode(marked).alias("i"), marked.alias("all")).select(*models, "e", "sw", "i", F.explode("all").alias("j"))
    moments = pairs.groupBy(*models, F.col("i.k").alias("i"), F.col("j.k").alias("j")).agg(F.sum(product(F.col("i"), F.col("j"))).alias("a"))
    flat = moments.groupBy(*models).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "a"))).alias("m"))
    right = own.select(*models, F.posexplode("q").alias("i", "q")).groupBy(*models, "i").agg(F.sum("q").alias("q")).groupBy(*models).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("right"))
    size = own.groupBy(*models).agg(F.sum("n").alias("n"), F.count("*").alias("entities"), F.first("bins").alias("bins"))
    at = F.sequence(F.lit(0), F.size("bins") - 1)
    whole = size.join(flat, models).join(right, models) if models else size.crossJoin(flat).crossJoin(right)
    whole = whole.where(F.size("bins") > 0).withColumn("a", F.transform(at, lambda i: F.transform(at, lambda j: F.coalesce(F.element_at("m", F.struct(i.alias("i"), j.alias("j"))), F.lit(0.0))))).drop("m")
    keys = models
    if left_out:
        # Every entity's own moments, taken from the whole's.
        less = own.select(F.col("e").alias("left_out"), F.col("n").alias("n_e"), F.col("sw").alias("sw_e"), F.col("w").alias("w_e"), F.col("q").alias("q_e"))
        own_moment = lambda i, j: F.when(i == j, F.get("w_e", i)).otherwise(F.lit(0.0)) - F.get("w_e", i) * F.get("w_e", j) / F.col("sw_e")
        a = F.transform("a", lambda r, i: F.transform(r, lambda v, j: v - own_moment(i, j)))
        whole = less.crossJoin(F.broadcast(whole)).select("left_out", (F.col("n") - F.col("n_e")).alias("n"), (F.col("entities") - 1).alias("entities"), "bins", a.alias("a"), F.zip_with("right", "q_e", lambda x, y: x - y).alias("right"))
        keys = ["left_out"]
    fits = whole.withColumn("inv", inverse(F.col("a"))).withColumn("beta", times(F.col("inv"), F.col("right")))
    fits = fits.select(*keys, "n", "entities", "bins", "inv", "beta")
    # An entity's score is linear in the coefficients: what is left of its sums without the fit.
    score_rows = own.select(*models, "e", "sw", "w", "q")
    both = score_rows.join(_sent(fits, 10_000), F.col("left_out") != F.col("e")) if left_out else score_rows.join(F.broadcast(fits), models) if models else score_rows.crossJoin(F.broadcast(fits))
    fitted = _bind(dot(F.col("w"), F.col("beta")) / F.col("sw"), lambda m: F.transform("beta", lambda v, i: F.get("q", i) - F.get("w", i) * (v - m)))
    influence = both.select(*keys, F.posexplode(times(F.col("inv"), fitted)).alias("i", "p"))
    squares = influence.groupBy(*keys, "i").agg(F.sum(F.col("p") * F.col("p")).alias("v"))
    known = F.size(F.filter("inv", lambda r: F.exists(r, lambda v: v != 0)))
    factor = F.col("entities") / F.greatest(F.lit(1), F.col("entities") - 1) * (F.col("n") - 1) / F.greatest(F.lit(1), F.col("n") - F.col("entities") - known)
    lines = fits.select(*keys, factor.alias("f"), F.posexplode(F.arrays_zip(F.col("bins").alias("b"), F.col("beta").alias("c"))).alias("i", "x"))
    out = lines.join(squares, [*keys, "i"]).select(*keys, F.col("x.b").alias("bin"), F.col("x.c").alias("coef"), F.sqrt(F.col("v") * F.col("f")).alias("se"))
    out = out.withColumn("z", F.when(F.col("se") > 0, F.col("coef") / F.col("se")))
    out = out.withColumn("p", dist.normal_p_col(F.col("z")))
    none = F.lit(0.0)
    base = fits.select(*keys, F.lit(ref).alias("bin"), none.alias("coef"), none.alias("se"), none.alias("z"), F.lit(1.0).alias("p"))
    return out.unionByName(base).withColumnsRenamed(dict(zip(models, named, strict=True)))
