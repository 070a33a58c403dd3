"""Registers queries over the test tables together with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import EVENT

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: What the adapters give, in SQL.
BASE = {
    "posts": "SELECT o_orderkey AS id, o_orderdate AS creationdate, o_orderpriority AS language, o_custkey AS owner, o_totalprice AS price FROM orders",
    "metrics": "SELECT l_orderkey AS id, CAST(l_quantity AS INTEGER) AS cc, l_linenumber AS nloc FROM lineitem",
    "tags": "SELECT DISTINCT l_orderkey AS id, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey",
    "dated": f"SELECT *, date_diff('day', DATE '{EVENT}', CAST(creationdate AS DATE)) AS days FROM posts",
    "pm": "SELECT m.id, m.cc, m.nloc, p.creationdate, p.language, p.days, CAST(floor(p.days / 7.0) AS INTEGER) AS w FROM metrics m JOIN dated p ON m.id = p.id",
    "pt": "SELECT t.id, t.tag, p.creationdate, p.language, p.days, CAST(floor(p.days / 7.0) AS INTEGER) AS w, 1.0 / count(*) OVER (PARTITION BY t.id) AS pct FROM tags t JOIN dated p ON t.id = p.id",
    "panel": "SELECT language, w AS rel_week, avg(ln(1 + cc)) AS y, stddev_samp(ln(1 + cc)) AS y_sd, count(*) AS n_func FROM pm GROUP BY language, w",
    "weekly": "SELECT w AS t, avg(ln(1 + cc)) AS y, count(*) AS n_func FROM pm GROUP BY w",
    "votes": "SELECT id, gold, draw, CAST(('0x' || substr(md5(concat_ws('|', CAST(id AS VARCHAR), CAST(draw // 3 AS VARCHAR))), 1, 4)) AS INTEGER) % 3 AS label FROM (SELECT doc_id AS id, quality + toxic AS gold, unnest(range(1, 6))::INTEGER AS draw FROM labels)",
}
NEEDS = {"dated": ["posts"], "pm": ["metrics", "dated"], "pt": ["tags", "dated"], "panel": ["pm"], "weekly": ["pm"]}


def _with(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*_with(NEEDS.get(n, [])), n]:
            if x not in out:
                out.append(x)
    return out


def query(name: str, body: str | None = None, use: str = "", doubles: str = "", digits: int = 10) -> Callable[[Query], Query]:
    """Register a query. body: its SQL, after WITH the base tables named in use; doubles are rounded on both sides."""

    def add(f: Query) -> Query:
        cols = doubles.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in cols}) if cols else df

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[name] = run
        if body:
            parts = [f"{n} AS ({BASE[n]})" for n in _with(use.split())]
            text = " ".join(body.split())
            if parts:
                lead = "WITH RECURSIVE " if text.startswith("WITH RECURSIVE ") else "WITH "
                text = f"{lead}{', '.join(parts)}" + (f", {text.removeprefix(lead)}" if text.startswith(lead) else f" {text}")
            inner = text
            fixed = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {c}" for c in cols)
            ORACLES[name] = f"SELECT * REPLACE ({fixed}) FROM ({inner})" if cols else inner
        return run

    return add
