"""Plans of queries whose tasks held or repeated too much on large tables."""

import tracemalloc

import pyarrow as pa

from tidelens.functions import text
from tidelens.operators import network
from tidelens.plans.queries import QUERIES


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_posts_are_counted_without_a_table_of_posts_by_tag(spark, sf):
    assert "distinct" not in _plan(QUERIES["AGG11"](spark, sf)).split("Join")[0].lower()


def test_years_of_one_side_are_distinct_before_they_are_joined(spark, sf):
    plan = _plan(QUERIES["SET7"](spark, sf)).splitlines()
    join = next(i for i, x in enumerate(plan) if "Join LeftSemi" in x)
    assert any("Aggregate" in x for x in plan[join:])


def test_edges_of_a_modularity_are_made_once(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(network, "communities", lambda e: seen.append(_plan(e)) or e.selectExpr("a as node", "0 as community"))
    QUERIES["NET7_modularity"](spark, sf)
    assert "Join" not in seen[0] and "Aggregate" not in seen[0]


def test_bodies_become_python_strings_a_few_at_a_time():
    bodies = pa.array([f"<p>{i}</p><pre><code>a &lt; {i} {'x' * 20_000}</code></pre>" for i in range(2000)] + [None, "", "<pre><code>"])
    tracemalloc.start()
    try:
        found, there = text.code_sections.func(bodies), text.has_sections.func(bodies)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 10_000_000  # all of them take 40 MB
    assert [[tuple(s.values()) for s in x] for x in found.to_pylist()] == [text.sections_of(b) for b in bodies.to_pylist()]
    assert there.to_pylist() == [True] * 2000 + [False] * 3
