"""Every registered query against its SQL twin."""

import datetime as dt
import math
import os

import duckdb
import pytest

from tidelens.plans.queries import ORACLES, QUERIES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
EMPTY = set()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float) and math.isnan(v):
        return None
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(records):
    return sorted((tuple(map(plain, r)) for r in records), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    assert got, "no rows"
    if name not in ORACLES:
        return
    found = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})")
    types = {c: KINDS[t] for c, t in df.dtypes if t in KINDS}
    assert {d[0]: str(d[1]) for d in found.description if d[0] in types} == types
    assert got == rows(found.fetchall())


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_prompts_hold_whole_texts(spark, sf):
    from tidelens.plans.texts import _prompts

    whole = {r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    said = {m.content for r in _prompts(spark, sf, 100_000).collect() for m in r.messages if m.role == "user"}
    texts = {x for x in said if not x.startswith("Question ")}
    assert texts <= whole and any(len(x) > 200 for x in texts)
