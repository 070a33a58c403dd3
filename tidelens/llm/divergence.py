"""How far the sources of a language differ, and by which terms.

Tasks count the terms of what they read before anything is shuffled; a term's counts in all
sources then meet in one row, which a language keeps if enough documents have it. The
kept terms are dealt into blocks. A block is a dense matrix of groups by terms in numpy: all
pairs of groups are compared by broadcasting one row against the whole matrix, and
each group's largest terms form a heap of bounded size. The blocks' pair matrices are
added up and their heaps merged by Spark.

A block's matrix has at most CELLS cells and its pair matrix too: more groups make
narrower blocks, and beyond that a block is gone through once per slice of its groups. So one
hot source or language is many blocks, and no task holds more than a block.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, shared_dir, small, tidy
from .phrases import chunks

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 1_000_000_000
CELLS = 1 << 20
WIDTH = 4096  # terms of a block at most
HELD = 1 << 20  # different terms after which a task passes its sums on


def proportions(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * counts / total) in 64 bits for numbers below 9e13, digit group by digit group."""
    half = 10_000
    whole, rest = np.divmod(counts * (SCALE // half), total)
    return 1 + whole * half + rest * half // total


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) per task: occurrences, and documents that have the term; a null term has n null and df documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, int]] = {}
        counts: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def put() -> Iterator[pa.RecordBatch]:
            nonlocal groups, counts, held
            for (lang, source), terms in groups.items():
                names, (n, df) = list(terms), counts[lang, source]
                for i in range(0, max(1, len(names)), 1 << 16):
                    part = names[i : i + (1 << 16)]
                    m = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array([source] * m, pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array(n[i : i + m]), pa.array(df[i : i + m])], names=["lang", "source", "term", "n", "df"])
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.nulls(1, pa.string()), pa.array([0], pa.int64()), pa.array([1], pa.int64())], names=["lang", "source", "term", "n", "df"])
            groups, counts, held = {}, {}, 0

        for batch in batches:
            for b in pieces([batch]):
                for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    key = (lang, source)
                    if key not in groups:
                        groups[key], counts[key] = {}, (np.zeros(1024, np.int64), np.zeros(1024, np.int64))
                        held += 1024
                    terms, seen = groups[key], []
                    before, n, df = len(terms), *counts[key]
                    for chunk in chunks(text.lower()):  # of bytes: A-Z only
                        number = terms.setdefault
                        ids, times = np.unique(np.array([number(t, len(terms)) for t in TERM.findall(chunk)], np.int64), return_counts=True)
                        if len(terms) > len(n):
                            n, df = (np.append(x, np.zeros(max(len(x), len(terms) - len(x)), np.int64)) for x in (n, df))
                            counts[key] = n, df
                        n[ids] += times
                        seen.append(ids)
                    df[np.unique(np.concatenate([np.zeros(0, np.int64), *seen]))] += 1
                    held += len(terms) - before
                    if held >= HELD:
                        yield from put()
        yield from put()

    return docs.mapInArrow(tidy(run), "lang string, source string, term string, n long, df long")


def _block(total: int, kept: int, sizes: np.ndarray, rows: range, terms: int, at: np.ndarray, group: np.ndarray, n: np.ndarray, top: int) -> tuple[np.ndarray, list]:
    """(sums of pairs: rows x groups, [(group, term, value) of the largest terms of the groups in rows]) of one block.

    at, group, n: term, group and count of the cells that are not zero; terms are numbered in the order of their bytes.
    """
    counts = np.zeros((len(sizes), terms), np.int64)
    counts[group, at] = n
    q_lang = proportions(counts.sum(0) + 1, total + kept)
    p = proportions(counts + 1, sizes[:, None] + kept)
    pairs, heaps = np.zeros((len(rows), len(sizes)), np.int64), []
    for k, i in enumerate(rows):
        d = p[i] - p
        pairs[k] = (d * d // p).sum(1)
        d = p[i] - q_lang
        have = np.flatnonzero((counts[i] > 0) & (d > 0))
        value = d[have] * d[have] // q_lang[have]
        best = np.argsort(-value, kind="stable")[:top]
        heaps += [(i, int(have[j]), int(value[j])) for j in best.tolist()]
    return pairs, heaps


def _tiles(top: int):
    """The function of one block: a table with a row per term, and one without a term that lists the groups' sizes."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        lang, part, kept, total, step = key[0].as_py(), key[2].as_py(), *(t[c][0].as_py() for c in ("kept", "total", "step"))
        found = t["found"].combine_chunks()
        row = np.repeat(np.arange(len(t)), np.diff(found.offsets.to_numpy()))
        source, n = found.flatten().field("source"), found.flatten().field("n").to_numpy()
        head = np.isin(row, np.flatnonzero(t["term"].is_null().to_numpy()))
        names, size = source.filter(pa.array(head)), n[head]
        order = pc.sort_indices(names).to_numpy()
        names, size = names.take(pa.array(order)), size[order]
        group = pc.index_in(source.filter(pa.array(~head)), value_set=names).to_numpy()
        terms = t["term"].to_pylist()
        place, order = np.zeros(len(t), np.int64), sorted((i for i, x in enumerate(terms) if x is not None), key=lambda i: terms[i].encode())
        place[order] = np.arange(len(order))
        rows = range(part * step, min(len(names), (part + 1) * step))
        pairs, heaps = _block(total, kept, size, rows, len(order), place[row[~head]], group, n[~head], top)
        names = names.to_pylist()
        i, j = (x.ravel() for x in np.indices(pairs.shape))
        other = i + rows.start != j
        cols = [
            [names[k + rows.start] for k in i[other].tolist()] + [names[k] for k, _, _ in heaps],
            ["pair"] * int(other.sum()) + ["term"] * len(heaps),
            [names[k] for k in j[other].tolist()] + [terms[order[k]] for _, k, _ in heaps],
        ]
        value = np.r_[pairs.ravel()[other], np.array([v for _, _, v in heaps], np.int64)]
        return pa.table([pa.array([lang] * len(value), pa.string()), *(pa.array(c, pa.string()) for c in cols), pa.array(value)], names=["lang", "source", "part", "item", "value"])

    return run


def divergence(docs: DataFrame, folder: str | None = None, least: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): per source of a language, its distance from every other source and its own terms.

    Terms are runs of letters A-Z (in lower case) and of characters beyond ASCII; a language keeps
    those that at least `least` of its documents have. With p of a term as in proportions(), counts raised by one, part
    "pair" sums floor((p - q)^2 / q) over the kept terms, q the other source's p; part "term" gives it for the `top`
    terms that the source has and that are above the language's own p, q. Both are ranked by value, then by the
    item's bytes. Sums are exact in 64 bits: below 9e13 occurrences and 2e9 kept terms.
    Null texts, languages and sources count as empty ones; documents without a term still make
    their group; a row is a document, repeated ones too; an empty table gives an empty result; other columns
    of docs are not read. folder: a new folder that driver and executors share.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/divergence-{uuid.uuid4().hex}"

    def kept_as(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    text = lambda c, name: F.coalesce(docs[c].cast("string"), F.lit("")).alias(name)
    counted = _counted(docs.select(text(lang_col, "lang"), text(source_col, "source"), text(text_col, "text")))
    # One shuffle for both sums; what a task reads has been summed up by the tasks before.
    sums = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    sums = sums.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("found"))
    terms = kept_as(sums.where((F.col("df") >= least) | F.col("term").isNull()).select("lang", "term", "found"), "terms")

    sizes = terms.select("lang", F.inline("found")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    heads = sizes.groupBy("lang").agg(F.collect_list(F.struct("source", "n")).alias("sizes"), F.count("*").alias("groups"), F.sum("n").alias("total"))
    heads = heads.join(terms.groupBy("lang").agg(F.count("term").alias("kept")), "lang")
    heads = heads.withColumn("step", F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("groups"))))
    heads = heads.withColumns({"parts": F.ceil(F.col("groups") / F.col("step")), "blocks": F.greatest(F.lit(1), F.ceil(F.col("kept") / F.least(F.lit(WIDTH), "step")))})
    heads = kept_as(heads, "languages")
    shape = ["lang", "kept", "total", "step", "parts", "blocks"]
    of_terms = terms.where("term IS NOT NULL").join(small(heads.select(*shape), 100_000), "lang")
    of_terms = of_terms.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).select(*shape, "block", "term", "found")
    of_heads = heads.select(*shape, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.col("sizes").alias("found"))
    rows = of_terms.unionByName(of_heads).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = rows.groupBy("lang", "block", "slice").applyInArrow(_tiles(top), "lang string, source string, part string, item string, value long")
    blocks = kept_as(blocks, "blocks")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = blocks.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    own = blocks.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(own)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS MATERIALIZED (
  SELECT i, lang, source, unnest(w) AS term FROM d
), kept AS MATERIALIZED (
  SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, lang_n, coalesce(c.n, 0) AS n
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sized AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source) AS size,
    sum(lang_n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source) AS lang_size FROM cells
), p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // size AS p, 1 + CAST(1000000000 AS HUGEINT) * (lang_n + 1) // lang_size AS q FROM sized
), parts AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS BIGINT)
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""
