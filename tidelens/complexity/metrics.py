"""Complexity metrics of snippets as DataFrame operators.

A snippet is one row and may have any number of functions; metrics come back as an array
of structs from an Arrow UDF and are exploded, so no file is written on the way.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from ..sources.adapters import scratch
from .languages import CYCLOMATIC, LANGUAGES
from .lexer import NEWLINE, balanced, tokens
from .walkers import cognitive, parsed

#: Languages whose snippets skip the syntax gate.
EXEMPT = ("f#", "vb.net", "groovy", "assembly")
DECISIONS = {"if", "for", "while", "case", "catch", "elif", "elsif", "elseif", "until", "unless", "foreach", "except", "rescue", "when", "&&", "||", "?", "and", "or", "guard", "andalso", "orelse"}

FUNCTION = StructType(
    [
        StructField("function", StringType()),
        StructField("complexity", IntegerType()),
        StructField("cyclomatic", IntegerType()),
        StructField("nloc", IntegerType()),
        StructField("token_count", IntegerType()),
        StructField("parameter_count", IntegerType()),
        StructField("start_line", IntegerType()),
        StructField("end_line", IntegerType()),
    ]
)


def valid(source: str, language: str) -> bool:
    """The syntax gate: Python by its grammar, other languages by their brackets."""
    if language not in LANGUAGES:
        return False
    if language in EXEMPT:
        return True
    if language == "python":
        try:
            parsed(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True
    return balanced(tokens(source, language))


def line_counts(source: str, language: str) -> tuple[list[int], list[int]]:
    """Running totals over lines, from 0: decision tokens, and lines that hold code."""
    last = source.count("\n") + 2
    decisions, code = [0] * (last + 1), [0] * (last + 1)
    for t in tokens(source, language):
        if t.text != NEWLINE:
            code[t.line] = 1
            decisions[t.line] += t.text in DECISIONS
    return list(accumulate(decisions)), list(accumulate(code))


def measure(source: str | None, language: str | None) -> list[dict] | None:
    """Function records of a snippet; None if it is not valid or too deep to walk."""
    if source is None or language is None or not valid(source, language):
        return None
    try:
        found = cognitive(source, language)
    except RecursionError:
        return None
    decisions, code = line_counts(source, language)
    between = lambda total, f: total[f.end] - total[f.start - 1]
    return [
        {
            "function": f.name,
            "complexity": f.complexity,
            "cyclomatic": 1 + between(decisions, f) if language in CYCLOMATIC else None,
            "nloc": between(code, f),
            "token_count": f.tokens,
            "parameter_count": f.parameters,
            "start_line": f.start,
            "end_line": f.end,
        }
        for f in found
    ]


def _udf():
    @F.pandas_udf(ArrayType(FUNCTION))
    def run(source: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([measure(s, g) for s, g in zip(source, language, strict=True)], dtype=object)

    return run


def _each(rows: DataFrame, records: str, *keys: str) -> DataFrame:
    """(keys, fields): a row per record. A plain explode would let the optimizer filter on the array's size and run its function twice."""
    return rows.select(*keys, F.explode_outer(records).alias("_x")).where("_x is not null").select(*keys, "_x.*")


def function_metrics(snippets: DataFrame, keys: list[str], source: str = "src", language: str = "language") -> DataFrame:
    """(keys, language, function, complexity, cyclomatic, nloc, ...): a row per function of the snippets that pass the gate."""
    rows = snippets.select(*keys, F.col(language).alias("language"), _udf()(F.col(source), F.col(language)).alias("_m"))
    return _each(rows, "_m", *keys, "language")


def not_measured(snippets: DataFrame, keys: list[str], source: str = "src", language: str = "language") -> DataFrame:
    """The keys of snippets that the gate rejects."""
    rows = snippets.select(*keys, _udf()(F.col(source), F.col(language)).alias("_m"))
    return rows.where("_m is null").select(*keys)


def syntax_ok(snippets: DataFrame, keys: list[str], source: str = "src", language: str = "language") -> DataFrame:
    @F.pandas_udf(BooleanType())
    def ok(s: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([a is not None and b is not None and valid(a, b) for a, b in zip(s, g, strict=True)])

    return snippets.select(*keys, ok(F.col(source), F.col(language)).alias("ok"))


NESTED = ("cognitive.sum", "cognitive.average", "cyclomatic.sum", "cyclomatic.average", "loc.sloc", "loc.ploc", "loc.lloc", "loc.cloc", "halstead.volume", "halstead.difficulty", "mi.mi_original", "nom.functions")
SPACE_LINES = ("start_line", "end_line")


def _number(v: Column, path: str) -> Column:
    """The number at a path of a variant; null for anything else there."""
    found = F.try_variant_get(v, f"$.{path}", "variant")
    kind = F.schema_of_variant(found)
    return F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(found, "$", "double"))


def report_functions(reports: DataFrame, keys: list[str], column: str = "report") -> DataFrame:
    """(keys, name, parent, start_line, end_line, metrics): a row per outermost function of external JSON reports.

    parent is the name of what holds the function; a missing level or value is null. The tree is gone down
    level by level: functions of a level become rows, and only what holds others goes on, as a variant. Text that is no
    JSON object has no function. The driver learns after each level whether one is left.
    """
    spark, found = reports.sparkSession, []
    folder = f"{scratch(spark)}/reports-{uuid.uuid4().hex}"
    level = reports.select(*keys, F.try_parse_json(column).alias("_v"), F.lit(None).cast("string").alias("parent"))
    while True:
        level = level.where(F.schema_of_variant("_v").startswith("OBJECT"))
        text = lambda path: F.try_variant_get("_v", f"$.{path}", "string")
        function = F.coalesce(text("kind") == "function", F.lit(False))
        lines = (F.try_variant_get("_v", f"$.{x}", "int").alias(x) for x in SPACE_LINES)
        found.append(level.where(function).select(*keys, text("name").alias("name"), "parent", *lines, *(_number(F.col("_v"), f"metrics.{x}").alias(x.replace(".", "_")) for x in NESTED)))
        rest = level.where(~function).select(*keys, text("name").alias("parent"), F.explode(F.try_variant_get("_v", "$.spaces", "array<variant>")).alias("_v")).select(*keys, "_v", "parent")
        # What is below is functions for the most part: those become rows, the others are kept.
        below = f"{folder}/{len(found)}"
        rest.write.parquet(below)
        level = spark.read.parquet(below)
        if level.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def extension(language: str) -> str:
    return LANGUAGES[language].ext


def file_name(row: int, id_: int, language: str) -> str:
    """{row}_{id}.{ext}, the name a snippet has in exports."""
    return f"{row}_{id_}.{extension(language)}"


def language_of(name: str) -> str | None:
    """The first language with a file's extension."""
    m = re.search(r"\.(\w+)$", name)
    return next((n for n, x in LANGUAGES.items() if m and x.ext == m[1]), None)
