"""Secret scans in DataFrame expressions only.

Three fixed patterns give the base spans. The entropy scan looks at candidate strings
(long unbroken runs), slides a window over them and keeps the Shannon
entropy by incremental counts: a character that enters or leaves changes one count and
one term. A run is reported when a window reaches the limit of its character class,
which follows from the class's alphabet and the window, and no allow-list pattern matches the whole run. Everything happens inside the row: no
shuffle, no join, no Python on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
#: Letters in either case, spelt out: no other letter folds to them.
_KEY = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # runs are maximal, so those of 24 or more need no length check
ALPHABET = "0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz+/_=-"
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: The characters of a whole run, and how many a random key of the class draws from; the first match holds, one-case hex comes before.
CLASSES = (
    ("^[0-9a-fA-F]+$", 22),
    ("^(?:[a-z]+|[A-Z]+)$", 26),
    ("^[A-Z2-7]+$", 32),
    ("^(?:[a-z0-9]+|[A-Z0-9]+)$", 36),
    ("^[A-Za-z]+$", 52),
    ("^[A-Za-z0-9]+$", 62),
    ("^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])", 64),
)
#: What ordinary words don't have: five consonants on end (common clusters count as one), capitals and small letters in turn.
_ODD = "(?i:(?:(?>sch|ch|ck|th|ph|ng|st|[b-df-hj-np-tv-xz])){5})|[a-z][A-Z][a-z][A-Z]"
#: Runs that are no secrets: UUIDs, numbers, ordered alphabets, words joined to a path or slug.
ALLOW = (
    "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "^[0-9+/_=-]+$",
    "(?i)^.*(?:0123456789|abcdefghij).*$",
    f"^(?=[A-Za-z])(?!.*(?:[0-9]{{5}}|[A-Za-z][0-9]|[0-9][A-Za-z]|[-_/=+]{{2}}|[-_/=+]$|{_ODD}))",
    f"^(?=[A-Za-z]+[0-9]{{0,4}}[-_/=+])(?!.*(?:[0-9]{{5}}|[0-9][A-Za-z]|(?<![A-Za-z])[A-Za-z](?![A-Za-z])|{_ODD}))",
)
MARK = "[SECRET]"
BLOCK = 1024  # characters of a text that redaction looks up together


def least_bits(alphabet: int, window: int, margin: float = 0.35) -> float:
    """The entropy that `window` random characters of an alphabet have on average, less a margin that few fall below."""
    lost = sum(math.comb(window, c) * alphabet ** (1 - c) * (1 - 1 / alphabet) ** (window - c) * c * math.log2(c) for c in range(2, window + 1))
    return math.log2(window) - lost / window - margin


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(a: Column, op: Callable[[Column, Column], Column] = lambda x, y: x + y, size: int = 512) -> Column:
    """Running sums (or another op that 0 does not change) of an array of longs, in blocks so that long arrays stay far from quadratic."""
    zero = F.lit(0).cast("long")

    def block(start: Column, values: Column) -> Column:
        sums = F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))
        return F.slice(sums, F.lit(2), F.size(values))

    def step(acc: Column, i: Column) -> Column:
        return _bind(block(acc["s"], F.slice(a, i * size + 1, F.lit(size))), lambda p: F.struct(F.element_at(p, -1).alias("s"), F.concat(acc["a"], F.array(p)).alias("a")))

    start = F.struct(zero.alias("s"), F.array().cast("array<array<bigint>>").alias("a"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int"))
    return F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(F.aggregate(blocks, start, step)["a"]))


def _matches(text: Column, hit: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<s, e, g>> of the leftmost non-overlapping matches: code points [s, e), and a group's text."""
    none = F.array().cast("array<struct<s:bigint,e:bigint,g:string>>")

    def place(whole: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        steps = F.zip_with(gaps, whole, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        ends = F.zip_with(_bind(steps, lambda a: _running(a)), whole, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("g")))
        if not group:
            return ends
        return F.zip_with(ends, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x, g: F.struct(x["s"].alias("s"), x["e"].alias("e"), g.alias("g")))

    return F.when(hit, _bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(none)


def _peak(run: Column, window: int) -> Column:
    """The highest Shannon entropy, in bits, of any `window` neighbouring characters of run."""
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def peak(codes: Column) -> Column:
        moves = F.flatten(
            F.transform(
                codes,
                lambda c, i: F.concat(
                    F.when(i >= window, F.array(F.struct(F.get(codes, i - window).alias("c"), F.lit(-1).alias("d"), F.lit(False).alias("m")))).otherwise(F.array().cast("array<struct<c:int,d:int,m:boolean>>")),
                    F.array(F.struct(c.alias("c"), F.lit(1).alias("d"), (i >= window - 1).alias("m"))),
                ),
            )
        )

        def step(acc: Column, x: Column) -> Column:
            n = F.get(acc["n"], x["c"])
            return _bind(
                acc["t"] + term(n + x["d"]) - term(n),
                lambda t: F.struct(
                    F.transform(acc["n"], lambda v, j: F.when(j == x["c"], v + x["d"]).otherwise(v)).alias("n"),
                    t.alias("t"),
                    F.when(x["m"], F.greatest(acc["h"], F.lit(math.log2(window)) - t / window)).otherwise(acc["h"]).alias("h"),
                ),
            )

        start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("t"), F.lit(0.0).alias("h"))
        return F.aggregate(moves, start, step)["h"]

    return _bind(F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), peak)


def _spans(text: Column, window: int, hex_bits: float, other_bits: float, allow: tuple[str, ...]) -> Column:
    """array<struct<s, k, e>>: all spans by start, then kind; k is the kind's place in KINDS."""
    separator = text.contains("=") | text.contains(":")
    found = [
        F.filter(_matches(text, separator & text.rlike(ASSIGN), ASSIGN, 2), lambda x: F.length(x["g"]) >= 6),
        F.filter(_matches(text, text.contains("AKIA"), ACCESS), lambda x: x["e"] - x["s"] >= 20),
        _matches(text, text.rlike(HEX), HEX),
    ]

    def secret(x: Column) -> Column:
        run, ok = x["g"], F.lit(True)
        for p in allow:
            ok = ok & ~run.rlike(p)
        bits = F.when(run.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(hex_bits))
        for p, alphabet in CLASSES:
            bits = bits.when(run.rlike(p), F.lit(least_bits(alphabet, window)))
        bits = bits.otherwise(F.lit(other_bits))
        return F.when(ok, _peak(run, window) >= bits).otherwise(F.lit(False))

    found.append(F.filter(_matches(text, text.rlike(CANDIDATE), CANDIDATE), secret))

    def of_kind(k: int) -> Callable[[Column], Column]:
        return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))

    return F.array_sort(F.concat(*(F.transform(a, of_kind(k)) for k, a in enumerate(found))))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, hex_bits: float = 3.0, other_bits: float = 4.0, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy), one row per input row.

    Spans are code points of the whole match, end exclusive, as kind:start:end by start,
    then kind, comma-joined; base_sha256 is over the first three kinds, spans holds all.
    hex_bits is the limit of one-case hex, other_bits that of runs of no class in CLASSES.
    An entropy span may cover a base span: both are listed. Null and empty texts have no
    span (base_sha256 is that of the empty string); texts are searched whole; repeated
    rows and null ids give a row each; an empty table gives an empty result; other
    columns of docs, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), _spans(text, window, hex_bits, other_bits, allow).alias("all"))
    count = lambda k: F.size(F.filter("all", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = _listed(F.filter("all", lambda x: x["k"] < 3))
    return found.select("doc_id", *(count(k) for k in range(3)), F.sha2(base, 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"), count(3))


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", window: int = 20, hex_bits: float = 3.0, other_bits: float = 4.0, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs with every span of scan() replaced by MARK; overlapping spans become one mark.

    count_col, if given, gets the length of changed texts. Null texts and texts without
    a span stay as they are, as do all other columns; no row is dropped.
    """
    name = "_spans"
    while name in docs.columns:
        name += "_"
    text = F.col(text_col)
    found = docs.withColumn(name, _spans(F.coalesce(text, F.lit("")), window, hex_bits, other_bits, allow))

    def clean(blocks: Column, ends: Column) -> Column:
        def between(start: Column, end: Column | None) -> Column:
            """The characters from start to end, out of the blocks that hold them."""
            first = F.floor(start / BLOCK).cast("int")
            count = F.size(blocks) if end is None else F.floor((end - 1) / BLOCK).cast("int") - first + 1
            held, at = F.array_join(F.slice(blocks, first + 1, F.greatest(F.lit(0), count)), ""), (start - first * BLOCK + 1).cast("int")
            return F.substr(held, at) if end is None else F.substr(held, at, (end - start).cast("int"))

        def part(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(ends, i - 1), F.lit(0).cast("long"))
            gap = F.when(x["s"] > before, between(before, x["s"])).otherwise(F.lit(""))
            return F.when(x["s"] >= before, F.concat(gap, F.lit(MARK))).otherwise(F.lit(""))

        return F.concat(F.array_join(F.transform(F.col(name), part), ""), between(F.element_at(ends, -1), None))

    # Blocks and running ends keep the work linear: the text is walked once, and a span looks at its own blocks.
    whole = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    reach = _bind(F.transform(F.col(name), lambda x: x["e"]), lambda e: _running(e, F.greatest))
    hit = F.size(name) > 0
    out = found.withColumn(text_col, F.when(hit, _bind(whole, lambda b: _bind(reach, lambda r: clean(b, r)))).otherwise(text))
    if count_col in docs.columns:
        out = out.withColumn(count_col, F.when(hit, F.length(text_col).cast(docs.schema[count_col].dataType)).otherwise(F.col(count_col)))
    return out.select(*docs.columns)
