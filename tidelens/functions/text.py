"""Text of posts: markup, code sections, tag lists and parsed answers."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

#: What opens and closes a code block in post bodies.
OPENERS = ("<pre><code>", '<pre class="lang-none prettyprint-override"><code>', '<pre class="lang-py prettyprint-override"><code>')
CLOSER = "</code></pre>"
GAP = "\n\n\n"
SECTIONS = ArrayType(StructType([StructField("off_beg", IntegerType()), StructField("off_end", IntegerType()), StructField("span_str", StringType())]))


def remove_tags(s: Column) -> Column:
    """Text without <...>; a tag does not cross a line feed."""
    return F.regexp_replace(s, "<[^>\\n]*>", "")


#: A reference by number or name, with or without its semicolon.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\x0C <&#;]{1,32};?)"
#: Names that also count without a semicolon, even with more after them.
LEGACY = {k: v for k, v in html5.items() if not k.endswith(";")}
#: Numbers that stand for other characters: null, and those that Windows' code page has where Unicode has controls.
REPLACED = {0: "\ufffd", 13: "\r"} | {c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}


def _map(entries: dict[str, str]) -> Column:
    """A map that the optimizer folds into one literal."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _by_number(body: Column) -> Column:
    """The character of #123; or #x1f;: controls and places without a character go, what is no code point becomes U+FFFD."""
    is_hex = body.rlike("^#[xX]")
    digits = F.regexp_replace(F.regexp_replace(body, "^#[xX]?|;$", ""), "^0+(?=.)", "")
    code = F.when(F.length(digits) > F.when(is_hex, 8).otherwise(9), F.lit(0x110000)).when(is_hex, F.conv(digits, 16, 10).cast("long")).otherwise(digits.try_cast("long"))

    def character(c: Column) -> Column:
        gone = c.between(1, 8) | (c == 0xB) | c.between(0xE, 0x1F) | (c == 0x7F) | c.between(0xFDD0, 0xFDEF) | (c.bitwiseAND(0xFFFE) == 0xFFFE)
        other = F.element_at(_map({str(k): v for k, v in REPLACED.items()}), c.cast("string"))
        return F.when(other.isNotNull(), other).when(c.between(0xD800, 0xDFFF) | (c > 0x10FFFF), "\ufffd").when(gone, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))

    return F.element_at(F.transform(F.array(code), character), 1)


def _by_name(reference: Column, body: Column) -> Column:
    """The character of amp; or amp, else the longest older name that the body begins with, else the reference as it is."""
    legacy = _map(LEGACY)
    begins = [F.when(F.length(body) > n, F.concat(F.element_at(legacy, F.substring(body, 1, n)), F.substr(body, F.lit(n + 1)))) for n in range(max(map(len, LEGACY)), 1, -1)]
    return F.coalesce(F.element_at(_map(html5), body), *begins, reference)


def unescape(s: Column) -> Column:
    """All HTML entities, once, as in HTML 5."""
    found = F.transform(F.regexp_extract_all(s, F.lit(REFERENCE), F.lit(0)), lambda m: F.transform(F.array(F.substr(m, F.lit(2))), lambda b: F.when(b.startswith("#"), _by_number(b)).otherwise(_by_name(m, b)))[0])
    parts = F.zip_with(F.split(s, REFERENCE, -1), found, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit(""))))
    return F.when(s.contains("&"), F.array_join(parts, "")).otherwise(s)


def unescape_basic(s: Column) -> Column:
    """The five entities that nearly all bodies use, without Python; &amp; last."""
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(value))
    return s


def clean_html(s: Column) -> Column:
    """Tags first, then entities: an escaped tag stays as text."""
    return unescape(remove_tags(s))


def fence_code(s: Column) -> Column:
    """Code blocks as fenced blocks."""
    return F.regexp_replace(F.regexp_replace(s, '<pre( class="[^"]*")?><code>', "```python\n"), "</code></pre>", "```")


def scrub_semicolons(s: Column) -> Column:
    """Without semicolons that something other than white space follows."""
    return F.regexp_replace(s, ";(?=\\S)", "")


def question_text(title: Column, body: Column) -> Column:
    none = F.lit("None")
    return F.concat(F.lit("<Title>"), F.coalesce(title, none), F.lit("</Title>. <Question>"), F.coalesce(body, none), F.lit("</Question> "))


def tag_list(tags: Column) -> Column:
    """Names in <a><b> notation."""
    return F.regexp_extract_all(tags, F.lit("<(.*?)>"), F.lit(1))


def has_tag(tags: Column, tag: str) -> Column:
    return tags.contains(f"<{tag}>")


def any_tag(tags: Column, names: list[str]) -> Column:
    """Whether <a><b> notation holds one of the names, whatever characters they have."""
    return tags.rlike("|".join(re.escape(f"<{n}>") for n in names)) if names else F.lit(False)


def level_of(answer: Column) -> Column:
    """The digit after the first level mark, else null."""
    return F.regexp_extract(answer, "<Difficulty Level>\\s*(\\d)\\s*", 1).try_cast("int")


def keep_chars(s: Column, chars: str) -> Column:
    """Only characters of a regex class such as 0-9."""
    return F.regexp_replace(s, f"[^{chars}]", "")


def id_of_file(name: Column) -> Column:
    """id in {row}_{id}.{ext}."""
    return F.split_part(F.split_part(name, F.lit("_"), F.lit(2)), F.lit("."), F.lit(1)).try_cast("int")


def first_number(s: Column) -> Column:
    return F.regexp_extract(s, "(\\d+)", 1).try_cast("long")


def sections_of(body: str | None) -> list[tuple[int, int, str]]:
    """Code sections of an unescaped body: the k-th opener with the k-th closer; none if the numbers differ."""
    text = html.unescape(body or "")
    starts = []
    for o in OPENERS:
        at = text.find(o)
        while at >= 0:
            starts.append(at + len(o))
            at = text.find(o, at + 1)
    ends, at = [], text.find(CLOSER)
    while at >= 0:
        ends.append(at)
        at = text.find(CLOSER, at + 1)
    if len(starts) != len(ends):
        return []
    return [(a, b, text[a:b]) for a, b in zip(sorted(starts), ends, strict=True)]


#: Bodies that are Python strings at the same time.
SOME = 64
_ARROW = pa.list_(pa.struct([("off_beg", pa.int32()), ("off_end", pa.int32()), ("span_str", pa.string())]))


@F.arrow_udf(SECTIONS)
def code_sections(body: pa.Array) -> pa.Array:
    found = [pa.array([[{"off_beg": a, "off_end": e, "span_str": t} for a, e, t in sections_of(b)] for b in body.slice(i, SOME).to_pylist()], _ARROW) for i in range(0, len(body), SOME)]
    return pa.concat_arrays(found) if found else pa.array([], _ARROW)


@F.arrow_udf(BooleanType())
def has_sections(body: pa.Array) -> pa.Array:
    """Whether a body has code sections, without their texts."""
    return pa.array([bool(sections_of(b.as_py())) for b in body], pa.bool_())


def _joined(sections: Column, pick: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(sections, pick), GAP)


def code_text(sections: Column) -> Column:
    """The code of all sections."""
    return _joined(sections, lambda x: x["span_str"])


def prose_text(unescaped: Column, sections: Column) -> Column:
    """The text between the sections; offsets are those of the same, unescaped text."""
    n = F.size(sections)
    bounds = F.sequence(F.lit(0), n)
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(sections, i - 1)["off_end"])
    end = lambda i: F.when(i == n, F.length(unescaped)).otherwise(F.get(sections, i)["off_beg"])
    return F.array_join(F.transform(bounds, lambda i: F.substr(unescaped, start(i) + 1, F.greatest(end(i) - start(i), F.lit(0)))), GAP)
