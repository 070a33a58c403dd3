"""HTML entities as expressions against the standard library."""

import html
import random

from pyspark.sql import functions as F

from tidelens.functions import text


def test_unescape(spark):
    rng = random.Random(7)
    names = sorted(html.entities.html5)
    bits = ["&", ";", "#", "x", " ", "amp", "lt;", "notit;", "é", "&&amp;", "&amp;lt;", "<b>", "\n", "&#", "&#x", "&;", "0", "&#0;", "&#x0d;", "&#128;", "&#x9F", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#xFFFFFFFFFFFFFFFFF;", "&#11;", "&#xfdd0;", "&#x1FFFE;", "&#x1F600;", "&#65", "&#000000000065;"]
    cases = ["", None, "plain", *(f"a&{n}b" for n in names), *(f"&{n}" for n in names), *(f"&#{c};&#x{c:X}" for c in [*range(0, 300), 0x2022, 0xFFFD, 0xFFFE, 0x10FFFF, 0x110000])]
    cases += ["".join(rng.choice([*bits, "&" + rng.choice(names), "&" + rng.choice(names)[:-1]]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, s string").select("i", "s", text.unescape(F.col("s")).alias("u"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    wrong = [(r.s, r.u, html.unescape(r.s)) for r in df.collect() if r.s is not None and r.u != html.unescape(r.s)]
    assert wrong[:5] == [] and df.where("s IS NULL AND u IS NOT NULL").count() == 0
