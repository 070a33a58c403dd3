"""Sampling, prompts, votes and agreement for annotated posts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.hashing import Endings
from ..sources.adapters import scratch
from .network import kept
from .numbering import numbered


def draw_key(seed: int, *parts: str | Column) -> Column:
    """A deterministic random order: the same for the same seed and ids, on any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p) if isinstance(p, str) else p for p in parts)))


def sample_per(df: DataFrame, group: list[Column | str], n: int, key: str = "id", seed: int = 0) -> DataFrame:
    """n rows of each group without replacement, all where there are fewer."""
    w = Window.partitionBy(*group).orderBy(draw_key(seed, key), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def with_run(df: DataFrame, day: Column, base: int, step: int = 1) -> DataFrame:
    """Adds ver: a run id per day, in the order of days. Ranks the distinct days, not the rows."""
    days = df.select(day.alias("_d")).distinct().withColumn("ver", (F.lit(base) + (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_d")) - 1) * step).cast("int"))
    return df.withColumn("_d", day).join(days, "_d").drop("_d")


#: System prompts by name; {levels} becomes the list of levels, {topic} what the questions are about.
TEMPLATES = {
    "plain": "Rate how hard the question about {topic} is. Answer with one of {levels}.",
    "tagged": "You grade questions about {topic}. Choose one of {levels} and answer as <Difficulty Level>n</Difficulty Level>, nothing else.",
    "reasoned": "You grade questions about {topic}. First say in one sentence what somebody must know to answer, then choose one of {levels} and end with <Difficulty Level>n</Difficulty Level>.",
    "strict": "Grade the question about {topic} as one of {levels}. If it is no question, grade it as the first. Answer as <Difficulty Level>n</Difficulty Level>.",
}


def system_prompt(template: str, topic: Column, levels: dict[int, str]) -> Column:
    """The named template for a topic, with levels such as "0 (basic), 1 (advanced)"."""
    listed = ", ".join(f"{k} ({v})" for k, v in sorted(levels.items()))
    return F.replace(F.lit(TEMPLATES[template].replace("{levels}", listed)), F.lit("{topic}"), topic)


#: Rows of a hand-labelled set; it travels with every task as one array.
GOLDEN_ROWS = 100_000


def _pool(golden: DataFrame, item: Column) -> DataFrame:
    """One row with all of a hand-labelled set; an error if it is none by its size."""
    if golden.limit(GOLDEN_ROWS + 1).count() > GOLDEN_ROWS:
        raise ValueError(f"a hand-labelled set has at most {GOLDEN_ROWS} rows")
    return F.broadcast(golden.groupBy().agg(F.sort_array(F.collect_list(item)).alias("_g")))


#: Hand-labelled rows and targets that one task takes at once; and how many groups of both there are for a core, where there is work for them.
_POOL, _TARGETS, _FEWEST, _PER_CORE = 65_536, 20_000, 100, 8


def _drawn(pool: DataFrame, targets: DataFrame, per_class: int, draws: int, exclude_target: bool, seed: int) -> DataFrame:
    """(eval_id, draw, _s), a row per distinct target and draw that has any: per_class items of each class in pool, by label and then by draw_key().

    pool: (shot_id, label, ..), the items of _s; targets: (eval_id). Every target is compared with the whole pool, as its order is its
    own: both are dealt to groups, each of which takes some targets with a block of the pool and keeps the least hashes of each class. Blocks
    are put together by target. Work grows with targets times pool; what a task holds does not.
    """
    names, spark = pool.columns, pool.sparkSession
    text = lambda c: F.col(c).cast("string")
    asked = targets.select("eval_id").distinct()
    if exclude_target:  # as it is for a comparison with null
        pool, asked = pool.where("shot_id is not null"), asked.where("eval_id is not null")
    blocks, n = -(-pool.count() // _POOL) or 1, asked.count() * draws
    tiles = max(min(_PER_CORE * spark.sparkContext.defaultParallelism, n // _FEWEST), -(-n // _TARGETS), 1)
    asked = asked.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_before", F.concat_ws("|", F.lit(str(seed)), "eval_id", "draw"))
    asked = asked.select("eval_id", "draw", "_before", text("eval_id").alias("_own"), F.pmod(F.xxhash64("eval_id", "draw"), F.lit(tiles)).cast("int").alias("_tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    items = pool.select(F.struct(*names).alias("g"), F.col("label"), text("shot_id").alias("_text"), F.pmod(F.xxhash64("shot_id"), F.lit(blocks)).cast("int").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_tile"))
    schema = StructType([asked.schema["eval_id"], asked.schema["draw"], StructField("k", BinaryType()), items.schema["g"]])

    def least(t: pa.Table, g: pa.Table) -> pa.Table:
        labels = g["label"].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        order = np.argsort(labels, kind="stable")
        classes = np.split(order, np.flatnonzero(np.diff(labels[order])) + 1) if len(order) else []
        shots = g["_text"].to_pylist()
        ends = Endings([b"" if x is None else b"|" + x.encode() for x in shots])
        places, sizes, own = defaultdict(list), defaultdict(list), t["_own"].to_pylist()
        for i, x in enumerate(shots if exclude_target else []):
            places[x].append(i)
        before = [x.encode() for x in t["_before"].to_pylist()]
        for i, x in enumerate(before):
            sizes[len(x)].append(i)
        rows, at, keys, step = [], [], [], ends.together()
        for same in sizes.values() if shots else ():
            for j in range(0, len(same), step):
                some = same[j : j + step]
                for i, first in zip(some, ends.firsts([before[i] for i in some]), strict=True):
                    found = ends.least(before[i], first, per_class, classes, places.get(own[i], []))
                    rows += [i] * len(found)
                    keys += [k for k, _ in found]
                    at += [p for _, p in found]
        rows, at = pa.array(rows, pa.int64()), pa.array(at, pa.int64())
        return pa.table({"eval_id": t["eval_id"].take(rows), "draw": t["draw"].take(rows), "k": pa.array(keys, pa.binary()), "g": g["g"].take(at)})

    dealt = lambda x: x.repartition(tiles * blocks, "_tile", "_block").groupBy("_tile", "_block")
    best = dealt(asked).cogroup(dealt(items)).applyInArrow(least, schema)
    ordered = best.groupBy("eval_id", "draw").agg(F.array_sort(F.collect_list(F.struct("g.label", "k", "g"))).alias("_o"))
    of = lambda x: F.slice(F.filter("_o", lambda g: g["label"].eqNullSafe(x)), 1, per_class)
    return ordered.select("eval_id", "draw", F.transform(F.flatten(F.transform(F.array_distinct(F.transform("_o", lambda g: g["label"])), of)), lambda x: x["g"]).alias("_s"))


def _both(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left with what right has for its target and draw."""
    right = right.withColumnsRenamed({"eval_id": "_e", "draw": "_d"})
    return left.join(right, F.col("eval_id").eqNullSafe(F.col("_e")) & (F.col("draw") == F.col("_d")), how).drop("_e", "_d")


def few_shots(golden: DataFrame, targets: DataFrame, per_class: int, draws: int, label: str = "answer", exclude_target: bool = True, seed: int = 0) -> DataFrame:
    """(eval_id, draw, shot_id, label, pos): per_class golden examples of each class, for every target and draw.

    Both may be of any number of rows. Each target orders all examples by a hash of its own, block by block in tasks that keep the
    first ones, so only those become rows.
    """
    pool = golden.select(F.col("id").alias("shot_id"), F.col(label).alias("label"))
    rows = targets.select(F.col("id").alias("eval_id")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    rows = _both(rows, _drawn(pool, rows, per_class, draws, exclude_target, seed), "inner")
    return rows.select("eval_id", "draw", F.posexplode("_s").alias("pos", "g")).select("eval_id", "draw", "g.shot_id", "g.label", (F.col("pos") + 1).alias("pos"))


def few_shots_by_place(golden: DataFrame, targets: DataFrame, per_class: int, draws: int, label: str = "answer", seed: int = 0) -> DataFrame:
    """(eval_id, draw, shot_id, label, pos): per_class golden examples of each class, without replacement, all where there are fewer, for every target and draw.

    As few_shots() gives them, but by other random numbers: each class is numbered, and a draw takes places of it (Floyd's
    sampling: every set of places is as likely), so work grows with what is drawn and not with targets times examples. The target
    itself may be among them. golden may be of any number of rows; its classes are few.
    """
    pool = numbered(golden.select(F.col("id").alias("shot_id"), F.col(label).alias("label")), [F.col("label"), F.col("shot_id")], "_n")
    classes = pool.groupBy("label").agg(F.min("_n").alias("_from"), F.count("*").alias("_size"))
    classes = classes.withColumn("_before", F.coalesce(F.sum(F.least("_size", F.lit(per_class))).over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = targets.select(F.col("id").alias("eval_id")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).crossJoin(F.broadcast(classes))
    number = lambda n: F.conv(F.substring(draw_key(seed, "eval_id", "draw", F.coalesce(F.col("label").cast("string"), F.lit("-")), n.cast("string")), 1, 15), 16, 10).cast("long")

    def taken(places: Column, last: Column) -> Column:
        one = number(last) % (last + 1)
        return F.array_append(places, F.when(F.array_contains(places, one), last).otherwise(one))

    chosen = F.aggregate(F.sequence(F.greatest(F.col("_size") - per_class, F.lit(0)), F.col("_size") - 1), F.array().cast("array<bigint>"), taken)
    # A late place of the sample is rarely an early place of its class: their order is drawn anew.
    order = F.array_sort(F.transform(chosen, lambda x: F.struct(draw_key(seed, F.lit("order"), "eval_id", "draw", x.cast("string")).alias("k"), (F.col("_from") + x).alias("at"))))
    rows = rows.select("eval_id", "draw", "_before", F.posexplode(order).alias("p", "o"))
    return rows.join(pool, F.col("o.at") == F.col("_n")).select("eval_id", "draw", "shot_id", "label", (F.col("_before") + F.col("p") + 1).cast("int").alias("pos"))


def with_replacement(golden: DataFrame, targets: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(eval_id, pos, shot_id): n independent draws from the golden set, which has at most GOLDEN_ROWS rows."""
    rows = targets.select(F.col("id").alias("eval_id")).withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(n)))).join(_pool(golden, F.col("id")))
    at = F.conv(F.substring(draw_key(seed, "eval_id", "pos"), 1, 12), 16, 10).cast("long") % F.size("_g")
    return rows.select("eval_id", "pos", F.get("_g", at.cast("int")).alias("shot_id"))


def prompts(golden: DataFrame, targets: DataFrame, system: str, max_tokens: int, per_class: int, draws: int, tokens: Callable[[Column], Column] | None = None, reserve: int = 256 + 128, label: str = "answer", exclude_target: bool = True, seed: int = 0) -> DataFrame:
    """(eval_id, draw, messages, fits): system, (user, assistant) per example that few_shots() draws, then the target.

    golden: (id, label, text), targets: (id, text). fits: whether the messages leave the reserve within
    max_tokens; tokens counts a text's tokens (words if not given). That is decided on counts, of which
    a golden text has one for all prompts; messages are null where they do not fit. Texts are joined to the
    examples of prompts that fit, so neither the golden set nor its texts are held by one task. The prompts are written to the
    shared folder once, so that asking a model again draws nothing again.
    """
    count = tokens or (lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    q, a = F.coalesce("text", F.lit("")), F.coalesce(F.col(label).cast("string"), F.lit(""))
    said = golden.select(F.col("id").alias("shot_id"), F.col(label).alias("label"), (count(q) + count(a)).alias("n"), F.md5(q).alias("h"), q.alias("q"), a.alias("a"))
    rows = targets.select(F.col("id").alias("eval_id"), q.alias("target"), count(q).alias("own")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    drawn = kept(_drawn(said.select("shot_id", "label", "n", "h"), rows, per_class, draws, exclude_target, seed), "drawn")
    rows = _both(rows, drawn, "left")
    size = count(F.lit(system)) + F.col("own") + F.coalesce(F.aggregate("_s", F.lit(0), lambda s, x: s + x["n"]), F.lit(0))
    rows = rows.withColumn("fits", size + reserve <= max_tokens)
    shown = rows.where("fits").dropDuplicates(["eval_id", "draw"]).select("eval_id", "draw", F.posexplode("_s").alias("pos", "s")).select("eval_id", "draw", "pos", F.struct("s.shot_id", "s.label", "s.h").alias("_k"))
    texts = said.select(F.struct("shot_id", "label", "h").alias("_t"), "q", "a").dropDuplicates(["_t"])
    turns = shown.join(texts, F.col("_k").eqNullSafe(F.col("_t"))).groupBy("eval_id", "draw").agg(F.array_sort(F.collect_list(F.struct("pos", "q", "a"))).alias("_q"))
    turns = turns.select("eval_id", "draw", F.flatten(F.transform("_q", lambda x: F.array(message("user", x["q"]), message("assistant", x["a"])))).alias("_m"))
    rows = _both(rows, turns, "left")
    empty = F.array().cast("array<struct<role:string,content:string>>")
    messages = F.concat(F.array(message("system", F.lit(system))), F.coalesce("_m", empty), F.array(message("user", F.col("target"))))
    return kept(rows.select("eval_id", "draw", F.when(F.col("fits"), messages).alias("messages"), "fits"), "prompts")


def first_that_fits(candidates: DataFrame) -> DataFrame:
    """Of the prompts drawn for a target, the first that fits; targets without one go."""
    return candidates.where("fits").groupBy("eval_id").agg(F.min_by(F.struct("draw", "messages"), "draw").alias("m")).select("eval_id", "m.*")


def answer(prompted: DataFrame, client: Callable[[], Callable[[list], list[str]]], batch: int = 15) -> DataFrame:
    """(eval_id, draw, result): a model's answer to every prompt, in batches; client() is made once per worker."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = client()
        for f in frames:
            out: list[str] = []
            for i in range(0, len(f), batch):
                out += chat(f["messages"].iloc[i : i + batch].tolist())
            yield pd.DataFrame({"eval_id": f["eval_id"], "draw": f["draw"], "result": out})

    return prompted.select("eval_id", "draw", "messages").mapInPandas(run, "eval_id long, draw int, result string")


def consistent(votes: DataFrame, draws: int, key: str = "id", label: str = "label") -> DataFrame:
    """(key, label) where all draws agree."""
    return votes.groupBy(key, label).agg(F.count("*").alias("votes")).where(F.col("votes") == draws)


def unanimous(votes: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Keys with one distinct label; null counts as one."""
    return votes.groupBy(key).agg(F.count_distinct(F.coalesce(F.col(label).cast("string"), F.lit("-"))).alias("_n")).where("_n = 1").select(key)


def until_unanimous(questions: DataFrame, ask: Callable[[DataFrame, int], DataFrame], draws: int, most: int) -> DataFrame:
    """(id, label, attempt), one row per question (id): asked again and again, `most` times at most, until all draws agree.

    ask(questions, attempt) gives (id, draw, label). An attempt asks only what has not agreed yet, and its answers
    are kept by a checkpoint, so nothing is asked twice. What never agrees has a null label and attempt.
    """
    spark, left, out = questions.sparkSession, questions.select("id"), None
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch(spark))
    for attempt in range(1, most + 1):
        agreed = consistent(ask(left, attempt), draws).select("id", "label", F.lit(attempt).alias("attempt")).checkpoint()
        out = agreed if out is None else out.union(agreed)
        left = left.join(agreed.select("id"), "id", "left_anti").checkpoint()
        if left.isEmpty():
            break
    return out.union(left.select("id", F.lit(None).cast(out.schema["label"].dataType).alias("label"), F.lit(None).cast("int").alias("attempt")))


def plurality(votes: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """(key, label, votes): the label with most votes, ties to the smaller label."""
    w = Window.partitionBy(key).orderBy(F.desc("votes"), label)
    counts = votes.groupBy(key, label).agg(F.count("*").alias("votes"))
    return counts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def golden_set(votes: DataFrame, raters: int, special: int, key: str = "id", label: str = "label") -> DataFrame:
    """(key, label): agreed by all raters, or by all but one for the special label."""
    n = votes.groupBy(key, label).agg(F.count("*").alias("n"))
    return n.where((F.col("n") == raters) | ((F.col("n") == raters - 1) & (F.col(label) == special))).select(key, label)


def accuracy(df: DataFrame, by: list[str], gold: str = "gold", label: str = "label") -> DataFrame:
    """Percent equal per group and over all (null group)."""
    hit = F.avg((F.col(gold) == F.col(label)).cast("double")) * 100
    return df.rollup(*by).agg(hit.alias("accuracy"), F.count("*").alias("n")) if by else df.agg(hit.alias("accuracy"), F.count("*").alias("n"))


def class_report(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class, then macro, weighted and accuracy rows."""
    pairs = df.groupBy(F.col(true).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    per = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = per.withColumn("precision", zero(F.try_divide("hit", "said"))).withColumn("recall", zero(F.try_divide("hit", "support")))
    per = per.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    names = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro avg").alias("class"), *(F.avg(c).alias(c) for c in names), F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("class"), *((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names), F.sum("support").alias("support"))
    acc = F.sum("hit") / F.sum("support")
    accuracy_row = per.agg(F.lit("accuracy").alias("class"), *(acc.alias(c) for c in names), F.sum("support").alias("support"))
    return per.select("class", *names, "support").unionByName(macro).unionByName(weighted).unionByName(accuracy_row)


def next_open_day(target: DataFrame, done: DataFrame, day: Column) -> DataFrame:
    """One row (ver, day, open): the earliest day of target with rows that are not done, and how many."""
    open_ = target.join(done.select("ver", "id"), ["ver", "id"], "left_anti").withColumn("day", day)
    return open_.groupBy("ver", "day").agg(F.count("*").alias("open")).orderBy("ver", "day").limit(1)
