"""Draws from hand-labelled sets of any size: by the hash of each target, whatever the blocks."""

import hashlib

from tidelens.functions.hashing import Endings
from tidelens.operators import annotation


def test_hash_of_many_endings():
    texts = [b"", b"|1", b"|22", b"|-7", "|é".encode(), b"|" + b"x" * 60, *(b"|%d" % i for i in range(300))]
    ends = Endings(texts)
    for before in ([b""], [b"0|1", b"9|2"], [b"0|123456|1"], [b"y" * 53], [b"z" * 80]):
        for b, row in zip(before, ends.firsts(before), strict=True):
            assert [int(x) for x in row] == [int.from_bytes(hashlib.md5(b + t).digest()[:4]) for t in texts]


def _brute(golden, targets, n, draws, exclude):
    out = set()
    for e in targets:
        for d in range(1, draws + 1):
            pos = 0
            for label in sorted({x for _, x in golden}, key=lambda x: (x is not None, x)):
                own = [i for i, x in golden if x == label and not (exclude and (i is None or e is None or i == e))]
                key = lambda i: hashlib.md5("|".join(str(x) for x in (0, e, d, i) if x is not None).encode()).hexdigest()
                for i in sorted(own, key=key)[:n]:
                    pos += 1
                    out.add((e, d, i, label, pos))
    return out


def test_draws_over_several_blocks(spark, monkeypatch):
    golden = [(i, None if i % 7 == 0 else i % 3) for i in range(400)] + [(None, 1)]
    targets = [0, 5, 399, 12345, None]
    g, t = spark.createDataFrame(golden, "id long, answer int"), spark.createDataFrame([(x,) for x in targets], "id long")
    for pool in (50, 65_536):
        monkeypatch.setattr(annotation, "_POOL", pool)
        for exclude in (True, False):
            got = annotation.few_shots(g, t, 4, 3, exclude_target=exclude).collect()
            assert len(got) == len(set(got)) and {tuple(r) for r in got} == _brute(golden, targets, 4, 3, exclude)


def test_no_limit_of_rows(spark):
    """Sets beyond 100,000 rows used to be an error."""
    golden = spark.range(100_001).selectExpr("id", "id % 2 as answer")
    got = annotation.few_shots(golden, spark.range(2), 1, 1).collect()
    assert {(r.eval_id, r.label) for r in got} == {(0, 0), (0, 1), (1, 0), (1, 1)} and len(got) == 4


def test_prompts_of_repeated_and_empty_sets(spark):
    golden = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (2, 1, None)], "id long, answer int, text string")
    targets = spark.createDataFrame([(9, "q"), (9, "longer q"), (8, None)], "id long, text string")
    rows = annotation.prompts(golden, targets, "s", 1000, 2, 1).collect()
    said = sorted([m.content for m in r.messages if m.role == "user"] for r in rows)
    assert len(said) == 3 and all(sorted(x[:2]) == ["a", "b"] and x[2] == "" for x in said) and {x[3] for x in said} == {"q", "longer q", ""}
    none = annotation.prompts(golden.where("id > 5"), targets, "s", 1000, 2, 1).collect()
    assert len(none) == 3 and all(len(r.messages) == 2 and r.fits for r in none)


def test_draws_by_place(spark):
    golden = [(i, None if i % 7 == 0 else i % 3) for i in range(60)] + [(None, 1), (500, 9), (501, 9)]
    targets = list(range(0, 4000, 5)) + [None]
    g, t = spark.createDataFrame(golden, "id long, answer int"), spark.createDataFrame([(x,) for x in targets], "id long")
    got = annotation.few_shots_by_place(g, t, 4, 3).collect()
    by = {}
    for r in got:
        assert (r.shot_id, r.label) in golden
        by.setdefault((r.eval_id, r.draw), []).append(r)
    assert set(by) == {(e, d) for e in targets for d in (1, 2, 3)}
    for rows in by.values():
        rows.sort(key=lambda r: r.pos)
        assert [r.pos for r in rows] == list(range(1, 19)) and [r.label for r in rows] == [None] * 4 + [0] * 4 + [1] * 4 + [2] * 4 + [9] * 2
        assert len({(r.shot_id, r.label) for r in rows}) == 18
    assert len({tuple(r.shot_id for r in by[e, 1]) for e in targets}) == len(targets) and by[0, 1] != by[0, 2]
    own = [x for x in golden if x[1] == 2]
    for pos in range(13, 17):  # every example is as likely at every place
        seen = [sum(r.shot_id == i and r.pos == pos for r in got) for i, _ in own]
        even = 3 * len(targets) / len(own)
        assert sum((n - even) ** 2 / even for n in seen) < 45, seen
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, annotation.few_shots_by_place(g.repartition(3), t, 4, 3).collect()), key=repr)
    assert annotation.few_shots_by_place(g.where("id > 600"), t, 4, 3).isEmpty()


def test_counted_draws_do_not_compare_every_target_with_the_whole_set(spark, sf):
    """SMP5 used to hash every pair of a target's draw and an example, in Python."""
    from tidelens.plans.queries import QUERIES

    plan = QUERIES["SMP5"](spark, sf)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan and "_n" in plan


def test_short_texts_of_all_lengths_are_hashed_together():
    """Each length used to be hashed apart, so few texts of a length took nearly as long as many."""
    texts = [b"|%d" % i for i in range(0, 30_000, 3)] + [b"|" + b"x" * 40, b""]
    ends = Endings(texts)
    assert [len(at) for at, _ in ends.parts] == [10_001, 1]
    for before in ([b"0|7|1"], [b"0|123456789|1", b"0|987654321|2"], [b"z" * 50]):
        for b, row in zip(before, ends.firsts(before), strict=True):
            assert row.tolist() == [int.from_bytes(hashlib.md5(b + t).digest()[:4]) for t in texts]
