import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from tidelens.llm import bpe, packing

FILE = path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(FILE)
AUTOMATON, TOKENS = bpe.automaton(FILE), packing.Tokens(FILE)

pieces = st.sampled_from(["a", "aaaa", " ", "    ", "the", "ing", "\n", "\n\n", "'s", "'ll", "123", "==", "é", "漢", "😀", "<|endoftext|>", " ", " ", "\x00", "_", "Hello", "ation"])


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(pieces, max_size=50).map("".join)))
def test_equals_the_library(text):
    ids = REFERENCE.encode(text, add_special_tokens=False).ids
    assert AUTOMATON.encode(text) == ids
    assert AUTOMATON.decode(ids) == REFERENCE.decode(ids, skip_special_tokens=False)
    assert TOKENS(text).tolist() == ids


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 100_000, "ab" * 50_000, "thequick" * 9000, "=" * 50_000 + "x"])
def test_very_long_words(text):
    ids = REFERENCE.encode(text, add_special_tokens=False).ids
    assert AUTOMATON.encode(text) == ids
    assert TOKENS(text).tolist() == ids


def test_gadgets_on_a_small_vocabulary(tmp_path):
    """Every word over three letters, against merging by rank."""
    import json
    from itertools import product

    merges = [("a", "b"), ("a", "a"), ("ab", "a"), ("b", "ab"), ("aa", "aa"), ("c", "c"), ("cc", "cc"), ("aba", "b"), ("bab", "c")]
    vocab = {}
    for x in [*"abc", *(u + v for u, v in merges)]:
        vocab.setdefault(x, len(vocab))
    file = tmp_path / "v.json"
    file.write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": [list(m) for m in merges]}}))
    a = bpe.Automaton(str(file))

    def merge(word):
        parts = list(word)
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return parts

    for n in range(1, 9):
        for word in map("".join, product("abc", repeat=n)):
            assert [a.label[i].decode() for i in a.word(word)] == merge(word), word


def test_encode_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode_documents(docs, FILE).collect():
        ids = REFERENCE.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_plan_is_optimal():
    """Against the same recurrence with all pairs of places."""
    rng = random.Random(3)
    for _ in range(300):
        length, hard = rng.choice([5, 8, 20]), rng.choice([1, 3])
        places = [0]
        for _ in range(rng.randint(1, 40)):
            places.append(places[-1] + rng.randint(1, length))
        penalty = [rng.randint(0, 4) for _ in places]
        cost, back = packing.plan(places, penalty, length, hard)
        best = [0.0]
        for j in range(1, len(places)):
            options = []
            for i in range(j):
                gap = places[j] - places[i]
                if gap <= length:
                    options.append(best[i] + length - gap)
                if length <= gap <= 2 * length:
                    options.append(best[i] + 2 * length - gap + hard)
            best.append(min(options) + penalty[j])
        assert cost == best


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack(docs, FILE, ids=True).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc, g in got.groupby("doc_id"):
        want = [*REFERENCE.encode(texts[doc], add_special_tokens=False).ids, 1]
        g = g.sort_values("start")
        assert [i for x in g.ids for i in x] == want
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and (g.doc_tokens == len(want)).all()
    assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(got.ids, got.ids_crc32, strict=True))
    full = []
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        full.append(int(g.length.sum()))
    padding = sum(2048 - n for n in full if n & (n - 1))
    assert max(full) <= 2048 and padding < 0.01 * sum(full)


SPACES = ["a" + " " * 1_000_000 + "b", " " * 5_000_000, "x\t" + "\t" * 1_500_000, "\n" * 1_200_000 + " y", "a b " + " \n" * 700_000 + "<|endoftext|> c", "z" * 1_500_000]


def test_very_long_white_space(spark):
    """Runs of a million characters and more, in the operator itself; repeated rows count."""
    rows = [*enumerate(SPACES), (0, SPACES[0]), (9, "plain"), (9, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.pack(docs, FILE, ids=True).toPandas()
    for doc, text in dict(rows).items():
        want = [*REFERENCE.encode(text, add_special_tokens=False).ids, 1]
        copies = sum(d == doc for d, _ in rows)
        g = got[got.doc_id == doc]
        assert g.length.sum() == copies * len(want) and (g.doc_tokens == len(want)).all()
        if copies == 1:
            assert [i for x in g.sort_values("start").ids for i in x] == want
    assert (got.start == 0).sum() == len(rows)


def test_streams_bound_memory(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small = packing.pack(docs, FILE, packing=packing.Packing(length=64, stream=500)).toPandas()
    assert small.groupby("sequence_id").length.sum().max() <= 64
    assert small.groupby("doc_id").length.sum().eq(small.groupby("doc_id").doc_tokens.first()).all()


def test_other_vocabularies_are_refused(tmp_path):
    import json

    data = json.load(open(FILE))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": data["model"] | {"ignore_merges": True}}, {"added_tokens": [data["added_tokens"][0] | {"lstrip": True}]}):
        file = tmp_path / "other.json"
        file.write_text(json.dumps(data | change))
        for reader in (bpe.Automaton, packing.Tokens):
            with pytest.raises(ValueError, match="not supported"):
                reader(str(file))


def test_full_memories_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 50)
    monkeypatch.setattr(bpe, "CELLS_KEPT", 60)
    rng, a = random.Random(9), bpe.Automaton(FILE)
    for _ in range(60):
        text = " ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 12))) for _ in range(30))
        assert a.encode(text) == REFERENCE.encode(text, add_special_tokens=False).ids
    assert len(a.words) <= 50 and len(a.cells) <= 61
