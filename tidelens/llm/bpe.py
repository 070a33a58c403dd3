"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens; its paths from the start are exactly the correct
tokenizations. It begins with one state per byte and every arc present, and each merge
(u, v) -> w is one gadget, applied in rank order:

* the arc on v leaves the state after u (the pair would have been merged);
* an arc on w is added wherever an arc on u leads to a state that has one on v;
* the state after w is a copy of the state after v, as it was before the gadget.

A state is thus the last token read, so the automaton is deterministic. Written out for
50,000 merges it has 2.5e9 cells, so the gadgets are kept as three tables (rank, left
and right part of each token, plus the removed arcs) and a row's cell is filled in when a
transition first asks for it: the cell is followed back through the gadgets that made it.

A pre-split word is encoded by the one path that spells it. The longest token that
continues the path is tried first; a dead end goes back one arc, and positions known to be
dead are not entered twice, so the work is linear in the word's length. Decoding emits
the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from itertools import islice

import regex
from pyspark.sql import DataFrame

from .common import id_column, map_rows

#: Fixed value: the byte-level pre-split of the vocabulary files.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and cells that a worker remembers, about 100 MB each; the older half goes when they are full.
WORDS_KEPT, CELLS_KEPT = 500_000, 1_000_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """A vocabulary file of the tokenizers library; ValueError for what these operators do not do.

    They do byte-level BPE with the usual pre-split, without normaliser, prefix space, dropout, unknown token, affixes
    or ignored merges, and with special tokens that are found as they are written.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, split = data["model"], data.get("pre_tokenizer") or {"type": "ByteLevel"}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += ["normalizer"] if data.get("normalizer") else []
    if model.get("type", "BPE") != "BPE" or split["type"] != "ByteLevel" or split.get("add_prefix_space", False) or not split.get("use_regex", True):
        odd.append("pre_tokenizer or model")
    odd += [x["content"] for x in data.get("added_tokens", []) if any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if odd:
        raise ValueError(f"{path}: not supported: {', '.join(odd)}")
    return data


def forget(kept: dict) -> None:
    """Drop the older half."""
    for k in list(islice(kept, len(kept) // 2)):
        del kept[k]


class Automaton:
    """The compiled automaton of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        data = read_vocabulary(path)
        letters, model = byte_letters(), data["model"]
        spell = lambda s: bytes(letters[c] for c in s)
        special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        ids = {spell(k): v for k, v in model["vocab"].items() if k not in special}
        self.label: list[bytes] = [b""] * (1 + max([*ids.values(), *special.values()]))
        for k, v in ids.items():
            self.label[v] = k
        for k, v in special.items():
            self.label[v] = k.encode()
        #: Per token: the gadget that made it (0 for bytes) and its two parts.
        self.made, self.left, self.right = ([0] * len(self.label) for _ in range(3))
        self.removed: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"], 1):
            u, v = (ids[spell(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            if not self._arc(u, v):
                continue  # no path holds the pair: the gadget changes nothing
            w = ids[self.label[u] + self.label[v]]
            if self.made[w] or len(self.label[w]) < 2:
                raise ValueError(f"two merges make the token {self.label[w]!r}: its state would depend on which")
            self.removed[u << 32 | v] = rank
            self.made[w], self.left[w], self.right[w] = rank, u, v
        self.cells: dict[int, bool] = {}
        #: The trie of all labels, as one table (node, byte) -> node, and the token that ends at a node.
        self.step: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for word, i in ids.items():
            if len(word) > 1 and not self.made[i]:
                continue  # no path builds it
            node = 0
            for b in word:
                key = node << 8 | b
                if key not in self.step:
                    self.step[key] = len(self.ends)
                    self.ends.append(-1)
                node = self.step[key]
            self.ends[node] = i
        self.words: dict[str, tuple[int, ...]] = {}
        self.text = [str(i) for i in range(len(self.label))]
        self.special = regex.compile("|".join(sorted(map(regex.escape, special), key=len, reverse=True))) if special else None
        self.special_ids = special
        self.split = regex.compile(PRE_SPLIT).findall

    def arc(self, x: int, y: int) -> bool:
        """Whether the state after token x has an arc on token y."""
        key = x << 32 | y
        got = self.cells.get(key)
        if got is None:
            if len(self.cells) >= CELLS_KEPT:
                forget(self.cells)
            got = self.cells[key] = self._arc(x, y)
        return got

    def _arc(self, x: int, y: int) -> bool:
        """Follow the cell back through the gadgets, last first; `at` is the gadget it must hold before."""
        made, removed, at = self.made, self.removed, 1 << 60
        while True:
            if removed.get(x << 32 | y, at) < at:
                return False
            a, b = made[x], made[y]
            if not a and not b:
                return True
            if b >= a:
                # The arc on y came with its gadget, wherever an arc on its left part was left, that gadget's own removal included.
                at, y = b + 1, self.left[y]
            else:
                # The state x is a copy of the state after its right part, before the gadget.
                at, x = a, self.right[x]

    def word(self, w: str) -> tuple[int, ...]:
        """The token ids of one pre-split word."""
        data = w.encode("utf-8", "surrogatepass")
        step, ends, cells, n = self.step.get, self.ends, self.cells, len(data)
        path: list[int] = []  # tokens so far
        after: list[int] = []  # where each ends
        other: list[list[int]] = []  # shorter tokens not tried yet at each place, shortest first, with their ends
        dead: set[int] = set()
        at, last = 0, -1
        while at < n:
            node, i, todo = 0, at, []
            while i < n:
                node = step(node << 8 | data[i])
                if node is None:
                    break
                i += 1
                if ends[node] >= 0:
                    todo += (ends[node], i)
            while True:
                while todo:
                    to, t = todo.pop(), todo.pop()
                    if to in dead:
                        continue
                    if last >= 0:
                        ok = cells.get(last << 32 | t)
                        if not (self.arc(last, t) if ok is None else ok):
                            continue
                    break
                else:
                    dead.add(at)
                    path.pop()
                    after.pop()
                    todo = other.pop()
                    at, last = (after[-1], path[-1]) if path else (0, -1)
                    continue
                break
            path.append(t)
            after.append(to)
            other.append(todo)
            at, last = to, t
        return tuple(path)

    def encode(self, text: str) -> list[int]:
        """The token ids of a text; strings of special tokens in it become those tokens."""
        out: list[int] = []
        parts = [text]
        if self.special and (found := self.special.findall(text)):
            parts = self.special.split(text)
        words = self.words
        for k, part in enumerate(parts):
            for w in self.split(part):
                ids = words.get(w)
                if ids is None:
                    ids = self.word(w)
                    if len(w) < 64:
                        if len(words) >= WORDS_KEPT:
                            forget(words)
                        words[w] = ids
                out += ids
            if k < len(parts) - 1:
                out.append(self.special_ids[found[k]])
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of token ids: their labels one after another; broken UTF-8 becomes U+FFFD."""
        label = self.label
        return b"".join([label[i] for i in ids]).decode("utf-8", "replace")


_loaded: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file, compiled once per Python process."""
    if path not in _loaded:
        _loaded[path] = Automaton(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per input row.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the UTF-8 of
    the text decoded from the ids. Whole texts are encoded; null and empty texts have no
    token; repeated rows and null ids give a row each; an empty table gives an empty
    result; other columns of docs are not read. vocabulary: path of the vocabulary file,
    there on every machine; a file of another kind, or one in which two merges make the same
    token, is a ValueError.
    """

    def make():
        a = automaton(vocabulary)

        def f(cols):
            out = [cols[0], [], [], []]
            for text in cols[1]:
                ids = a.encode(text or "")
                out[1].append(len(ids))
                names = a.text
                out[2].append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                out[3].append(hashlib.sha256(a.decode(ids).encode()).hexdigest())
            return out

        return f

    key, kind = id_column(docs, id_col)
    return map_rows(docs.select(key, docs[text_col]), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
