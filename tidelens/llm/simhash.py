"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are deduplicated first, so exact copies cost one entry. Two values that
differ in at most three bits agree on one of four disjoint bands, so the bands deal
the values out exactly; a band value with more than `cap` members is dealt again by
four bands of its remaining bits. Inside a task the members are sorted by Gray rank
and a tree is laid over each bucket: every node keeps the bits on which all its
members agree, and a query drops a whole group once the differences accumulated on
the way down exceed the limit. Links are reduced to a forest inside the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_column, map_rows, perhaps, pieces, small, tidy
from .components import connected_components, forest, tree_links

FAN = 16
FRONTIER = 2_000_000
#: Up to so many crowded band values, or ids to drop, are broadcast; more of them are joined by a shuffle.
KEYS_SENT, IDS_SENT = 50_000, 1_000_000
#: Rows that a task of the search takes, and the number of tasks that this may lead to.
TASK_ROWS, MOST_TASKS = 50_000, 200_000
#: Shingles that a block of members of a large group of candidates holds.
BLOCK = 1_000_000


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of `size` words, or of all words together where there are fewer."""
    n, h = len(words), xxhash.xxh64_intdigest
    buf = b" ".join(words)
    if n <= size:
        return np.array([h(buf, seed)], "<u8")
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - size + 1].tolist()
    return np.array([h(buf[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], "<u8")


def majorities(hashes: np.ndarray) -> np.ndarray:
    """For each row of hashes, the bits that over half of them set."""
    rows, n = hashes.shape
    counts = np.zeros((rows, 64), np.int64)
    for i in range(0, n, 255):  # so many ones fit a byte
        part = np.ascontiguousarray(hashes[:, i : i + 255])
        bits = np.unpackbits(part.view(np.uint8).reshape(rows, -1, 8), axis=2, bitorder="little")
        counts += bits.sum(1, dtype=np.uint8)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8")[:, 0]


def words_of(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text, unsigned.

    Words are runs of other than ASCII white space, A-Z in lower case; shingles are
    `size` words joined by a space, repeats included. Fewer words: one shingle of all.
    No word (null, empty, blank): 0. A bit is set if over half of the shingles' XXH64
    values set it.
    """
    words = words_of(text)
    return int(majorities(shingle_hashes(words, size, seed)[None])[0]) if words else 0


def spread(hashes: np.ndarray, number: int) -> np.ndarray:
    """(number, n): independent 64-bit hashes of each hash, by the finaliser of SplitMix64."""
    with np.errstate(over="ignore"):
        z = hashes[None, :] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, number + 1, dtype=np.uint64)[:, None]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key per band: the least values of a set of hashes under `rows` independent hash functions, hashed together.

    Two sets of Jaccard similarity j share a band's key with probability j ** rows.
    """
    least = np.full(bands * rows, ~np.uint64(0))
    for i in range(0, len(hashes), 4096):  # bounds what a long text holds
        least = np.minimum(least, spread(hashes[i : i + 4096], bands * rows).min(1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(bands, rows))], "<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row; fp is the fingerprint as a signed long."""

    def make():
        def f(cols):
            values = np.fromiter((fingerprint(t, size) for t in cols[1]), np.uint64, len(cols[1]))
            return [cols[0], values.view(np.int64)]

        return f

    key, kind = id_column(docs, id_col)
    kind = "string" if kind == "string" else "long"
    return map_rows(docs.select(key.cast(kind), F.col(text_col)), f"doc_id {kind}, fp long", make)


def gray_rank(v: np.ndarray) -> np.ndarray:
    """The position of each value in the binary-reflected Gray order."""
    r = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Trees over buckets of fingerprints in Gray order, all levels in flat arrays."""

    def __init__(self, bucket: np.ndarray, value: np.ndarray) -> None:
        order = np.lexsort((gray_rank(value), bucket))
        self.order, self.value, self.bucket = order, value[order], bucket[order]
        self.levels: list[tuple] = []  # (value, mask, first child, children), leaves first
        v, m, b = self.value, np.full(len(value), ~np.uint64(0)), self.bucket
        while True:
            new = np.r_[True, b[1:] != b[:-1]]
            at = np.flatnonzero(new)
            place = np.arange(len(b)) - np.repeat(at, np.diff(np.r_[at, len(b)]))
            first = np.flatnonzero(place % FAN == 0)
            number = np.diff(np.r_[first, len(b)])
            differs = np.bitwise_or.reduceat(v ^ np.repeat(v[first], number), first)
            m = np.bitwise_and.reduceat(m, first) & ~differs
            v, b = v[first], b[first]
            self.levels.append((v, m, first, number))
            if len(np.unique(b)) == len(b):
                break
        self.top = b

    def pairs(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j), i < j: positions in self.value, of one bucket, that differ in at most limit bits."""
        at = np.searchsorted(self.top, self.bucket)
        work = np.cumsum(np.bincount(at, minlength=len(self.top))[at])
        cuts = np.searchsorted(work, np.arange(FRONTIER, work[-1] + FRONTIER, FRONTIER), "right")
        for lo, hi in zip(np.r_[0, cuts[:-1]], cuts, strict=True):
            yield from self._search(np.arange(lo, hi), at[lo:hi], limit)

    def _search(self, q: np.ndarray, node: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(q):
            return
        v, m, _, _ = self.levels[-1]
        diff = np.bitwise_count((self.value[q] ^ v[node]) & m[node])
        for k in range(len(self.levels) - 1, -1, -1):
            keep = diff <= limit
            q, node, diff = q[keep], node[keep], diff[keep]
            _, above, first, number = self.levels[k]
            each = number[node]
            child = np.repeat(first[node] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            q, diff, seen = np.repeat(q, each), np.repeat(diff, each), np.repeat(above[node], each)
            if k:
                v, m, _, _ = self.levels[k - 1]
                diff = diff + np.bitwise_count((self.value[q] ^ v[child]) & m[child] & ~seen)
            else:
                later = child > q
                q, child, diff, seen = q[later], child[later], diff[later], seen[later]
                diff = diff + np.bitwise_count((self.value[q] ^ self.value[child]) & ~seen)
                keep = diff <= limit
                yield q[keep], child[keep]
            node = child


def _deal(rows: DataFrame, bits: int, carry: list[str]) -> DataFrame:
    """Four rows (fp, carry, rest, key) for each: the key grows by a band of rest, which loses it."""
    width = -(-bits // 4)
    made = []
    for i in range(4):
        start, w = i * width, min(width, bits - i * width)
        band = F.shiftrightunsigned("rest", start).bitwiseAND(F.lit((1 << w) - 1))
        low = F.col("rest").bitwiseAND(F.lit((1 << start) - 1))
        high = F.shiftleft(F.shiftrightunsigned("rest", start + w), start) if start + w < 64 else F.lit(0).cast("long")
        key = F.shiftleft(F.shiftleft(F.col("key"), 2).bitwiseOR(F.lit(i).cast("long")), width).bitwiseOR(band)
        made.append(F.struct(low.bitwiseOR(high).alias("rest"), key.alias("key")))
    return rows.select("fp", *carry, F.explode(F.array(*made)).alias("x")).select("fp", *carry, "x.rest", "x.key")


def _buckets(rows: DataFrame, number: int, cap: int, carry: list[str]) -> DataFrame:
    """(fp, key, carry): rows (fp, key, carry) dealt to band values; crowded ones are dealt again by their other bits.

    number: how many rows there are. The tasks follow it, for a task holds its rows in memory.
    """
    own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(own, min(MOST_TASKS, 4 * number // TASK_ROWS))
    rows, done, bits = rows.withColumn("rest", F.col("fp")), None, 64
    for level in range(3):
        rows = _deal(rows, bits, carry)
        bits -= -(-bits // 4)
        if level < 2:
            large = cut(rows.groupBy("key").count().where(F.col("count") > cap).select("key"))
            if large.isEmpty():
                break
            large = small(large, KEYS_SENT)
            rest = rows.join(large, "key", "left_anti").select("fp", "key", *carry)
            done = rest if done is None else done.union(rest)
            rows = cut(rows.join(large, "key", "left_semi").select("fp", *carry, "rest", "key"))
    rows = rows.select("fp", "key", *carry)
    return (rows if done is None else done.union(rows)).repartition(tasks, "key")


def _columns(batches: Iterator[pa.RecordBatch], number: int) -> list[np.ndarray] | None:
    got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate([g[i] for g in got]) for i in range(number)] if got else None


def links(fps: DataFrame, limit: int = 3, cap: int = 1024) -> DataFrame:
    """(a, b): a forest over the distinct values fp whose trees are joined by links of at most limit bits.

    Links are found per bucket of a band value, so limit is at most 3.
    """
    if not 0 <= limit <= 3:
        raise ValueError("limit must be 0 to 3: four bands prove no more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _columns(batches, 2)
        if got is None:
            return
        index = GrayIndex(got[1], got[0].view(np.uint64))
        value, at = np.unique(index.value.view(np.int64), return_inverse=True)
        yield tree_links(value, forest(len(value), ((at[i], at[j]) for i, j in index.pairs(limit))))

    rows = fps.select("fp", F.lit(1).cast("long").alias("key"))
    return _buckets(rows, fps.count(), cap, []).mapInArrow(tidy(run), "a long, b long")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs (a, b) of ids whose sets (id, hashes: sorted longs without repeats) are that similar (Jaccard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left, right = (sets.select(F.col("id").alias(k), F.col("hashes").alias(f"hashes_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(tidy(run), "a long, b long")


def _group_links(ids: np.ndarray, roots: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links, as places of two members, that join groups: members of unlike roots (and of two sides, if there are two) are compared.

    The largest group is only compared with the others' members, never inside itself, and a link that joins nothing is not returned.
    """
    n, both = np.array([len(x) for x in sets]), len(np.unique(side)) > 1
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(n) - n
    names, group = np.unique(roots, return_inverse=True)
    largest, made = int(np.bincount(group).argmax()), []
    mark = np.zeros(int(code.max(initial=-1)) + 1, bool)
    for x in np.flatnonzero(group != largest):
        able = group != group[x]
        if both:
            able &= side != side[x]
        able &= np.minimum(n, n[x]) >= similarity * np.maximum(n, n[x]) - 1e-9
        if not able.any():
            continue
        own = code[start[x] : start[x] + n[x]]
        mark[own] = True
        common = np.add.reduceat(mark[code], start, dtype=np.int64)
        mark[own] = False
        for y in np.flatnonzero(able & (common >= similarity * (n + n[x] - common) - 1e-9)):
            if group[y] != group[x]:
                made.append((int(x), int(y)))
                group[group == group[y]] = group[x]
    return made


def _with_company(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """members (key, id, n, root) without those that none of the others can be similar to.

    A partner must hold `similarity` of a set's shingles, so a set with more than the rest of them to itself has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), i))], names=["x", "id"])

    each = members.select("id").distinct().join(sets, "id").select("id", "hashes").mapInArrow(tidy(run), "x long, id long")
    own = each.groupBy("x").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count("*").alias("own"))
    own = own.join(sets.groupBy("id").count().where("count > 1"), "id", "left_anti")  # an id that repeats has several sets
    return members.join(own, "id", "left").where(F.coalesce("own", F.lit(0)) <= (1 - similarity) * F.col("n") + 1e-9).select(*members.columns)


def _crowd_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between the members (key, id, n, root) of a key that join all groups that belong together.

    Keys that share members are put together (by their smallest id, twice), so that a member is sent once and not
    once a key. Members are dealt to blocks of about BLOCK shingles and a task compares two blocks at a time: it holds
    no more than these, and returns at most one link for each of their members.
    """
    home = members.groupBy("key").agg(F.min("id").alias("home"))
    for _ in range(2):
        near = members.join(home, "key").groupBy("id").agg(F.min("home").alias("home"))
        home = cut(members.select("key", "id").join(near, "id").groupBy("key").agg(F.min("home").alias("home")))
    member = cut(members.join(home, "key").select("home", "id", "n", "root").distinct())
    size = member.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = member.join(size, "home").withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("home", "id", "root", "side", other).select("home", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "root")
    rows = dealt.join(sets, "id").select("home", "i", "j", "side", "id", "root", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def found() -> pa.RecordBatch:
            side, ids, roots = (np.array([h[k] for h in held], np.int64) for k in range(3))
            links = _group_links(ids, roots, side, [np.frombuffer(h[3], "<u8") for h in held], similarity)
            return pa.RecordBatch.from_arrays([pa.array([int(ids[p[k]]) for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in pieces(batches):
            for home, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (home, i, j) != unit:
                    if held:
                        yield found()
                    unit, held = (home, i, j), []
                held.append(row)
        if held:
            yield found()

    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "home", "i", "j").sortWithinPartitions("home", "i", "j").mapInArrow(tidy(run), "a long, b long")


def _close(nodes: DataFrame) -> DataFrame:
    """(a, b): candidates among nodes (id, fp), by the Gray-order index: each id with the smallest of its fingerprint,
    and these along the trees of fingerprints at most three bits apart."""
    first = cut(nodes.groupBy("fp").agg(F.min("id").alias("first")))
    same = nodes.join(first, "fp").where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = cut(links(first.select("fp"))).join(first.withColumnsRenamed({"fp": "a", "first": "x"}), "a").join(first.withColumnsRenamed({"fp": "b", "first": "y"}), "b")
    return same.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _similar_roots(members: DataFrame, sets: DataFrame, similarity: float, crowd: int, links: DataFrame) -> DataFrame:
    """(id, root) of the ids linked to a smaller one; members: (key, id, n), n the size of the id's set; links: what is known.

    Members of a key are candidates of each other. Up to `crowd` of them are all compared; more of them
    first with one, then with eight, which joins most of a large group of copies at little cost. Of what this leaves
    in different groups, sets too unlike all others go, and the rest is compared block by block: no pair is left out.
    """
    roots = connected_components(links).withColumnsRenamed({"node": "id"})
    members = cut(members.join(roots, "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root")))
    for few in (1, 8, 0):
        if members.isEmpty():
            break
        if few:
            part = F.when(F.col("m") <= crowd, F.col("id")).otherwise(F.pmod(F.xxhash64("id"), F.lit(few)))
            size = cut(members.groupBy("key").agg(F.count("*").alias("m")))
            sized = members.join(size, "key")
            lead = sized.groupBy("key", part.alias("part")).agg(F.min(F.struct("id", "n", "root")).alias("x")).select("key", "x")
            able = (F.col("x.root") != F.col("root")) & (F.least("n", "x.n") >= similarity * F.greatest("n", "x.n") - 1e-9)
            pairs = cut(members.join(lead, "key").where(able).select(F.least("id", "x.id").alias("a"), F.greatest("id", "x.id").alias("b")).distinct())
            new = cut(_similar(pairs, sets, similarity))
        else:
            new = cut(_crowd_links(members, sets, similarity))
        if not new.isEmpty():
            links = cut(links.union(new))
            roots = connected_components(links).withColumnsRenamed({"node": "id"})
        if few:
            # What is left: members of crowded keys that are still in several groups.
            left = members.join(size.where(F.col("m") > crowd).select("key"), "key", "left_semi").drop("root")
            left = cut(left.join(roots, "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root")))
            several = left.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("h")).where("l != h").select("key")
            members = left.join(several, "key", "left_semi")
            members = cut(_with_company(cut(members), sets, similarity) if few == 1 else members)
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, limit: int = 3, cap: int = 1024) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    fingerprint: 16 lowercase hex digits. component_id: the smallest id of the rows
    reachable through fingerprints at most `limit` bits apart, the row's own included.
    Null, empty and blank texts have fingerprint zero and are linked like any other;
    texts count whole whatever their length; equal fingerprints are one component;
    repeated rows stay, each with the same result; a null id is never the smallest
    (a component of null ids only has a null component_id); ids that are no whole numbers
    are text and in the order of text; an empty table gives an
    empty result; other columns of docs, whatever their names, are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col, size))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes.select("fp"), limit, cap))
    nodes = cut(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = cut(nodes.groupBy("root").agg(F.min("least").alias("component_id")))
    member = cut(nodes.join(least, "root").select("fp", "component_id"))
    return fps.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 4, cap: int = 32) -> DataFrame:
    """(doc_id, component_id), one row per row with an id: groups of texts linked by pairs whose
    shingles of `size` words, each counted once, have a Jaccard similarity of `similarity` or more.

    Candidates are found in two ways. The Gray-order index gives texts whose fingerprints of those shingles are at
    most three bits apart, which joins most copies cheaply. Beyond three bits, candidates share one of `bands` keys of
    `rows` least hashes of the shingles: of pairs of similarity 0.8, 3 in a million share none, whatever the edits. Each link is checked
    on the sets of the shingles' 64-bit hashes. Equal sets always share a group, as do texts
    without a word. component_id is the smallest id of the group. Keys of up to `cap` sets have
    all their pairs compared at once.
    Texts count whole; rows with a null id take no part; repeated rows give a row each; an
    empty table gives an empty result; other columns of docs are not read. Ids are whole numbers: others are a ValueError.
    """
    if id_column(docs, id_col)[1] == "string":
        raise ValueError(f"{id_col} must be whole numbers: number the documents first")

    def hashes(text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.unique(shingle_hashes(words, size)) if words else np.array([], "<u8")

    def make():
        def f(cols):
            out: list[list] = [[], [], [], [], []]
            for t in cols[1]:
                found = hashes(t)
                digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8").tolist()
                fp = int(majorities(found[None]).view("<i8")[0]) if len(found) else 0
                for o, v in zip(out, (*digest, fp, len(found), band_keys(found, bands, rows).tobytes()), strict=True):
                    o.append(v)
            return [cols[0], *out]

        return f

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(2).to_pylist()), "<i8")
            at = np.repeat(np.arange(b.num_rows), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["key", "id", "n"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    marks = cut(map_rows(texts, "doc_id long, h long, g long, fp long, n long, bands binary", make))
    nodes = cut(marks.groupBy("h", "g").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bands").alias("bands")))
    dealt = nodes.where("n > 0").select("id", F.col("n").cast("int"), "bands").mapInArrow(tidy(deal), "key long, id long, n int")
    shared = dealt.groupBy("key").count().where("count > 1").select("key")
    members = cut(dealt.join(shared, "key", "left_semi"))
    wanted = cut(members.select(F.col("id").alias("doc_id")).distinct())
    # A repeated id may have several texts: the set of the node is wanted.
    wanted = nodes.select(F.col("id").alias("doc_id"), "h", "g").join(wanted, "doc_id", "left_semi")

    def make_sets():
        def f(cols):
            found = [hashes(t).tobytes() for t in cols[1]]
            digests = [np.frombuffer(xxhash.xxh3_128_digest(x), "<i8").tolist() for x in found]
            return [cols[0], [d[0] for d in digests], [d[1] for d in digests], found]

        return f

    wanted = cut(wanted)
    sent = wanted.count() <= IDS_SENT
    wanted = F.broadcast(wanted) if sent else wanted
    # Beyond what is broadcast, only texts that pass a filter of the ids are shuffled.
    near = texts if sent else texts.where(perhaps(wanted, "doc_id")(F.col("doc_id")))
    sets = map_rows(near.join(wanted.select("doc_id"), "doc_id", "left_semi"), "doc_id long, h long, g long, hashes binary", make_sets)
    sets = cut(sets.join(wanted, ["doc_id", "h", "g"], "left_semi").dropDuplicates(["doc_id", "h", "g"]).select(F.col("doc_id").alias("id"), "hashes"))
    close = cut(_similar(_close(nodes.where("n > 0").select("id", "fp")), sets, similarity))
    roots = _similar_roots(members, sets, similarity, cap, close)
    member = nodes.join(roots, "id", "left").select("h", "g", F.coalesce("root", "id").alias("id"))
    return marks.select("doc_id", "h", "g").join(cut(member), ["h", "g"]).select("doc_id", F.col("id").alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows whose group of similar_documents has a smaller id; all columns as they are.

    Rows that repeat the kept id stay as they came; rows with a null id stay.
    """
    gone = similar_documents(docs, id_col, text_col, size, similarity).where("doc_id != component_id").select(F.col("doc_id").alias(id_col)).distinct()
    gone = cut(gone)
    if gone.count() <= IDS_SENT:
        return docs.join(F.broadcast(gone), id_col, "left_anti").select(*docs.columns)
    # Documents that pass no filter of the ids stay where they are; only the others are shuffled.
    maybe = F.coalesce(perhaps(gone, id_col)(docs[id_col].cast("long")) & docs[id_col].isNotNull(), F.lit(False))
    return docs.where(~maybe).unionByName(docs.where(maybe).join(gone, id_col, "left_anti").select(*docs.columns))
