"""Phrase collocations with hashed pruning of each next length.

Three passes over the texts count words, then pairs, then triples. Each pass also counts the
phrases of the next length in a fixed number of buckets; the buckets that reach the least count
become a bitmap. The next pass counts only phrases whose bucket is in the bitmap and whose
parts are frequent (a second bitmap, of the phrases found so far). Bitmaps let false
phrases through but lose none, and what they let through is counted exactly, so the counts
are exact whatever the bitmaps' size. They have BUCKETS bits each at any size of
input, which bounds what is broadcast and what a task holds.

Tasks sum up what they read before anything is shuffled, and write their counts as a table:
a pass is one scan whose two results, counts and buckets, are read from there.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, shared_dir, small, tidy


@dataclass(frozen=True)
class PhraseParams:
    least: int = 10  # occurrences of a phrase
    swallowed: int = 50  # percent of a phrase's occurrences inside one longer phrase that drop it
    top: int = 2000  # phrases of a language
    buckets: int = 25  # bits of a bucket's number
    words: int = 1 << 20  # different words after which a task passes its sums on
    phrases: int = 1 << 22  # the same for different phrases


BREAKS = b".,;:!?\n\x0b\x0c\r"
TOKEN = re.compile(rb"[.,;:!?\n-\r]|[^\x20\t.,;:!?\n-\r]+")
CUT = re.compile(rb"[\x20\t.,;:!?\n-\r]")
TILE = 15  # bits of a bucket's place in its tile, the unit in which bucket counts are shuffled
BITS = 21  # of a word's number in a task, so that three fit in 63
BATCH = 1 << 20  # words that are counted at a time
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # any odd numbers


def chunks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """data in pieces of about size, cut before blanks and breaks only."""
    at = 0
    while at < len(data):
        cut = CUT.search(data, at + size)
        to = cut.start() if cut else len(data)
        yield data[at:to]
        at = to


class Numbers(dict):
    """The words of a language; a word not seen before gets the next number of the lexicon."""

    def __init__(self, lexicon: Lexicon, lang: int) -> None:
        super().__init__((bytes([b]), 0) for b in BREAKS)
        self.lexicon, self.lang = lexicon, lang

    def __missing__(self, word: bytes) -> int:
        self.lexicon.names.append(word)
        self.lexicon.lang.append(self.lang)
        self[word] = n = len(self.lexicon.names) - 1
        return n


class Lexicon:
    """Numbers from 1 for the pairs (language, word) of a task; 0 is a break between pieces."""

    def __init__(self) -> None:
        self.names, self.lang, self.langs = [b""], [0], []
        self.numbers: dict[str, Numbers] = {}
        self.hashes = np.zeros(1, np.uint64)

    def of(self, lang: str) -> Numbers:
        if lang not in self.numbers:
            self.numbers[lang] = Numbers(self, len(self.langs))
            self.langs.append(lang)
        return self.numbers[lang]

    def encode(self, lang: str, chunk: bytes) -> np.ndarray:
        """The numbers of the words and breaks of a piece of text in lower case."""
        return np.array(list(map(self.of(lang).__getitem__, TOKEN.findall(chunk))), np.int64)

    def name(self, n: int) -> tuple[str, bytes]:
        return self.langs[self.lang[n]], self.names[n]

    def hashed(self) -> np.ndarray:
        """A hash of each (language, word)."""
        if (have := len(self.hashes)) < len(self.names):
            more = [word_hash(self.langs[g], w) for g, w in zip(self.lang[have:], self.names[have:], strict=True)]
            self.hashes = np.append(self.hashes, np.array(more, np.uint64))
        return self.hashes


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, 42)


def bucket(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """The bucket of phrases, given the hashes of their words."""
    h = np.zeros(len(hashes[0]), np.uint64)
    for x, odd in zip(hashes, ODD, strict=False):
        h = (h ^ h >> np.uint64(29)) * np.uint64(ODD[0]) + x * np.uint64(odd)
    h = (h ^ h >> np.uint64(32)) * np.uint64(ODD[1])
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Bitmap:
    """The set bits of the buckets, as little-endian bytes."""

    def __init__(self, data: bytes, bits: int) -> None:
        self.data, self.bits = np.frombuffer(data, np.uint8), bits

    def has(self, hashes: list[np.ndarray]) -> np.ndarray:
        b = bucket(hashes, self.bits)
        return (self.data[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


class Buckets:
    """Counts that stop at `enough`, one byte each."""

    def __init__(self, bits: int, enough: int) -> None:
        self.bits, self.enough = bits, min(enough, 255)
        self.counts: np.ndarray | None = None

    def add(self, hashes: list[np.ndarray]) -> None:
        if self.counts is None:
            self.counts = np.zeros(1 << self.bits, np.uint8)
        b, n = np.unique(bucket(hashes, self.bits), return_counts=True)
        self.counts[b] = np.minimum(self.counts[b] + n, self.enough)

    def tiles(self) -> Iterator[tuple[int, bytes]]:
        if self.counts is not None:
            size = 1 << min(TILE, self.bits)
            for i, tile in enumerate(self.counts.reshape(-1, size)):
                if tile.any():
                    yield i, pa.compress(tile, codec="zstd", asbytes=True)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, each with the sum of its counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


class Sums:
    """Counts of packed phrases, merged whenever as many wait as are merged."""

    def __init__(self) -> None:
        self.whole = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        found = np.unique(keys, return_counts=True)
        self.waiting.append(found)
        self.size += len(found[0])
        if self.size > max(BATCH, 2 * len(self.whole[0])):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.whole, *self.waiting]
        self.whole, self.waiting = added(*(np.concatenate(x) for x in zip(*parts, strict=True))), []
        self.size = len(self.whole[0])
        return self.whole


def _counted(docs: DataFrame, words: int, bitmaps: list, params: PhraseParams) -> DataFrame:
    """One pass: (lang, phrase, n) per task for phrases of so many words, and (tile, data) of the buckets of the next length.

    bitmaps: none for words; for longer phrases the broadcast bitmap of their parts and that of their buckets.
    """
    bits, enough = params.buckets, params.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [Bitmap(b.value, bits) for b in bitmaps]
        buckets = Buckets(bits, enough) if words < 3 else None
        lexicon, sums, seen = Lexicon(), Sums(), np.zeros(1, np.int64)
        waiting, held = [], 0

        def count() -> None:
            """Count the phrases that begin at all numbers that wait but the last few: those begin phrases that may go on."""
            nonlocal waiting, held, seen
            a, h = np.concatenate([np.zeros(0, np.int64), *waiting]), lexicon.hashed()
            n = max(0, len(a) - words)
            waiting, held = [a[n:].copy()], 0
            pair = (a[:-1] > 0) & (a[1:] > 0)
            if words == 1:
                new = np.bincount(a[:n], minlength=len(lexicon.names))
                new[: len(seen)] += seen
                seen, at = new, np.flatnonzero(pair)
                buckets.add([h[a[at]], h[a[at + 1]]])
                return
            if words == 2:
                frequent = maps[0].has([h])
                pair &= frequent[a[:-1]] & frequent[a[1:]]
            at = np.flatnonzero(pair)
            pair[at[~maps[3 - words].has([h[a[at]], h[a[at + 1]]])]] = False
            if words == 2:
                at = np.flatnonzero(pair[:n])
                sums.add(a[at] << BITS | a[at + 1])
            at = np.flatnonzero(pair[:-1] & pair[1:])
            three = [h[a[at]], h[a[at + 1]], h[a[at + 2]]]
            if words == 2:
                buckets.add(three)
            else:
                at = at[maps[1].has(three)]
                sums.add((a[at] << BITS | a[at + 1]) << BITS | a[at + 2])

        def put() -> Iterator[pa.RecordBatch]:
            """The sums so far; all but what waits begins anew."""
            nonlocal lexicon, sums, seen, waiting
            if words == 1:
                keys = np.flatnonzero(seen[1:]) + 1
                n = seen[keys]
            else:
                keys, n = sums.merge()
            names, langs = pa.array(lexicon.names, pa.binary()), pa.array(lexicon.langs, pa.string())
            lang_of = np.array(lexicon.lang)
            for i in range(0, len(keys), 1 << 16):
                part = keys[i : i + (1 << 16)]
                ids = [part >> BITS * k & (1 << BITS) - 1 for k in range(words - 1, -1, -1)]
                phrase = names.take(pa.array(ids[0])) if words == 1 else pc.binary_join_element_wise(*(names.take(pa.array(x)) for x in ids), b" ")
                m = len(part)
                yield _batch([langs.take(pa.array(lang_of[ids[0]])), phrase.cast(pa.string()), pa.array(n[i : i + m]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())])
            old, lexicon, sums, seen = lexicon, Lexicon(), Sums(), np.zeros(1, np.int64)
            again = [old.name(i) if i else None for i in np.concatenate(waiting).tolist()]
            waiting = [np.array([lexicon.of(x[0])[x[1]] if x else 0 for x in again], np.int64)]

        for batch in batches:
            for b in pieces([batch]):
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    for chunk in chunks(text.lower()):  # of bytes: A-Z only
                        waiting.append(lexicon.encode(lang, chunk))
                        held += len(waiting[-1])
                        if held >= BATCH or len(lexicon.names) >= params.words:
                            count()
                        if len(lexicon.names) >= params.words or sums.size >= params.phrases:
                            yield from put()
                    waiting.append(np.zeros(1, np.int64))
        waiting.append(np.zeros(words, np.int64))
        count()
        yield from put()
        if buckets:
            yield from _tiles(buckets)

    return docs.mapInArrow(tidy(run), COUNTED)


COUNTED = "lang string, phrase string, n long, tile int, data binary"


def _batch(arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "n", "tile", "data"])


def _tiles(buckets: Buckets) -> Iterator[pa.RecordBatch]:
    for i, data in buckets.tiles():
        yield _batch([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([i], pa.int32()), pa.array([data], pa.binary())])


def _parts(phrases: DataFrame, params: PhraseParams) -> DataFrame:
    """(tile, data): the buckets that phrases (lang, phrase) are in, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(params.buckets, 1)
        for b in batches:
            words = [[word_hash(lang, w) for w in p.split(b" ")] for lang, p in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True)]
            if words:
                buckets.add([np.array(x, np.uint64) for x in zip(*words, strict=True)])
        yield from _tiles(buckets)

    return phrases.select("lang", "phrase").mapInArrow(tidy(run), COUNTED)


def _bitmap(tiles: DataFrame, enough: int, params: PhraseParams):
    """The broadcast bitmap of the buckets whose counts in (tile, data) add up to enough: 1 << params.buckets bits."""
    size, most = 1 << min(TILE, params.buckets), min(enough, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(size, np.uint16)

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= most, bitorder="little").tobytes()], pa.binary())], names=["tile", "data"])

        for b in batches:
            for tile, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tile != now:
                    if now is not None:
                        yield bits()
                    now, total = tile, np.zeros(size, np.uint16)
                total = np.minimum(total + np.frombuffer(pa.decompress(data, size, codec="zstd"), np.uint8), most).astype(np.uint16)
        if now is not None:
            yield bits()

    spark = tiles.sparkSession
    rows = tiles.where("tile IS NOT NULL").select("tile", "data").repartition("tile").sortWithinPartitions("tile").mapInArrow(tidy(run), "tile int, data binary").collect()
    whole = bytearray((1 << params.buckets) // 8)
    for r in rows:
        whole[r.tile * size // 8 : (r.tile + 1) * size // 8] = r.data
    return spark.sparkContext.broadcast(bytes(whole))


def _frequent(counted: DataFrame, params: PhraseParams) -> DataFrame:
    return counted.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= params.least)


def count_phrases(docs: DataFrame, folder: str, params: PhraseParams = PhraseParams(), text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(words, pairs, triples) as (lang, phrase, n) of those with n of at least params.least, and (lang, n) of all words; kept below folder."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    found, bitmaps, totals = [], [], None
    for words in (1, 2, 3):
        counted = kept(_counted(rows, words, bitmaps, params), f"pass-{words}")
        if words == 1:
            totals = counted.where("phrase IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
        found.append(kept(_frequent(counted, params), f"phrases-{words}"))
        if words < 3:
            old, bitmaps = bitmaps, [_bitmap(_parts(found[-1], params), 1, params), _bitmap(counted, params.least, params)]
            for b in old:
                b.unpersist()
    return (*found, totals)


def _score(a: str, left: str, right: str) -> str:
    """SQL for floor(1000000 * a * a / (left * right)); decimals, for the products pass 64 bits."""
    return f"(CAST(1000000 AS DECIMAL(38,0)) * {a} * {a}) div (CAST({left} AS DECIMAL(38,0)) * {right})"


def collocations(docs: DataFrame, folder: str | None = None, params: PhraseParams = PhraseParams(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two or three words.

    Texts are read whole, A-Z in lower case, in pieces between .,;:!? and line ends; null texts have no word, null
    languages are "und". a counts a phrase, l and r its two parts at the cut that scores lowest (of equal
    scores the first), n all words of the language. A pair of which a triple has params.swallowed percent or
    more is dropped. Order: score, then a, both descending, then the phrase by its bytes. Repeated rows
    count as often as they occur; an empty table, or one without frequent phrases, gives an empty
    result; other columns of docs are not read. folder: a new folder that driver and executors share.
    """
    spark = docs.sparkSession
    words, pairs, triples, totals = count_phrases(docs, folder or f"{shared_dir(spark)}/phrases-{uuid.uuid4().hex}", params, text_col, lang_col)

    def with_count(df: DataFrame, of: DataFrame, part: str, name: str) -> DataFrame:
        return df.join(of.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])

    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    longer = triples.select("lang", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"), F.col("n").alias("most"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    two = pairs.withColumnRenamed("n", "a").join(longer, ["lang", "phrase"], "left")
    two = two.where(F.coalesce(100 * F.col("most") < params.swallowed * F.col("a"), F.lit(True)))
    two = with_count(with_count(two.withColumns({"p": first, "q": last}), words, "p", "l"), words, "q", "r")
    two = two.select("lang", "phrase", "a", "l", "r", F.expr(_score("a", "l", "r")).alias("score"))
    three = triples.withColumnRenamed("n", "a").withColumns({"p": first, "q": F.substring_index("phrase", " ", -2), "s": F.substring_index("phrase", " ", 2), "t": last})
    for of, part, name in ((words, "p", "l1"), (pairs, "q", "r1"), (pairs, "s", "l2"), (words, "t", "r2")):
        three = with_count(three, of, part, name)
    cuts = F.least(*(F.struct(F.expr(_score("a", f"l{k}", f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)))
    three = three.select("lang", "phrase", "a", cuts.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # The best of a language are among the best of its parts, so no window holds all phrases of a language.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = two.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= params.top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= params.top)
    found = found.join(small(totals, 100_000), "lang")
    return found.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM t
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\t]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) AS v(k)
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10
), halves AS (
  SELECT c.lang, c.phrase, c.k, c.a, j, array_to_string(w[1:j], ' ') AS p, array_to_string(w[j + 1:c.k], ' ') AS q FROM c, (VALUES (1), (2)) AS v(j) WHERE j < c.k
), cuts AS (
  SELECT h.lang, h.phrase, h.k, h.a, j, f1.n AS l, f2.n AS r,
    CAST((CAST(1000000 AS HUGEINT) * h.a * h.a) // (CAST(f1.n AS HUGEINT) * f2.n) AS BIGINT) AS score
  FROM halves h JOIN f AS f1 ON f1.lang = h.lang AND f1.phrase = h.p JOIN f AS f2 ON f2.lang = h.lang AND f2.phrase = h.q
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3
  ) GROUP BY ALL
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer g USING (lang, phrase) WHERE s.k = 3 OR most IS NULL OR 100 * most < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
