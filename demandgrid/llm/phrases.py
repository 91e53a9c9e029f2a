"""Phrase collocations by mergeable Misra-Gries summaries and an exact second pass.

Texts (A-Z lower-cased, null counts as empty) are split at ``.,;:!?`` and line breaks
into pieces, pieces at spaces and tabs into words.  Per language a phrase is a run of
2 to ``longest`` words inside a piece that occurs ``min_count`` times or more.

1. Every map task counts the hashes of its 1- to ``longest``-grams.  Hash space is cut
   into partitions; a flush of the task gives each partition one summary.
2. The summaries of a partition are merged as Misra-Gries summaries.  The partition's
   mass is known before its first counter is read (mass rows sort first), so its
   capacity is mass / min_count + 1: all decrements together stay below min_count, and
   no n-gram with min_count occurrences can lose its counter.  What a counter and the
   decrements cannot lift to min_count is dropped.
3. The survivors' hashes set bits of a map (bounded by ``MAX_BITS``; partitions are
   segments of it).  The second pass counts the n-grams with a set bit as texts, so
   neither a shared bit nor a shared hash changes a count.  A full map would only let
   more n-grams through to the exact count.
4. Scores are joins of the counted phrases with the counts of their two parts.

Memory of a task: ``CHUNK`` bytes of text as words (a longer text is cut at a piece's
end; a single piece without end is held whole), ``FLUSH`` counters, or one partition's
summary (``PART_MASS`` / min_count counters).

Defined cases: null language is ``und``, null text is empty, repeated rows count each
time, no rows give no rows; ids and other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demandgrid.llm.common import LOWER_BYTES, lean, saved

LONGEST = 3
MIN_COUNT = 10
TOP = 2000
#: Percent of a phrase's occurrences that a longer candidate around it may hold.
INSIDE = 50
CHUNK = 2 << 20
FLUSH = 1 << 20
PART_MASS = 1 << 26
MAX_BITS = 29
#: Word lists of a language are ranked in so many parts before they are ranked as one.
PARTS = 64

#: Lower case; piece ends become line feeds, tabs spaces.
TABLE = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else LOWER_BYTES[c] for c in range(256))
SUMMARIES = "part int, kind int, mass bigint, hashes binary, counts binary"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a list of texts: ``ids`` into ``distinct``, ``piece`` numbers that never mix texts."""

    def __init__(self, texts: list[bytes]) -> None:
        tokens = b"\n".join(texts).replace(b"\n", b" \n ").split(b" ")
        ids, distinct = pd.factorize(np.array(tokens, dtype=object))
        ids = ids[np.array([len(w) > 0 for w in distinct], bool)[ids]]
        ends = np.array([w == b"\n" for w in distinct], bool)[ids]
        self.distinct = distinct
        self.ids = ids[~ends].astype(np.int64)
        self.piece = np.cumsum(ends)[~ends]

    def starts(self, n: int) -> np.ndarray:
        """Whether an n-gram starts at a word."""
        if n == 1:
            return np.ones(len(self.ids), bool)
        return self.piece[: 1 - n] == self.piece[n - 1 :] if len(self.ids) >= n else np.zeros(0, bool)

    def hashes(self, lang: str, longest: int) -> Iterator[np.ndarray]:
        """The hashes of the 1-, 2-, … grams that start at every word (with room for them)."""
        seed = xxhash.xxh32_intdigest(lang.encode())
        words = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.distinct], np.uint64)
        each = words[self.ids]
        h = each
        yield h
        for n in range(2, longest + 1):
            h = _mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + each[n - 1 :])
            yield h


def _cut(text: bytes) -> Iterator[bytes]:
    """The text, if it is long in blocks that end where a piece ends."""
    at = 0
    while len(text) - at > CHUNK:
        end = text.rfind(b"\n", at, at + CHUNK) + 1 or text.find(b"\n", at + CHUNK) + 1 or len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """The words of (lang, text) rows, chunk by chunk and by language."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            for block in _cut(text.as_buffer().to_pybytes().translate(TABLE)) if text.is_valid else ():
                held.setdefault(lang.as_py(), []).append(block)
                size += len(block)
                if size >= CHUNK:
                    yield from ((k, Words(v)) for k, v in held.items())
                    held, size = {}, 0
    yield from ((k, Words(v)) for k, v in held.items())


def _folded(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and the sums of their counts."""
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


class Summary:
    """Misra-Gries counters: at most ``capacity``; ``lost`` is what every count may lack."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lost = capacity, 0
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.more.append((hashes, counts))
        self.waiting += len(hashes)
        if self.waiting > max(FLUSH // 2, self.capacity // 2):
            self.merge()

    def merge(self) -> None:
        self.hashes, self.counts = _folded([self.hashes, *[h for h, _ in self.more]], [self.counts, *[c for _, c in self.more]])
        self.more, self.waiting = [], 0
        if len(self.counts) > self.capacity:
            least = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            self.lost += least
            stays = self.counts > least
            self.hashes, self.counts = self.hashes[stays], self.counts[stays] - least

    def frequent(self, threshold: int) -> np.ndarray:
        """Every hash whose count can be ``threshold`` or more."""
        self.merge()
        return self.hashes[self.counts + self.lost >= threshold]


def _summarised(bits: int, longest: int):
    """(lang, text) rows -> the summaries of a task, a row per flush and partition."""

    def flush(hashes, counts):
        h, c = _folded(hashes, counts)
        part = (h >> np.uint64(64 - bits)).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(h)]])
        rows = []
        for a, b in zip(cut[:-1], cut[1:]):
            rows += [(int(part[a]), 0, int(c[a:b].sum()), None, None), (int(part[a]), 1, None, h[a:b].tobytes(), c[a:b].tobytes())]
        kinds = pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["part", "kind", "mass", "hashes", "counts"])

    def run(batches):
        hashes, counts, size = [], [], 0
        for lang, words in _chunks(batches):
            for n, h in enumerate(words.hashes(lang, longest), 1):
                if len(h := h[words.starts(n)]):
                    h.sort()
                    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    hashes.append(h[first])
                    counts.append(np.diff(np.append(first, len(h))))
                    size += len(first)
            if size >= FLUSH:
                yield flush(hashes, counts)
                hashes, counts, size = [], [], 0
        if size:
            yield flush(hashes, counts)

    return run


def _merged(threshold: int):
    """Summaries sorted by (part, kind) -> a row of surviving hashes per partition."""

    def rows(batches):
        for batch in batches:
            yield from zip(*[batch.column(k) for k in range(5)])

    def run(batches):
        for part, own in groupby(rows(batches), key=lambda r: r[0].as_py()):
            mass, summary = 0, None
            for _, kind, m, h, c in own:
                if kind.as_py() == 0:
                    mass += m.as_py()
                else:
                    summary = summary or Summary(mass // threshold + 1)
                    summary.add(np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64))
            found = summary.frequent(threshold)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([len(found)], pa.int64()), "hashes": pa.array([found.tobytes()], pa.binary())})

    return run


def _counted(bitmap, bits: int, longest: int):
    """(lang, text) rows -> the counts, as texts, of the n-grams with a set bit; the word count under a null phrase."""

    def run(batches):
        marks = np.frombuffer(bitmap.value, np.uint8)
        for lang, words in _chunks(batches):
            phrases, counts = [None], [len(words.ids)]
            key = None
            for n, h in enumerate(words.hashes(lang, longest), 1):
                # equal keys are equal n-grams: the number of the (n-1)-gram and the id of the last word
                key = words.ids if n == 1 else np.unique(key[:-1], return_inverse=True)[1] * len(words.distinct) + words.ids[n - 1 :]
                at = h >> np.uint64(64 - bits)
                hit = np.flatnonzero(words.starts(n) & ((marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool))
                _, first, times = np.unique(key[hit], return_index=True, return_counts=True)
                heads = words.ids[hit[first][:, None] + np.arange(n)]
                phrases += [b" ".join(x).decode() for x in words.distinct[heads]] if len(heads) else []
                counts += times.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "a"])

    return run


def frequent_ngrams(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, a: exact counts of every n-gram of 1 to ``longest`` words that occurs
    ``min_count`` times or more; under a null phrase the language's word count."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint")).alias("n")).first()["n"] or 0
    # a text of b bytes has at most b / 2 + 1 words
    bits = max(8, math.ceil(math.log2(1 + longest * size / 2 / PART_MASS)))
    summaries = texts.mapInArrow(lean(_summarised(bits, longest)), SUMMARIES)
    found = saved(summaries.repartition(F.col("part")).sortWithinPartitions("part", "kind").mapInArrow(lean(_merged(min_count)), "part int, n bigint, hashes binary"))
    n = found.agg(F.sum("n").alias("n")).first()["n"] or 0
    width = max(bits + 3, min(MAX_BITS, 4 + n.bit_length()))

    def segments(batches):
        for batch in batches:
            for part, h in zip(batch.column(0), batch.column(2)):
                at = (np.frombuffer(h.as_buffer(), np.uint64) >> np.uint64(64 - width)) & np.uint64((1 << (width - bits)) - 1)
                own = np.zeros(1 << (width - bits), np.uint8)
                own[at] = 1
                yield pa.RecordBatch.from_pydict({"part": pa.array([part.as_py()], pa.int32()), "own": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    # 2 ** width bits in all, whatever the input
    step = 1 << (width - bits - 3)
    bitmap = bytearray(1 << (width - 3))
    for row in found.mapInArrow(segments, "part int, own binary").collect():
        bitmap[row["part"] * step : (row["part"] + 1) * step] = row["own"]
    marks = spark.sparkContext.broadcast(bytes(bitmap))
    counts = texts.mapInArrow(lean(_counted(marks, width, longest)), "lang string, phrase string, a bigint")
    return counts.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("phrase").isNull() | (F.col("a") >= min_count))


def collocations(counted: DataFrame, longest: int = LONGEST, inside: int = INSIDE) -> DataFrame:
    """lang, phrase, n_words, a, l, r, score of every phrase in ``counted`` (of
    ``frequent_ngrams``) that no longer phrase mostly explains.

    Score: the least floor(10**6 * a * a / (l * r)) over the cuts of the phrase, l and r
    the counts of its parts; the smallest cut of equal scores counts."""
    words = F.split("phrase", " ")
    grams = counted.where("phrase IS NOT NULL").withColumn("n_words", F.size(words))
    parts = grams.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    phrases = grams.where("n_words >= 2")
    split = lambda k: (F.array_join(F.slice(words, 1, k), " "), F.array_join(F.slice(words, k + 1, longest), " "))
    cuts = None
    for k in range(1, longest):
        head, tail = split(k)
        at = phrases.where(F.col("n_words") > k).select("lang", "phrase", "a", F.lit(k).alias("k"), head.alias("head"), tail.alias("tail"))
        cuts = at if cuts is None else cuts.union(at)
    part = lambda name: parts.select("lang", F.col("part").alias(name), F.col("f").alias(name[0]))
    scored = (
        cuts.join(part("head").withColumnRenamed("h", "l"), ["lang", "head"]).join(part("tail").withColumnRenamed("t", "r"), ["lang", "tail"])
        .withColumn("score", F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"))
        .groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("best"))
    )
    # the largest count of a longer phrase around each phrase
    spans = [F.array_join(F.slice(words, s, n), " ") for n in range(2, longest) for s in range(1, longest - n + 2)]
    if spans:
        whole = phrases.where("n_words > 2").select("lang", "n_words", "a", "phrase", F.explode(F.array_distinct(F.array(*spans))).alias("inner"))
        around = whole.where("inner <> phrase").groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("a").alias("longer"))
        scored = scored.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    return scored.select("lang", "phrase", F.size(words).alias("n_words"), "a", "best.l", "best.r", "best.score")


def top_phrases(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, longest: int = LONGEST, inside: int = INSIDE) -> DataFrame:
    """The first ``top`` collocations of each language with their rank and the language's word count n.

    Ranked in ``PARTS`` parts of a language first, so that no task sees a whole one."""
    counted = saved(frequent_ngrams(docs, min_count, longest))
    total = counted.where("phrase IS NULL").select("lang", F.col("a").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = collocations(counted, longest, inside).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = dealt.withColumn("_at", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
