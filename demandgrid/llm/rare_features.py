"""Document fingerprints: improbable-feature digests in chained Bloom filters.

1. Every window of ``SPAN`` bytes of every text has an entropy, in ``LEVELS`` levels.  A
   first pass over all documents counts the windows of each level (at most LEVELS + 1
   rows reach the driver); the rarer a level, the more improbable a window.  Windows
   with almost no information (under ``DULL``) rank last.
2. In every run of ``RUN`` neighbouring windows (``SHORT_RUN`` in texts of fewer than
   ``SMALL`` windows) the most improbable one (the leftmost of equals) scores a point.
   Windows with a point from one run in ``POPULAR`` that hold them are the features of
   the text; a text with fewer windows than a run is one run, and one shorter than a
   window is one feature (an empty text has none).  Features count once a text.
3. A feature sets ``HASHES`` bits of a ``BITS``-bit Bloom filter.  A filter takes ``FILL``
   features, then the chain goes on with the next one.  The fingerprint is the chain,
   compressed, in base64 (empty without a filter).
4. Two filters are compared by their common bits: 0 at what chance gives (plus
   ``MARGIN`` of the way), 1 where the smaller one is inside the larger.  The likeness
   of two chains is the mean, over the filters of the one with fewer bits (weighed by
   their bits), of the best match in the other; empty chains are alike (1), an empty
   and another one are not (0).

Neighbours (the next document by descending id) come from one range partitioning of
the rows; a task streams its rows in order, and the last row of each partition meets
the first of the next in a second, small job.  Whole texts are read; memory is one
block of texts (``BLOCK`` bytes, or one longer text), some 150 bytes a text byte.

Defined cases: null text is empty; null ids sort last; rows of one id are ordered by
their text's hash; the next of the last row is the first (of a single row, itself);
no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demandgrid.llm.common import saved

SPAN = 16
#: Windows in a run: in texts of SMALL windows or more, and in shorter ones.
RUN, SHORT_RUN, SMALL = 64, 8, 256
#: A feature is the best window of one run in POPULAR of those that hold it.
POPULAR = 4
LEVELS = 1000
DULL = 100
BITS = 2048
HASHES = 5
FILL = 160
MARGIN = 0.1
BLOCK = 1 << 20
STRIDE = 1 << 16

#: count * log2(count) as an integer, so that sums over windows are exact.
PART = np.array([0] + [round(c * np.log2(c) * (1 << 16)) for c in range(1, SPAN + 1)], np.int32)
STEP = np.diff(PART, prepend=0).astype(np.int32)
RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: A row that waits for a neighbour in another partition: the first (0) or last (1) of its own.
WAITING = RESULT + ", edge int, at bigint, text binary"


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy level (0 to LEVELS) of every window of ``data`` (bytes), by its start."""
    n = max(0, len(data) - SPAN + 1)
    out = np.empty(n, np.int32)
    for s in range(0, n, STRIDE):
        # a stretch that the processor's cache holds
        out[s : s + STRIDE] = _levels(data[s : s + STRIDE + SPAN - 1])
    return out


def _levels(data: np.ndarray) -> np.ndarray:
    n = len(data) - SPAN + 1
    before, after = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for lag in range(1, SPAN):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    # the sum of PART over a window's byte counts changes by the byte that leaves, then the one that enters
    total = np.empty(n, np.int32)
    total[0] = PART[np.bincount(data[:SPAN])].sum()
    np.subtract(STEP[before[SPAN:]], STEP[after[: n - 1]], out=total[1:])
    np.cumsum(total, out=total)
    return np.minimum((PART[SPAN] - total) // (PART[SPAN] // LEVELS), LEVELS)


def ranks(counts: dict[int, int]) -> np.ndarray:
    """The place of every level, most improbable first; levels that no text has come before the dull ones."""
    order = sorted(range(LEVELS + 1), key=lambda v: (v < DULL, counts.get(v, 0), v))
    place = np.empty(LEVELS + 1, np.int32)
    place[order] = np.arange(LEVELS + 1)
    return place


def _offsets(texts: list[bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _features(texts: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every feature, in the order of the texts, each once a text."""
    at = _offsets(texts)
    data = np.frombuffer(b"".join(texts) + b"\0" * SPAN, np.uint8)
    size = np.diff(at)
    rank = place[levels(data)][: at[-1]]
    windows = size - SPAN + 1
    chosen = np.zeros(len(rank) + 1, bool)
    # the most improbable window of a run: the least of (rank, position), by doubling
    kind, low = (np.int32, 21) if len(rank) <= 1 << 21 else (np.int64, 40)
    least, width = (rank.astype(kind) << low) | np.arange(len(rank), dtype=kind), 1
    for run, own in ((SHORT_RUN, (windows >= SHORT_RUN) & (windows < SMALL)), (RUN, windows >= SMALL)):
        while width < run:
            least = np.minimum(least[: max(0, len(least) - width)], least[width:])
            width *= 2
        edges = np.zeros(len(rank) + 1, np.int32)
        np.add.at(edges, at[:-1][own], 1)
        np.add.at(edges, at[:-1][own] + windows[own] - run + 1, -1)
        if own.any():
            best = least[np.cumsum(edges, dtype=np.int32)[: len(least)] > 0] & ((1 << low) - 1)
            chosen |= np.bincount(best, minlength=len(rank) + 1) >= run // POPULAR
    for k in np.flatnonzero((windows < SHORT_RUN) & (size > 0)):
        # one run: its best window, or the whole of a text shorter than a window
        chosen[at[k] + (int(np.argmin(rank[at[k] : at[k] + windows[k]])) if windows[k] > 0 else 0)] = True
    found = np.flatnonzero(chosen)
    owner = np.searchsorted(at, found, "right") - 1
    # a short text is hashed with zeros after its end, never with its neighbour's bytes
    spans = np.lib.stride_tricks.sliding_window_view(data, SPAN)[found].copy() if len(found) else np.zeros((0, SPAN), np.uint8)
    spans[np.arange(SPAN) >= (at[owner + 1] - found)[:, None]] = 0
    h = np.minimum(at[owner + 1] - found, SPAN).astype(np.uint64)
    for word in spans.view(np.uint64).T:
        h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    order = np.lexsort((np.arange(len(h)), h, owner))
    once = np.ones(len(h), bool)
    once[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    return owner[once], h[once]


def chains(texts: list[bytes], place: np.ndarray) -> list[np.ndarray]:
    """The chain of Bloom filters of every text: rows of BITS / 8 bytes."""
    owner, h = _features(texts, place)
    count = np.bincount(owner, minlength=len(texts))
    filters = -(-count // FILL)
    first = np.concatenate([[0], np.cumsum(filters)])
    nth = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(count)])[owner]
    bits = np.zeros(int(first[-1]) * BITS, np.uint8)
    for k in range(HASHES):
        bits[(first[owner] + nth // FILL) * BITS + ((h >> np.uint64(12 * k)) % np.uint64(BITS)).astype(np.int64)] = 1
    packed = np.packbits(bits).reshape(-1, BITS // 8)
    return [packed[a:b] for a, b in zip(first[:-1], first[1:])]


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """How alike two chains are, 0 to 1; the same both ways."""
    if not len(one) or not len(other):
        return float(len(one) == len(other))
    sides = [np.ascontiguousarray(x).view(np.uint64) for x in (one, other)]
    a, b = sorted(sides, key=lambda x: (int(np.bitwise_count(x).sum()), x.tobytes()))
    na, nb = np.bitwise_count(a).sum(1).astype(np.int64), np.bitwise_count(b).sum(1).astype(np.int64)
    best = np.zeros(len(a))
    step = max(1, (1 << 18) // len(b))
    for s in range(0, len(a), step):
        common = np.bitwise_count(a[s : s + step, None, :] & b[None]).sum(2).astype(np.int64)
        most = np.minimum(na[s : s + step, None], nb)
        chance = na[s : s + step, None] * nb / BITS
        floor = chance + MARGIN * (most - chance)
        best[s : s + step] = np.clip((common - floor) / np.maximum(most - floor, 1e-9), 0, 1).max(1)
    return float((best * na).sum() / na.sum())


def edited(text: bytes, following: bytes) -> bytes:
    """``text`` with its last floor(n / 2) code points replaced by as many of the next one's first (or all)."""
    own = text.decode()
    half = len(own) // 2
    # a code point has at most four bytes
    return (own[: len(own) - half] + following[: 4 * half].decode(errors="ignore")[:half]).encode()


def coded(chain: np.ndarray) -> str:
    """A chain as text; ``decoded`` is its inverse."""
    return base64.b64encode(zlib.compress(chain.tobytes())).decode() if len(chain) else ""


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(base64.b64decode(fingerprint)) if fingerprint else b"", np.uint8).reshape(-1, BITS // 8)


def _judged(ids: list, texts: list[bytes], place: np.ndarray) -> Iterator[tuple]:
    """Result rows of all texts but the last, each with the text after it as its next one."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own = chains(texts + changed, place)
    for k, (doc_id, new) in enumerate(zip(ids, changed)):
        mine, next_one, other = own[k], own[k + 1], own[len(texts) + k]
        yield doc_id, len(texts[k].decode()), hashlib.sha256(new).hexdigest(), coded(mine), coded(other), likeness(mine, other), likeness(mine, next_one)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for doc_id, at, text in zip(*[batch.column(k) for k in range(3)]):
            yield doc_id.as_py(), at.as_py(), text.as_buffer().to_pybytes()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document: its fingerprint, that of its edited text, and how like they are."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))

    def counted(batches):
        total = np.zeros(LEVELS + 1, np.int64)
        block, size = [], 0

        def add():
            at = _offsets(block)
            level = levels(np.frombuffer(b"".join(block), np.uint8))
            edges = np.zeros(len(level) + 1, np.int64)
            inside = np.flatnonzero(np.diff(at) >= SPAN)
            np.add.at(edges, at[inside], 1)
            np.add.at(edges, at[inside + 1] - SPAN + 1, -1)
            return np.bincount(level[np.cumsum(edges)[:-1] > 0], minlength=LEVELS + 1)

        for batch in batches:
            for x in batch.column(0):
                block.append(x.as_buffer().to_pybytes())
                size += len(block[-1])
                if size >= BLOCK:
                    total += add()
                    block, size = [], 0
        if block:
            total += add()
        yield pa.RecordBatch.from_pydict({"level": pa.array(range(LEVELS + 1), pa.int32()), "n": pa.array(total, pa.int64())})

    seen = rows.select("text").mapInArrow(counted, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect()
    place = ranks({r["level"]: r["n"] for r in seen})

    def streamed(batches):
        ids, texts, size, first, at = [], [], 0, True, None
        none = (None,) * 6
        for doc_id, at, text in _rows(batches):
            if first:
                yield _batch([(doc_id, *none, 0, at, text)], WAITING)
                first = False
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= BLOCK and len(texts) > 1:
                yield _batch([(*r, None, None, None) for r in _judged(ids, texts, place)], WAITING)
                ids, texts, size = ids[-1:], texts[-1:], len(text)
        if texts:
            if len(texts) > 1:
                yield _batch([(*r, None, None, None) for r in _judged(ids, texts, place)], WAITING)
            yield _batch([(ids[-1], *none, 1, at, texts[-1])], WAITING)

    # equal (id, text) rows may part anywhere: they are the same
    order = [F.desc_nulls_last("doc_id"), F.asc("_tie"), F.asc("_at")]
    dealt = rows.withColumns({"_tie": F.xxhash64("text"), "_at": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    made = saved(dealt.select("doc_id", "_at", "text").mapInArrow(streamed, WAITING))
    inside = made.where("edge IS NULL").select(*[f.split(" ")[0] for f in RESULT.split(", ")])

    # two keys a partition: whose first row follows whose last one
    ends = made.where("edge IS NOT NULL").select("doc_id", F.xxhash64("text").alias("_tie"), F.col("at").alias("_at"), "edge")
    line = W.orderBy(*order, F.asc("edge"))
    turn = ends.withColumns({"_to": F.lead("_at").over(line), "_first": F.first("_at").over(line)})
    links = turn.where("edge = 1").select(F.col("_at").alias("_from"), F.coalesce("_to", "_first").alias("_to"))
    last = made.where("edge = 1").select("doc_id", F.col("at").alias("_from"), "text")
    head = made.where("edge = 0").select(F.col("at").alias("_to"), F.col("text").alias("following"))
    pairs = last.join(links, "_from").join(head, "_to").select("doc_id", "text", "following")

    def closed(batches):
        for batch in batches:
            for doc_id, a, b in zip(*[batch.column(k) for k in range(3)]):
                yield _batch(list(_judged([doc_id.as_py()], [a.as_buffer().to_pybytes(), b.as_buffer().to_pybytes()], place)), RESULT)

    return inside.union(pairs.mapInArrow(closed, RESULT))
