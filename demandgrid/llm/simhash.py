"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints are 64 majority bits over the XXH64 values of word shingles.  Two
fingerprints link when they differ in at most ``distance`` bits; classes are the
connected components.

1. Equal fingerprints collapse to one node with its smallest doc_id, so exact and
   trivial copies never meet each other.
2. One pass over all nodes gives the 64 x 64 co-occurrence counts of their bits,
   hence for every pair of bits how often two nodes agree on both.
3. Correlated bits are grouped into m partitions.  If the thresholds t_1..t_m sum
   to distance - m + 1, any pair within ``distance`` differs in at most t_i bits of
   some partition i (t_i = -1: that partition need not be looked at).  The expected
   candidates of a partition at a threshold come from a tree of its strongest
   pairwise agreements; dynamic programming picks the thresholds of least total
   cost (probes and candidates), and the cheapest m wins.
4. Nodes are dealt by (partition, value); where t_i > 0 also under the values at up
   to t_i flipped bits.  A bucket is verified in place (XOR, popcount) and returns a
   spanning forest of its links, never all its pairs.
5. A bucket above ``bucket_rows`` is dealt again by partitions of the bits it does
   not share (the same principle at the full distance), which splits it unless its
   members agree almost everywhere; what is still too large after ``MAX_DEPTH``
   rounds is compared in pairs of blocks, spread over tasks.  Nothing is dropped.
6. Components: alternating large-star / small-star rounds over stored tables.

Defined cases: a text of fewer words than a shingle is one shingle; null or no
words give fingerprint zero, linked like any other; a null doc_id counts as
absent from the minimum (the component of such documents alone is null); an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import LOWER_TEXT, WORDS, saved, without

BITS = 64
DISTANCE = 3
SHINGLE = 3
BUCKET_ROWS = 4096
MAX_DEPTH = 3
PROBE_COST = 40.0  # one dealt row against one comparison
C = F.col
ROW = "part long, value long, fp long, own boolean"


# ---- fingerprints

def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = WORDS.findall((text or "").translate(LOWER_TEXT))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < width else map(" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, 42) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, _text (hash of the text), fp (the 64 bits as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "_text", "fp"])

    rows = docs.select(C("doc_id").cast("bigint"), F.xxhash64(C("text").cast("string")).alias("_text"), C("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, _text bigint, fp bigint")


# ---- partitions and thresholds

def co_occurrence(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes, and for every two bits in how many nodes both are set: 64 rows from every task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy().view(np.uint64)[:, None].view(np.uint8), axis=1, bitorder="little").astype(np.float64)
            n, both = n + len(bits), both + bits.T @ bits
        if n:
            yield pd.DataFrame({"bit": range(BITS), "n": n, "both": list(both)})

    sums = nodes.select("fp").mapInPandas(run, "bit int, n long, both array<double>").select("bit", "n", F.posexplode("both").alias("other", "k"))
    rows = sums.groupBy("bit", "other").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()  # 4,096 rows
    out = np.zeros((BITS, BITS))
    for r in rows:
        out[r["bit"], r["other"]] = r["k"]
    return (rows[0]["n"] if rows else 0), out


class Agreement:
    """How often two nodes agree on a bit, and on two bits at once."""

    def __init__(self, n: int, both: np.ndarray) -> None:
        p = np.diag(both) / n
        b = both / n
        cells = (b, p[:, None] - b, p[None, :] - b, 1 - p[:, None] - p[None, :] + b)
        self.pair = np.clip(sum(np.clip(c, 0, 1) ** 2 for c in cells), 1e-12, 1)
        self.one = np.clip(p**2 + (1 - p) ** 2, 1e-12, 1)
        self.lift = np.log(self.pair / (self.one[:, None] * self.one[None, :]))
        np.fill_diagonal(self.lift, 0.0)

    def group(self, m: int) -> list[list[int]]:
        """m partitions of nearly equal width; each grows by the bit most correlated with it."""
        left, out = set(range(BITS)), []
        for k in range(m):
            width = len(left) // (m - k)
            part = [max(left, key=lambda b: (self.one[b], -b))]
            left.discard(part[0])
            while len(part) < width:
                best = max(left, key=lambda b: (self.lift[b, part].sum(), -b))
                part.append(best)
                left.discard(best)
            out.append(sorted(part))
        return out

    def all_agree(self, part: list[int]) -> float:
        """Chance that two nodes agree on the whole partition, by its maximum spanning tree of lifts."""
        joined, log = {part[0]}, float(np.log(self.one[part]).sum())
        while len(joined) < len(part):
            gain, bit = max((self.lift[a, b], b) for a in joined for b in part if b not in joined)
            joined.add(bit)
            log += gain
        return math.exp(min(0.0, log))

    def candidates(self, n: int, part: list[int], threshold: int) -> float:
        if threshold < 0:
            return 0.0
        odds = ((1 - self.one) / self.one)[part]
        within = 1.0 + (odds.sum() if threshold >= 1 else 0.0) + ((odds.sum() ** 2 - (odds**2).sum()) / 2 if threshold >= 2 else 0.0)
        return n * n / 2 * min(1.0, self.all_agree(part) * within)


def probes(width: int, threshold: int) -> int:
    return sum(math.comb(width, k) for k in range(threshold + 1))


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """One threshold per partition summing to ``total`` at least cost (dynamic programming over the sums)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, extra in cost.items():
                if s + t not in new or c + extra < new[s + t][0]:
                    new[s + t] = (c + extra, [*chosen, t])
        best = new
    return best[total]


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every partition that is probed."""
    if n < 2:
        return []
    agreement, found = Agreement(n, both), []
    for m in range(max(1, distance - 1), distance + 4):
        parts = agreement.group(m)
        costs = [{t: agreement.candidates(n, p, t) + (PROBE_COST * n * probes(len(p), t) if t >= 0 else 0.0) for t in (-1, 0, 1, 2)} for p in parts]
        cost, chosen = allocate(costs, distance - m + 1)
        found.append((cost, m, [(p, t) for p, t in zip(parts, chosen) if t >= 0]))
    return min(found)[2]


# ---- candidates and links

def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _deal(parts: list[tuple[list[int], int]]):
    """Rows of every node under its values (own) and the values near them (not own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k, (bits, threshold) in enumerate(parts):
                own = fp & np.uint64(_mask(bits))
                for flips in range(threshold + 1):
                    for flip in combinations(bits, flips):
                        value = own ^ np.uint64(_mask(flip))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k)), pa.array(value.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), flips == 0))], ["part", "value", "fp", "own"])

    return run


def forest(fp: np.ndarray, own: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket (between rows of which one at least is own)."""
    out, open_ = [], np.arange(len(fp))
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            at = queue.pop()
            near = np.bitwise_count(fp[open_] ^ fp[at]) <= distance
            if not own[at]:
                near &= own[open_]
            if near.any():
                hits = open_[near]
                open_ = open_[~near]
                out += [(at, h) for h in hits]
                queue += hits.tolist()
    return out


def _verify(distance: int):
    """Buckets arrive one after another (rows sorted by key); each yields its forest."""

    def links(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
        ends, out = np.r_[starts[1:], len(fp)], []
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b - a == 2:
                if np.bitwise_count(fp[a] ^ fp[a + 1]) <= distance and (own[a] or own[a + 1]):
                    out.append((a, a + 1))
            elif b - a > 2:
                out += [(a + i, a + j) for i, j in forest(fp[a:b], own[a:b], distance)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle(key, fp, own) -> pa.RecordBatch:
            found = np.array(links(key, fp, own), dtype=np.int64).reshape(-1, 2)
            signed = fp.view(np.int64)
            a, b = signed[found[:, 0]], signed[found[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            key = np.stack([c.to_numpy() for c in batch.columns[:-2]], 1)
            held.append((key, batch.column("fp").to_numpy().view(np.uint64), batch.column("own").to_numpy(zero_copy_only=False)))
            key, fp, own = (np.concatenate(x) for x in zip(*held))
            last = int(np.flatnonzero((key != key[-1]).any(1))[-1]) + 1 if (key != key[-1]).any() else 0
            held = [(key[last:], fp[last:], own[last:])]  # the last bucket may go on in the next batch
            if last:
                yield settle(key[:last], fp[:last], own[:last])
        if held:
            yield settle(*held[0])

    return run


def link_forest(nodes: DataFrame, parts: list[tuple[list[int], int]], distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) fingerprints, a < b: enough of the links to join all linked nodes."""
    found = []
    dealt = nodes.select("fp").mapInArrow(_deal(parts), ROW) if parts else nodes.sparkSession.createDataFrame([], ROW)
    masks = {k: _mask(bits) for k, (bits, _) in enumerate(parts)}
    keys = ["part", "value"]
    for depth in range(MAX_DEPTH):
        dealt = saved(dealt)
        hot = saved(dealt.groupBy(*keys).agg(F.count("*").alias("_n")).where(C("_n") > bucket_rows))
        if hot.isEmpty():
            found.append(_forests(dealt, keys, distance))
            break
        marked = dealt.join(hot, keys, "left")
        found.append(_forests(marked.where(C("_n").isNull()).drop("_n"), keys, distance))
        large = marked.where(C("_n").isNotNull())
        if depth == MAX_DEPTH - 1:
            found.append(_blocks(large, keys, distance, bucket_rows))
        else:
            dealt = large.drop("_n").mapInArrow(_deal_again(masks, distance, depth), _again_schema(keys, depth))
            keys = [*keys, f"part{depth}", f"value{depth}"]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.where(C("a") != C("b")).distinct()


def _forests(rows: DataFrame, keys: list[str], distance: int) -> DataFrame:
    return rows.select(*keys, "fp", "own").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(distance), "a long, b long")


def _again_schema(keys: list[str], depth: int) -> str:
    return ", ".join(f"{k} long" for k in keys) + f", part{depth} long, value{depth} long, fp long, own boolean"


def _free_parts(masks: dict[int, int], part: int, distance: int, depth: int) -> list[int]:
    """Masks of distance + 1 groups of the bits outside the partition, others at every depth."""
    free = [b for b in range(BITS) if not masks[part] >> b & 1]
    shift = depth * 7 % len(free)
    free = free[shift:] + free[:shift]
    return [_mask(free[j :: distance + 1] if depth == 0 else free[j * len(free) // (distance + 1) : (j + 1) * len(free) // (distance + 1)]) for j in range(distance + 1)]


def _deal_again(masks: dict[int, int], distance: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for p in np.unique(part):
                rows = pa.array(np.flatnonzero(part == p))
                own = fp[part == p]
                old = batch.take(rows)
                for j, mask in enumerate(_free_parts(masks, int(p), distance, depth)):
                    value = (own & np.uint64(mask)).view(np.int64)
                    cols = [*(old.column(c) for c in old.schema.names[:-2]), pa.array(np.full(len(own), j)), pa.array(value), old.column("fp"), old.column("own")]
                    yield pa.RecordBatch.from_arrays(cols, [*old.schema.names[:-2], f"part{depth}", f"value{depth}", "fp", "own"])

    return run


def _blocks(large: DataFrame, keys: list[str], distance: int, bucket_rows: int) -> DataFrame:
    """Oversized buckets in pairs of blocks: every two rows meet in one task or more."""
    n = F.ceil(C("_n") / bucket_rows).cast("long")
    mine = large.withColumn("_blocks", n).withColumn("_mine", F.pmod(F.xxhash64("fp", F.lit(1)), C("_blocks")))
    pairs = mine.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), C("_blocks") - 1)))
    dealt = pairs.select(*keys, F.least("_mine", "_other").alias("_lo"), F.greatest("_mine", "_other").alias("_hi"), "fp", "own")
    return _forests(dealt, [*keys, "_lo", "_hi"], distance)


# ---- components

def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of every node's component, from (a, b) links, a < b.

    Large star: a node's larger neighbours move to its smallest neighbour; small
    star: its smaller neighbours do.  Stops when a round changes nothing."""
    edges, before = saved(links.select("a", "b")), None
    while True:
        both = edges.select(C("a").alias("u"), C("b").alias("v")).union(edges.select(C("b").alias("u"), C("a").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), C("u")).alias("m")))
        large = both.where(C("v") > C("u")).join(least, "u").select(C("m").alias("a"), C("v").alias("b")).where(C("a") != C("b")).distinct()
        large = saved(large)
        least = saved(large.groupBy(C("b").alias("u")).agg(F.min("a").alias("m")))
        small = large.select(C("b").alias("u"), C("a").alias("v")).join(least, "u")
        moved = small.select(C("m").alias("a"), C("v").alias("b")).where(C("a") != C("b")).union(least.select(C("m").alias("a"), C("u").alias("b"))).distinct()
        edges = saved(moved)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(C("b").alias("node"), C("a").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    return _classes(docs, distance, width, bucket_rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(docs: DataFrame, distance: int, width: int, bucket_rows: int) -> DataFrame:
    prints = saved(fingerprints(docs, width))
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = plan(*co_occurrence(nodes), distance)
    roots = saved(components(link_forest(nodes, parts, distance, bucket_rows)))
    rooted = nodes.join(roots, C("fp") == C("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = saved(rooted)
    least = saved(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = saved(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """The document with the smallest id of every component, with all its columns."""
    return without(docs, saved(_classes(docs, distance, width, BUCKET_ROWS).where(~C("doc_id").eqNullSafe(C("component_id"))).select("doc_id", "_text")))
