"""Near copies by an exact set-similarity join of whole documents.

A document is the set of its ``width``-word shingles (words as in SimHash: ASCII letters
lowered), known by 64-bit hashes.  Two documents link when the Jaccard similarity of
their sets is ``percent`` / 100 or more; classes are the connected components.

1. Shingles are counted over all documents, hashed into ``BUCKETS`` counters.  They
   order shingles by rarity; any total order is exact, the rare-first one keeps
   passages that many documents share from making candidates.
2. Documents with equal sets collapse to one node.  SimHash comes first: a node is
   verified against the first of its SimHash component, and pairs that this has joined
   are no candidates below.  Whatever it misses is found by the exact join.
3. Prefix filter: two sets that similar share one of their first n - ceil(t n) + 1
   shingles in that order, so a node is dealt under those only.  In a shingle's group a
   node meets ``NAMED`` neighbours that pass the length and positional filters.
4. A bitmap of two bits a shingle bounds what two sets can share; pairs that cannot be
   similar go.  The others are verified on their whole sets, each document's best
   candidate first, then those that still join two components.  Groups with further pairs go
   on: only pairs between different components can matter, so a few rounds with other
   neighbours join dense groups of copies first, and the last round meets all pairs that
   are left.  A pair is compared under the first shingle that it shares there; rows that
   have no pair left in a group leave it before any bitmap moves.  Nothing is dropped; a
   large group of documents that share rare shingles but are not similar is the costly case.
5. Components: alternating large-star / small-star rounds over stored tables.

Defined cases as in SimHash: a text of fewer words than a shingle is one shingle; texts
that are null or have no words have one (empty) set; a null doc_id counts as absent
from the minimum; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm import simhash
from demandgrid.llm.common import LOWER_TEXT, WORDS, _bitmap, lean, pruned, saved, small_batches, without
from demandgrid.llm.line_dedup import _mix, _similar_enough, word_hashes
from demandgrid.llm.simhash import components

PERCENT = 80
WIDTH = 5
BUCKETS = 1 << 18
NAMED = 4
ROUNDS = 3
BEFORE = 64
EARLIER = 512
MATRIX = 1 << 18
COMPARED = 1 << 22
AT_ONCE = 256
AT_ONCE_BYTES = 1 << 18
CACHED_WORDS = 150_000
C = F.col
SETS = "doc_id bigint, _text bigint, s1 bigint, s2 bigint, keys array<bigint>, bits binary"


class Shingles:
    """Hashes of the shingles of texts, through a bounded cache of word hashes."""

    def __init__(self, width: int) -> None:
        self.known: dict[str, int] = {}
        self.factors = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(width)]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All shingles of all texts, and the text of each."""
        found = [WORDS.findall((t or "").translate(LOWER_TEXT)) for t in texts]
        words = [w for f in found for w in f]
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        new = list({w for w in words if w not in self.known})
        self.known.update(zip(new, word_hashes(new).tolist()))
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        sizes, width = np.array([len(f) for f in found], np.int64), len(self.factors)
        starts = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(texts)), sizes)
        left = np.repeat(sizes, sizes) - (np.arange(len(h)) - np.repeat(starts, sizes))  # words from here to the text's end
        first = left == np.repeat(sizes, sizes)
        sums = np.zeros(len(h), np.uint64)
        for k, f in enumerate(self.factors):
            has = np.flatnonzero(left > k)
            sums[has] += h[has + k] * f
        whole = (left >= width) | first
        return _mix(sums[whole], 0xBF58476D1CE4E5B9), text[whole]


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices of up to AT_ONCE rows and AT_ONCE_BYTES of text (or one longer text): they bound the arrays of a part."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE_BYTES, "right"))
            end = min(max(most, at + 1), at + AT_ONCE)
            yield batch.slice(at, end - at)
            at = end


def _bits(keys: np.ndarray) -> bytes:
    """A bitmap of about two bits a key; halves of a larger one or'ed give the next smaller."""
    size = max(64, 1 << (2 * len(keys) - 1).bit_length()) if len(keys) else 64
    out = np.zeros(size, np.uint8)
    out[(_mix(keys, 0x94D049BB133111EB) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def frequencies(rows: DataFrame, width: int) -> np.ndarray:
    """Shingles of all texts per hash bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingles(width), np.zeros(BUCKETS, np.int64)
        for part in _parts(batches, 0):
            h, _ = shingles(part.column(0).to_pylist())
            counts += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    sums = rows.select("text").mapInArrow(lean(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    with small_batches(rows.sparkSession):
        found = sums.toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _sets(counts: np.ndarray, width: int):
    """Per document: 128 bits of its set, and the set itself, rare shingles first."""
    level = np.minimum(255, 4 * np.log2(counts + 1.0)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for part in _parts(batches, 2):
            h, text = shingles(part.column(2).to_pylist())
            # the counter's low bits give way to the level, which they decide together with the rest of the hash
            keys = (level[(h & np.uint64(BUCKETS - 1)).astype(np.int64)] << np.uint64(55)) | (h >> np.uint64(9))
            order = np.lexsort((keys, text))
            keys, text = keys[order], text[order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])] if len(keys) else np.empty(0, bool)
            keys, text = keys[new], text[new]
            n = np.bincount(text, minlength=part.num_rows)
            starts, some = np.cumsum(n) - n, n > 0
            sums = []
            for by in (0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93):
                s = np.zeros(part.num_rows, np.uint64)
                if len(keys):
                    s[some] = np.add.reduceat(_mix(keys, by), starts[some])
                sums.append(pa.array(s.view(np.int64)))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(keys.view(np.int64)))
            bits = pa.array([_bits(keys[s : s + k]) for s, k in zip(starts.tolist(), n.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *sums, lists, bits], ["doc_id", "_text", "s1", "s2", "keys", "bits"])

    return run


def _by_group(settle):
    """``settle`` on whole groups of rows sorted by their first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = batch.column(0).to_numpy()
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if len(key) and (key != key[-1]).any() else 0
            held = batch.slice(last)  # the last group may go on
            yield from settle(batch.slice(0, last))
        if held is not None:
            yield from settle(held)

    return run


def _meet(percent: int, named: int):
    """Candidate pairs (sid, other) of every shingle's group: rows up to ``named`` places
    apart in different components; a null ``other`` gives the rows of groups that hold more."""

    def settle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, sid, root, n, j = (c.to_numpy() for c in batch.columns)
        for d in range(1, named + 1):
            at = np.flatnonzero(key[d:] == key[:-d])
            if not len(at):
                return
            at = at[root[at] != root[at + d]]
            at = at[_similar_enough(n[at], j[at], n[at + d], j[at + d], percent)]
            if len(at):
                a, b = sid[at], sid[at + d]
                yield rows(np.maximum(a, b), pa.array(np.minimum(a, b)), key[at], n[at], j[at])
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        at = np.flatnonzero(np.repeat(sizes > named + 1, sizes))
        if len(at):
            yield rows(sid[at], pa.nulls(len(at), pa.int64()), key[at], n[at], j[at])

    def rows(sid, other, *more) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sid), other, *map(pa.array, more)], ["sid", "other", "key", "n", "j"])

    return _by_group(settle)


def _bound(bits: list[bytes], n: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The most shingles that the sets of rows ``one`` and ``two`` can share, by their bitmaps: a bit
    that only one side has stands for a shingle that only this side has."""
    sizes = np.array([len(x) for x in bits])
    common, most = np.minimum(sizes[one], sizes[two]), np.empty(len(one), np.int64)
    for size in np.unique(common).tolist():
        at = np.flatnonzero(common == size)
        step = max(1, COMPARED // size)
        for part in (at[s : s + step] for s in range(0, len(at), step)):
            used, place = np.unique(np.r_[one[part], two[part]], return_inverse=True)
            folded = np.stack([np.bitwise_or.reduce(np.frombuffer(bits[k], np.uint64).reshape(-1, size // 8), axis=0) for k in used.tolist()])
            x, y = folded[place[: len(part)]], folded[place[len(part) :]]
            only_x, only_y = (np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in (x & ~y, y & ~x))
            most[part] = np.minimum(n[one[part]] - only_x, n[two[part]] - only_y)
    return most


def _met_before(before: pa.Array) -> np.ndarray:
    """Bitmaps of the earlier shingles (``EARLIER`` of those that most rows have) of the rows of a group."""
    of = np.repeat(np.arange(len(before)), pc.list_value_length(before).to_numpy())
    values, place, times = np.unique(before.flatten().to_numpy(), return_inverse=True, return_counts=True)
    rank = np.full(len(values), EARLIER)
    often = np.argsort(-times, kind="stable")[:EARLIER]
    rank[often] = np.arange(len(often))
    bit, out = rank[place], np.zeros((len(before), EARLIER // 64), np.uint64)
    known = bit < EARLIER
    np.bitwise_or.at(out, (of[known], bit[known] // 64), np.uint64(1) << (bit[known] % 64).astype(np.uint64))
    return out


def _within(batch: pa.RecordBatch, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (one, two), parts of ``MATRIX`` pairs or a row, of every group's pairs in different components that
    neither sizes nor places rule out and that share no shingle of their ``before``: with that one they have met."""
    key, _, root, n, j = (c.to_numpy() for c in batch.columns[:5])
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    for lo, hi in zip(starts.tolist(), ends.tolist()):
        earlier = _met_before(batch.column(5).slice(lo, hi - lo))
        step = max(1, MATRIX // (hi - lo))
        for at in range(lo, hi - 1, step):
            a, b = np.arange(at, min(at + step, hi - 1))[:, None], np.arange(at + 1, hi)[None, :]
            one, two = np.nonzero((a < b) & (root[a] != root[b]))
            one, two = one + at, two + at + 1
            keep = _similar_enough(n[one], j[one], n[two], j[two], percent)
            one, two = one[keep], two[keep]
            new = np.ones(len(one), bool)
            for word in earlier.T:
                new &= (word[one - lo] & word[two - lo]) == 0
            yield one[new], two[new]


def _partnered(percent: int):
    """The rows of every shingle's group that have a pair there (see ``_within``)."""

    def settle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        has = np.zeros(batch.num_rows, bool)
        for one, two in _within(batch, percent):
            has[one] = has[two] = True
        yield batch.filter(pa.array(has)).select(["key", "sid", "n", "j", "before"])

    return _by_group(settle)


def _meet_alike(percent: int, named: int | None):
    """Pairs (sid, other) of every shingle's group (see ``_within``) that their bitmaps do not rule
    out either: of every row the first ``named`` (all if None).  Rows of a group are compared
    here, so pairs that cannot be similar are never rows, and others are rows once."""

    def settle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        sid, n, bits = batch.column(1).to_numpy(), batch.column(3).to_numpy(), batch.column(6).to_pylist()
        for one, two in _within(batch, percent):
            if not len(one):
                continue
            most = _bound(bits, n, one, two)
            keep = 100 * most >= percent * (n[one] + n[two] - most)
            one, two = one[keep], two[keep]
            if named is not None and len(one):
                new = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
                place = np.arange(len(one)) - np.repeat(new, np.diff(np.r_[new, len(one)]))
                one, two = one[place < named], two[place < named]
            if len(one):
                p, q = sid[one], sid[two]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], ["sid", "other"])

    return _by_group(settle)


def _open_rows(rooted: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """The rows (key, sid, n, j, before) of live groups that can have a partner in them.

    ``before`` names the ``BEFORE`` shingles next before this one under which the document
    stands in a live group too: a pair that shares one of them meets there, where its places
    are no worse, so it is looked at once and not under every shingle of a shared passage."""
    rows = pruned(rooted, live, "key").join(live, "key", "left_semi")
    per = rows.groupBy("sid", "root", "n").agg(F.sort_array(F.collect_list(F.struct("key", "j"))).alias("all"))
    per = per.select("sid", "root", "n", C("all.key").alias("keys"), F.posexplode("all").alias("at", "row"))
    before = F.slice("keys", F.greatest(C("at") - BEFORE, F.lit(0)) + 1, F.least("at", F.lit(BEFORE)))
    dealt = per.select("row.key", "sid", "root", "n", "row.j", before.alias("before")).repartition("key").sortWithinPartitions("key", "sid")
    return saved(dealt.mapInArrow(lean(_partnered(percent)), "key bigint, sid bigint, n bigint, j bigint, before array<bigint>"))


MET = "sid bigint, other bigint, key bigint, n bigint, j bigint"


def _bounded(prints: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (sid, other, ...) whose bitmaps do not rule them out.

    A bit that only one side has stands for a shingle that only this side has."""
    one = prints.select("sid", F.size("keys").cast("bigint").alias("n1"), C("bits").alias("bits1"))
    two = one.select(C("sid").alias("other"), C("n1").alias("n2"), C("bits1").alias("bits2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = (batch.column(c).to_numpy() for c in ("n1", "n2"))
            most = np.empty(len(n1), np.int64)
            for k, (x, y) in enumerate(zip(batch.column("bits1"), batch.column("bits2"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                while len(x) > len(y):
                    x = x[: len(x) // 2] | x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] | y[len(y) // 2 :]
                most[k] = min(n1[k] - int(np.bitwise_count(x & ~y).sum()), n2[k] - int(np.bitwise_count(y & ~x).sum()))
            keep = pa.array(100 * most >= percent * (n1 + n2 - most))
            yield batch.filter(keep).select(pairs_columns)

    pairs_columns = pairs.columns
    return pairs.join(one, "sid").join(two, "other").select(*pairs_columns, "n1", "n2", "bits1", "bits2").mapInArrow(lean(run), pairs.schema)


def _verified(prints: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar, as links a < b."""
    pairs = pairs.select("sid", "other")
    wanted = saved(pairs.select("sid").union(pairs.select("other")).distinct())
    one = saved(pruned(prints.select("sid", "keys"), wanted, "sid").join(wanted, "sid"))
    two = one.select(C("sid").alias("other"), C("keys").alias("keys2"))
    shared = F.size(F.array_intersect("keys", "keys2"))
    similar = 100 * shared >= percent * (F.size("keys") + F.size("keys2") - shared)
    return saved(pairs.join(one, "sid").join(two, "other").where(similar).select(C("other").alias("a"), C("sid").alias("b")))


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sides are not yet in one component."""
    a, b = (roots.select(C("node").alias(side), C("root").alias(f"_{side}")) for side in ("sid", "other"))
    placed = pairs.join(a, "sid", "left").join(b, "other", "left")
    return placed.where(F.coalesce("_sid", "sid") != F.coalesce("_other", "other")).select("sid", "other")


def _fingerprinted(docs: DataFrame, prints: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links a < b of nodes in one SimHash component, where their whole sets are similar.

    Every node is compared with the first node of its component, so a large group of near
    copies costs one pair a member; what that leaves apart is left to the prefix filter."""
    texts = saved(simhash.fingerprints(docs).dropDuplicates(["doc_id", "_text"]))
    at = saved(nodes.select("sid", C("doc_id").alias("_id"), C("_text").alias("_hash")))
    of = saved(at.join(texts, C("_id").eqNullSafe(C("doc_id")) & (C("_hash") == C("_text"))).select("sid", "fp"))
    firsts = saved(of.groupBy("fp").agg(F.min("sid").alias("first")))
    roots = saved(simhash.components(simhash.link_forest(firsts, simhash.plan(*simhash.co_occurrence(firsts)))))
    placed = saved(firsts.join(roots, C("fp") == C("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = saved(placed.groupBy("root").agg(F.min("first").alias("other")))
    pairs = of.join(placed.join(least, "root").select("fp", "other"), "fp").where(C("sid") != C("other")).select("sid", "other")
    return _verified(prints, saved(pairs), percent)


def _links(docs: DataFrame, prints: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, root) of all linked nodes."""
    links = _fingerprinted(docs, prints, nodes, percent)
    roots = saved(components(links))
    n = F.size("keys")
    prefix = n - F.expr(f"(size(keys) * {percent} + 99) div 100").cast("int") + 1
    dealt = nodes.where(n > 0).select("sid", n.cast("bigint").alias("n"), F.posexplode(F.slice("keys", F.lit(1), prefix)).alias("j", "key"))
    dealt = dealt.join(roots, C("sid") == C("node"), "left").select("key", "sid", F.coalesce("root", "sid").alias("root"), "n", C("j").cast("bigint").alias("j"))
    rows = dealt.repartition("key").sortWithinPartitions("key", "sid")
    met = saved(rows.mapInArrow(lean(_meet(percent, NAMED)), MET))
    tried = saved(met.where(C("other").isNotNull()).groupBy("sid", "other").agg(F.count("*").alias("c")))
    likely = saved(_bounded(prints, tried, percent))
    tried = tried.select("sid", "other")
    best = saved(likely.groupBy("sid").agg(F.max_by("other", F.struct("c", -C("other"))).alias("other")))
    links = saved(links.union(_verified(prints, best, percent)))
    roots = saved(components(links))
    more = _between(likely.select("sid", "other"), roots).join(best, ["sid", "other"], "left_anti")
    found = _verified(prints, saved(more), percent)
    if not found.isEmpty():
        links = saved(links.union(found))
        roots = saved(components(links))
    open_, bits = met.where(C("other").isNull()).select("key", "sid", "n", "j"), None
    for k in range(ROUNDS):
        named = None if k == ROUNDS - 1 else NAMED
        rooted = saved(open_.join(roots, C("sid") == C("node"), "left").select(*open_.columns, F.coalesce("root", "sid").alias("root")))
        live = saved(rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"))
        if live.isEmpty():
            break
        if bits is None:
            open_ = _open_rows(rooted, live, percent)
            wanted = saved(open_.select("sid").distinct())
            bits = saved(pruned(prints.select("sid", "bits"), wanted, "sid").join(wanted, "sid", "left_semi"))
            rows = open_.join(roots, C("sid") == C("node"), "left").withColumn("root", F.coalesce("root", "sid"))
        else:
            rows = pruned(rooted, live, "key").join(live, "key", "left_semi")
            open_ = saved(rows.select("key", "sid", "n", "j", "before"))
        rows = rows.join(bits, "sid").select("key", "sid", "root", "n", "j", "before", "bits").repartition("key").sortWithinPartitions("key", F.xxhash64("sid", F.lit(k)))
        new = saved(rows.mapInArrow(lean(_meet_alike(percent, named)), "sid bigint, other bigint").distinct().join(tried, ["sid", "other"], "left_anti"))
        tried = saved(tried.union(new))
        found = _verified(prints, saved(_bounded(prints, new, percent)), percent)
        if not found.isEmpty():
            links = saved(links.union(found))
            roots = saved(components(links))
    return roots


def classes(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, _text (hash of the text), component_id (the smallest id of its class)."""
    rows = docs.select(C("doc_id").cast("bigint"), F.xxhash64(C("text").cast("string")).alias("_text"), C("text").cast("string"))
    # sid is a fact once written: a number per document
    prints = saved(rows.mapInArrow(lean(_sets(frequencies(rows, width), width)), SETS).withColumn("sid", F.monotonically_increasing_id()))
    sets = saved(prints.groupBy("s1", "s2").agg(F.min("sid").alias("first_sid"), F.min("doc_id").alias("first"), F.count("*").alias("n_docs")))
    copies = saved(prints.select("sid", "s1", "s2").join(sets.where("n_docs > 1"), ["s1", "s2"]).where(C("sid") != C("first_sid")).select("sid"))
    marked = _bitmap(prints.select("sid", "doc_id", "_text", "keys"), copies, 1 << 24, "sid")
    nodes = marked.where(~C("_hit")).select("_row.*").union(marked.where("_hit").select("_row.*").join(copies, "sid", "left_anti"))
    roots = _links(docs, prints, nodes, percent)
    rooted = saved(sets.join(roots, C("first_sid") == C("node"), "left").select("s1", "s2", "first", F.coalesce("root", "first_sid").alias("root")))
    least = saved(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = saved(rooted.join(least, "root").select("s1", "s2", "component_id"))
    return prints.select("doc_id", "_text", "s1", "s2").join(named, ["s1", "s2"]).select("doc_id", "_text", "component_id")


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The document with the smallest id of every class, with all its columns."""
    return without(docs, saved(classes(docs, percent, width).where(~C("doc_id").eqNullSafe(C("component_id"))).select("doc_id", "_text")))
