"""Prefix trie of conversations: node tables over minimal perfect hashes.

A node is a distinct sequence of first turns (role, text).  Its digest is the exclusive
or, over its turns, of 128 bits hashed from the turn's place and SHA-256, so the digests
of a conversation of any length are a running sum that can be split over tasks.

1. ``paths``: a row per (conversation, depth) with the digests of the node and of its
   parent.  Conversations are cut in blocks of ``BLOCK`` depths.
2. Tasks read the rows in (conversation, block) order and close a shard after ``SHARD``
   rows.  A shard enumerates its distinct digests, assigns every one a slot by a minimal
   perfect hash, checks each lookup against the digest stored in the slot, scatters the
   rows' counts into flat arrays and adds them up through the array of parent slots,
   deepest first.  A node gets a partial sum from every shard that meets it.
3. Sums of the partial rows by digest are the node table.  Members, children and ends
   come from a first round; what a node adds to those above it is then charged to its
   smallest member, which alone owns it, and a second round of shards adds it up.

Links across a block's end are not followed in a shard: the block's deepest row carries
what lies below it (one member in round one, the later blocks' sums in round two), so a
conversation of any length is bounded rows in any task.  A node's content (parent and
last turn) must be the same in all its rows, otherwise the job fails: digests collided.

Defined cases: rows without conv_id belong to no conversation; null role or text is
empty; equal turn numbers are ordered by role, then the text's SHA-256 (rows equal in
all are interchangeable and stay); no rows give no nodes; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demandgrid.llm.common import saved
from demandgrid.operators.ranks import running_total

BLOCK = 4096
SHARD = 1 << 18
#: Ids in a piece of a node's list of ends.
PIECE = 1 << 12
NODE = ["p1", "p2"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
C = F.col


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 1), turn_sha (role and text), size (bytes of the text)."""
    role, text = (F.coalesce(C(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        C("conv_id").cast("bigint").alias("conv_id"), C("turn").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("bigint").alias("size"))
    ranked = running_total(rows, [F.asc_nulls_first("turn"), F.asc("role"), F.asc("sha")], F.lit(1).cast("bigint"), "i", ["conv_id"])
    return ranked.select("conv_id", "i", F.unhex(F.sha2(F.concat("role", F.lit("\n"), "sha"), 256)).alias("turn_sha"), "size")


def rebuilt(own: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """conv_id, depth (from 1), turn_sha, size of the rebuilt conversations: the first h turns
    of conversation c - c % group, then c's own after its first h; h = crc32(c) % most.
    A conversation without turns keeps one row, of depth 0 and without content."""
    h = F.crc32(C("conv_id").cast("string").cast("binary")) % most
    heads = (
        own.where((C("conv_id") % group == 0) & (C("i") < most)).groupBy(C("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("i", "turn_sha", "size"))).alias("head"))
    )
    convs = own.groupBy("conv_id").agg(F.max("i").alias("n")).withColumns({"base": C("conv_id") - C("conv_id") % group, "h": h})
    headed = convs.join(heads, "base", "left").select("conv_id", "n", "h", F.coalesce(F.slice("head", F.lit(1), C("h").cast("int")), F.array()).alias("head"))
    headed = headed.withColumn("before", F.size("head").cast("bigint"))
    first = headed.select("conv_id", F.explode("head").alias("x")).select("conv_id", C("x.i").alias("depth"), "x.turn_sha", "x.size")
    rest = own.join(headed.where("n > h").select("conv_id", "h", "before"), "conv_id").where("i > h").select("conv_id", (C("before") + C("i") - C("h")).alias("depth"), "turn_sha", "size")
    none = headed.where("before = 0 AND n <= h").select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("turn_sha"), F.lit(0).cast("bigint").alias("size"))
    return first.union(rest).union(none)


def paths(turns: DataFrame, depths: int = BLOCK) -> DataFrame:
    """Every row of ``rebuilt`` with its block, its turn's bits and what the blocks before give."""
    bits = lambda seed: F.xxhash64(F.lit(seed), "depth", "turn_sha")
    block = F.greatest(F.lit(0), F.floor((C("depth") - 1) / depths)).cast("bigint")
    own = turns.withColumns({"block": block, "b1": F.when(C("depth") > 0, bits(1)).otherwise(0), "b2": F.when(C("depth") > 0, bits(2)).otherwise(0)})
    long = own.where("block > 0").select("conv_id").distinct()
    sums = own.join(long, "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.bit_xor("b1").alias("s1"), F.bit_xor("b2").alias("s2"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select("conv_id", "block", F.bit_xor("s1").over(before).alias("c1"), F.bit_xor("s2").over(before).alias("c2"))
    return own.join(carried, ["conv_id", "block"], "left").select(
        "conv_id", "block", "depth", "b1", "b2", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("c1", "c2")], "size", "turn_sha")


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32)) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit digests: level by level, keys that are alone
    at their bit of the level keep it, the others go on; a slot is the number of set bits
    before the key's own.  The digests stand in their slots, so a lookup is verified."""

    def __init__(self, p1: np.ndarray, p2: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left = np.arange(len(p1))
        slot = np.empty(len(p1), np.int64)
        taken = 0
        while len(left):
            size = 2 * len(left) + 1
            at = self._at(p1[left], p2[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + taken
            self.levels.append((alone, rank))
            kept = alone[at]
            slot[left[kept]] = rank[at[kept]]
            taken += int(alone.sum())
            left = left[~kept]
            if len(self.levels) > 200:
                raise ValueError("equal digests in a table of distinct ones")
        self.p1, self.p2 = np.empty_like(p1), np.empty_like(p2)
        self.p1[slot], self.p2[slot] = p1, p2

    @staticmethod
    def _at(p1: np.ndarray, p2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mixed(p1 ^ _mixed(p2, 2 * level + 1), 2 * level + 2) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.p1)

    def slots(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """The slot of every digest, -1 where the table does not hold it."""
        out = np.full(len(p1), -1, np.int64)
        left = np.arange(len(p1))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._at(p1[left], p2[left], level, len(alone))
            hit = alone[at]
            s = rank[at[hit]]
            k = left[hit]
            out[k] = np.where((self.p1[s] == p1[k]) & (self.p2[s] == p2[k]), s, -1)
            left = left[~hit]
        return out


class Shard:
    """The nodes of some rows of ``paths``: slots, parents' slots and depths."""

    def __init__(self, conv: np.ndarray, block: np.ndarray, depth: np.ndarray, bits: tuple[np.ndarray, np.ndarray], carried: tuple[np.ndarray, np.ndarray], depths: int) -> None:
        # rows are sorted by (conversation, block, depth); a segment is one block of one conversation
        first = np.ones(len(conv), bool)
        first[1:] = (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(first)
        self.deepest = np.append(first[1:], True)
        segment = np.cumsum(first) - 1
        node, parent = [], []
        for b, c in zip(bits, carried):
            run = np.bitwise_xor.accumulate(b)
            run ^= np.where(start > 0, run[start - 1], np.uint64(0))[segment] ^ c
            node.append(run)
            parent.append(run ^ b)
        self.node, self.parent = node, parent
        # the root stands above every row of depth 1
        top = np.zeros(1, np.uint64)
        p1, p2, d = np.append(node[0], top), np.append(node[1], top), np.append(depth, 0)
        order = np.lexsort((p2, p1))
        once = np.ones(len(order), bool)
        once[1:] = (p1[order[1:]] != p1[order[:-1]]) | (p2[order[1:]] != p2[order[:-1]])
        one = order[once]
        self.table = PerfectHash(p1[one], p2[one])
        self.slot = self._found(node[0], node[1])
        self.root = int(self._found(top, top)[0])
        size = len(self.table)
        self.depth = np.zeros(size, np.int64)
        self.depth[self.slot] = depth
        self.row = np.full(size, -1, np.int64)
        self.row[self.slot] = np.arange(len(conv))
        self.up = np.full(size, -1, np.int64)
        inner = (depth - 1) % depths != 0
        self.up[self.slot[inner]] = self._found(parent[0][inner], parent[1][inner])
        self.up[self.slot[depth == 1]] = self.root
        self.up[self.root] = -1
        by = np.argsort(-self.depth, kind="stable")
        self.by_depth = np.split(by, np.flatnonzero(np.diff(self.depth[by])) + 1)

    def _found(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        slot = self.table.slots(p1, p2)
        if (slot < 0).any():
            raise ValueError("a digest of the shard is not in its table")
        return slot

    def added(self, value: np.ndarray) -> np.ndarray:
        """Rows' values scattered into slots and added up through the parents' slots."""
        total = np.zeros(len(self.table), np.int64)
        np.add.at(total, self.slot, value)
        for nodes in self.by_depth:
            nodes = nodes[self.up[nodes] >= 0]
            np.add.at(total, self.up[nodes], total[nodes])
        return total

    def least(self, value: np.ndarray) -> np.ndarray:
        """The least of the rows' values at or below every slot."""
        total = np.full(len(self.table), np.iinfo(np.int64).max)
        np.minimum.at(total, self.slot, value)
        for nodes in self.by_depth:
            nodes = nodes[self.up[nodes] >= 0]
            np.minimum.at(total, self.up[nodes], total[nodes])
        return total


def _shards(batches: Iterator[pa.RecordBatch], depths: int, most: int) -> Iterator[tuple[Shard, pa.Table, np.ndarray]]:
    """Shards of the rows, cut between blocks, with their rows and conversations."""

    def built(rows: pa.Table):
        a = {c: rows.column(c).to_numpy() for c in ("conv_id", "block", "depth", "b1", "b2", "c1", "c2")}
        lanes = {c: a[c].view(np.uint64) for c in ("b1", "b2", "c1", "c2")}
        return Shard(a["conv_id"], a["block"], a["depth"], (lanes["b1"], lanes["b2"]), (lanes["c1"], lanes["c2"]), depths), rows, a["conv_id"]

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            rows = pa.Table.from_batches(held).combine_chunks()
            conv, block = rows.column("conv_id").to_numpy(), rows.column("block").to_numpy()
            cut = np.flatnonzero((conv[1:] != conv[:-1]) | (block[1:] != block[:-1])) + 1
            if len(cut):
                yield built(rows.slice(0, int(cut[-1])).combine_chunks())
                rows = rows.slice(int(cut[-1])).combine_chunks()
            held, n = rows.to_batches(), rows.num_rows
    if n:
        yield built(pa.Table.from_batches(held).combine_chunks())


MEMBERS = "p1 bigint, p2 bigint, q1 bigint, q2 bigint, depth bigint, size bigint, turn_sha binary, conv_id bigint, n_convs bigint"


def _members(depths: int, most: int):
    """Round one: per shard and node its parent, content, smallest member and members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows, conv in _shards(batches, depths, most):
            # a conversation is one member of every node on its path: it enters at its end, or at its block's deepest row
            members, least = shard.added(shard.deepest.astype(np.int64)), shard.least(conv)
            row, at = shard.row, shard.row >= 0
            # in blocks after the first no row links to the root, which is then left out
            at[shard.root] = members[shard.root] > 0
            order = np.flatnonzero(at)
            parent = [np.where(row[order] >= 0, p[row[order]], 0) for p in shard.parent]
            known = pa.array(row[order], mask=row[order] < 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(shard.table.p1[order].view(np.int64)), pa.array(shard.table.p2[order].view(np.int64)), pa.array(parent[0].view(np.int64)), pa.array(parent[1].view(np.int64)),
                pa.array(shard.depth[order]), rows.column("size").combine_chunks().take(known).fill_null(0), rows.column("turn_sha").combine_chunks().take(known),
                pa.array(least[order]), pa.array(members[order])], [f.split(" ")[0] for f in MEMBERS.split(", ")])

    return run


def _sums(depths: int, most: int):
    """Round two: what the rows' own nodes (and later blocks) add to every node above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows, _ in _shards(batches, depths, most):
            tokens, leaves = (shard.added(rows.column(c).to_numpy()) for c in ("tokens", "leaves"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard.table.p1.view(np.int64), shard.table.p2.view(np.int64), tokens, leaves)], ["p1", "p2", "tokens", "leaves"])

    return run


def _listed(ends: DataFrame) -> DataFrame:
    """p1, p2, ends_sha256: SHA-256 of a node's ends in order, comma-joined.

    Sorted ids are joined piece by piece in many tasks; one task per node hashes the pieces as they stream in."""
    order = ["p1", "p2", "conv_id"]

    def pieces(batches):
        for batch in batches:
            p1, p2, conv = (batch.column(k).to_numpy() for k in range(3))
            cut = np.flatnonzero((p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])) + 1
            cut = sorted({0, len(p1), *cut.tolist(), *range(0, len(p1), PIECE)})
            at = np.array(cut[:-1], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p1[at]), pa.array(p2[at]), pa.array(conv[at]), pa.array([",".join(map(str, conv[a:b].tolist())) for a, b in zip(cut, cut[1:])], pa.string())], ["p1", "p2", "first", "ids"])

    def hashed(batches):
        node, sha = None, None
        for batch in batches:
            done = []
            for p1, p2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if node != (p1, p2):
                    if node:
                        done.append((*node, sha.hexdigest()))
                    node, sha = (p1, p2), hashlib.sha256(ids.as_buffer())
                else:
                    sha.update(b",")
                    sha.update(ids.as_buffer())
            yield _digests(done)
        if node:
            yield _digests([(*node, sha.hexdigest())])

    joined = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "p1 bigint, p2 bigint, first bigint, ids string")
    return joined.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInArrow(hashed, "p1 bigint, p2 bigint, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    p1, p2, sha = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(p1, pa.int64()), pa.array(p2, pa.int64()), pa.array(sha, pa.string())], ["p1", "p2", "ends_sha256"])


def _same(column: str) -> Column:
    """The one value of a column in a group; the job fails if there are two."""
    return F.when(F.min(column).eqNullSafe(F.max(column)), F.min(column)).otherwise(F.raise_error(F.lit(f"digests collided: {column}")))


def trie(conversations: DataFrame, depths: int = BLOCK, most: int = SHARD) -> DataFrame:
    """A row per node of the trie of the rebuilt conversations."""
    return nodes(paths(rebuilt(saved(turns(conversations))), depths), depths, most)


def nodes(rows: DataFrame, depths: int = BLOCK, most: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node."""
    rows = saved(rows)
    order = ["conv_id", "block"]
    in_order = lambda df: df.repartitionByRange(*order).sortWithinPartitions(*order, "depth")
    partial = in_order(rows).mapInArrow(_members(depths, most), MEMBERS)
    found = saved(partial.groupBy(*NODE).agg(*[_same(c).alias(c) for c in ("q1", "q2", "depth", "size", "turn_sha")], F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")))
    ends = rows.groupBy("conv_id").agg(F.bit_xor("b1").alias("p1"), F.bit_xor("b2").alias("p2")).select("p1", "p2", "conv_id")
    root = C("depth") == 0
    children = found.where(~root).groupBy(C("q1").alias("p1"), C("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    known = saved(found.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))))

    # what a node adds, charged to the row of its smallest member (the root adds no text, and is a leaf only if alone)
    own = known.where(~root).select("conv_id", "depth", ((C("n_convs") - 1) * C("size")).alias("tokens"), (C("n_children") == 0).cast("bigint").alias("leaves"))
    charged = rows.drop("turn_sha", "size").join(own, ["conv_id", "depth"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("tokens", "leaves")})
    charged = saved(charged)
    # a block's deepest row also carries the sums of the conversation's later blocks
    long = charged.where("block > 0").select("conv_id").distinct()
    blocks = charged.join(long, "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.max("depth").alias("depth"), F.sum("tokens").alias("t"), F.sum("leaves").alias("l"))
    after = W.partitionBy("conv_id").orderBy("block").rowsBetween(1, W.unboundedFollowing)
    later = blocks.select("conv_id", "depth", F.sum("t").over(after).alias("t"), F.sum("l").over(after).alias("l"))
    carried = charged.join(later, ["conv_id", "depth"], "left").withColumns({"tokens": C("tokens") + F.coalesce("t", F.lit(0)), "leaves": C("leaves") + F.coalesce("l", F.lit(0))}).drop("t", "l")
    sums = in_order(carried).mapInArrow(_sums(depths, most), "p1 bigint, p2 bigint, tokens bigint, leaves bigint").groupBy(*NODE).agg(F.sum("tokens").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    # the root, parent of very many, is one value; all other parents are looked up
    top = known.where(root).select("conv_id").scalar()
    above = known.where(~root).select(C("p1").alias("q1"), C("p2").alias("q2"), C("conv_id").alias("_above"))
    placed = known.where("depth > 1").join(above, ["q1", "q2"]).withColumn("parent_conv_id", C("_above")).drop("_above")
    near = known.where("depth <= 1").withColumn("parent_conv_id", F.when(C("depth") == 1, top))
    alone = root & (C("n_children") == 0)
    return (
        placed.unionByName(near).join(sums, NODE, "left").join(_listed(ends), NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.when(alone, F.lit(1).cast("bigint")).otherwise(C("n_leaves")).alias("n_leaves"),
            F.coalesce("saved_tokens", F.lit(0).cast("bigint")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    )
