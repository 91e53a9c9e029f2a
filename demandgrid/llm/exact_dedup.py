"""Exact deduplication by Grace hashing.

Texts are equal when their bytes are equal after A-Z is lower-cased (null counts
as empty).  Records are partitioned by a 64-bit hash until a bucket fits an
open-addressing table that compares complete content:

1. every map task folds its own copies in such a table first, so a text that a
   third of all rows share leaves a task once per flush, not once per row;
2. the first partitioning is Spark's shuffle by hash; its spill files are the
   Grace partitions.  Inside a partition the rows stream in hash order (Spark's
   external sorter spills runs to disk), so every range of hash values is a
   bucket.  A bucket is closed at the first change of hash after its table holds
   ``table_bytes`` of content, which splits a partition as deep as needed;
   memory is one table plus one record.
3. groups of two or more rows are joined back to the (id, digest) rows of a
   second scan.  Both sides are exchanged, so AQE can split a hot digest.

Defined cases: null text = empty text; a null doc_id counts as smaller than any
other; rows repeated under one doc_id and text stay or go together; no rows give
no rows; other columns of the input pass through ``deduplicate`` unchanged and
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import LOWER_BYTES, lean, saved, without

TABLE_BYTES = 32 << 20
PARTIAL = "h bigint, content binary, keep_id bigint, n bigint"


class ContentTable:
    """Open addressing with linear probing; a slot is free, or holds the number of
    an entry.  Equal means equal bytes; the hash only says where to look."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.keep: list[int | None] = []
        self.count: list[int] = []
        self.bytes = 0

    def _grow(self) -> None:
        mask = 4 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k

    def add(self, h: int, content: bytes, doc_id: int | None, n: int) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                self.count[k] += n
                if doc_id is not None and (self.keep[k] is None or doc_id > self.keep[k]):
                    self.keep[k] = doc_id
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.keep.append(doc_id)
        self.count.append(n)
        self.bytes += len(content) + 64
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _fold(table_bytes: int):
    """Map side: the copies within a task, flushed whenever the table is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = ContentTable()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([_signed(h) for h in seen.hashes], pa.int64()), pa.array(seen.contents, pa.binary()),
                 pa.array(seen.keep, pa.int64()), pa.array(seen.count, pa.int64())], ["h", "content", "keep_id", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = (raw.as_py() or b"").translate(LOWER_BYTES)
                seen.add(xxhash.xxh64_intdigest(content), content, doc_id, 1)
                if seen.bytes > table_bytes:
                    yield flush()
        if seen.hashes:
            yield flush()

    return run


def _settle(table_bytes: int):
    """Reduce side: buckets are ranges of the hash, closed when their table is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, last = ContentTable(), None

        def close() -> pa.RecordBatch:
            many = [k for k, n in enumerate(bucket.count) if n > 1]
            out = pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(bucket.contents[k]).hexdigest() for k in many], pa.string()),
                 pa.array([bucket.keep[k] for k in many], pa.int64()), pa.array([bucket.count[k] for k in many], pa.int64())],
                ["text_sha256", "keep_id", "group_size"])
            bucket.clear()
            return out

        for batch in batches:
            for h, content, keep, n in zip(*(c.to_pylist() for c in batch.columns)):
                if h != last and bucket.bytes > table_bytes:
                    yield close()
                last = h
                bucket.add(h & (1 << 64) - 1, content, keep, n)
        if bucket.hashes:
            yield close()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256((x.as_py() or b"").translate(LOWER_BYTES)).hexdigest() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.string())], ["doc_id", "_text", "text_sha256"])


def copy_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """text_sha256, keep_id (largest doc_id), group_size of every text that two or more rows share."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    return (
        rows.mapInArrow(lean(_fold(table_bytes)), PARTIAL)
        .repartition("h").sortWithinPartitions("h")
        .mapInArrow(lean(_settle(table_bytes)), "text_sha256 string, keep_id bigint, group_size bigint")
    )


def _members(docs: DataFrame, table_bytes: int) -> DataFrame:
    """One row per document: its group (nulls for a lone text) by a join of digests."""
    groups = saved(copy_groups(docs, table_bytes))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    return rows.mapInArrow(_digests, "doc_id bigint, _text bigint, text_sha256 string").join(groups, "text_sha256", "left")


def groups_of_copies(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    lone = F.col("group_size").isNull()
    keep_id = F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return _members(docs, table_bytes).select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns."""
    gone = _members(docs, table_bytes).where(F.col("group_size").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return without(docs, saved(gone.select("doc_id", "_text")))
