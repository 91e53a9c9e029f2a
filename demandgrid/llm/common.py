"""Shared pieces of the corpus operators."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.session import shared_dir

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: ASCII letters only, on UTF-8 bytes and on strings.
LOWER_BYTES = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LOWER_TEXT = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows while the block runs: rows here are whole
    texts, and a batch is held once in the JVM and once in the Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lean(run: Callable) -> Callable:
    """``run`` (batches -> batches), after which the worker gives free memory back to the
    system: workers are reused, and what one stage has freed would count beside the next one's."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # not glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return inner


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder once, read back.

    A lost executor then costs a re-read, not a recomputation, and the optimizer
    sees the true size of the table."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n: the fixed folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def _bitmap(rows: DataFrame, ids: DataFrame, bits: int, key: str) -> DataFrame:
    """``rows`` with ``_hit``: whether their key may be among ``ids`` (always true if it is).

    A bitmap of hashed ids, at most ``bits`` / 64 rows whatever the input, is broadcast."""
    # ids are compared as numbers, whatever type the table gives them
    h = F.xxhash64(F.col(key).cast("bigint")).bitwiseAND(bits - 1)
    words = ids.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, int(h & 63))")).alias("_m"))
    marked = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), h.alias("_h")).join(F.broadcast(words), F.shiftright("_h", 6) == F.col("_w"), "left")
    return marked.select("_row", F.coalesce(F.expr("(_m & shiftleft(1L, int(_h & 63))) != 0"), F.lit(False)).alias("_hit"))


def pruned(rows: DataFrame, ids: DataFrame, key: str = "doc_id", bits: int = 1 << 24) -> DataFrame:
    """``rows`` without most of those whose key is not among ``ids``, so that the join that
    follows need not shuffle the others (their texts, mostly).  The more ids there
    are, the more other rows pass too; wanted rows always do."""
    return _bitmap(rows, ids, bits, key).where("_hit").select("_row.*")


def without(docs: DataFrame, gone: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """``docs`` less the rows in ``gone`` (a stored table of doc_id, _text = xxhash64 of
    the text); only rows that may be among them are shuffled for the anti-join."""
    marked = _bitmap(docs, gone, bits, "doc_id")
    named = gone.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash")).distinct()
    text = F.xxhash64(F.col("_row.text").cast("string"))
    stays = marked.where("_hit").join(named, F.col("_row.doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (text == F.col("_hash")), "left_anti")
    return marked.where(~F.col("_hit")).union(stays).select("_row.*")
