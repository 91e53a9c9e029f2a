"""The time-driven tables kept up by Structured Streaming over arriving files.

Each function folds a stream into keyed state and emits a new version of a key's row
whenever that row changes; ``advance`` runs what has arrived (available-now trigger,
checkpoint, exactly-once file sink) and ``current`` reads each key's newest version.  The
rows equal those of ``incremental`` over all rows at once, however the input is cut into
files and in whatever order the files arrive.  State is a few numbers a key, and a state's
rows come in Arrow batches, so a hot key costs time, not memory.

Timers follow the newest stamp seen: a deadline fires when a row of any key is stamped
later, and a late row that renews its key withdraws it by a newer version.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from demandgrid.streaming.incremental import OPT_OUT

C = F.col
# stamps are moved this far ahead and the watermark the same way back: it then stands at
# the newest stamp, which fires timers, and no late row is ever dropped
LAG_DAYS = 40000
# states that the keys of ``timers`` share
BUCKETS = 4096
OUTCOMES = ["hit", "miss", "stale", "live"]


def arriving(spark: SparkSession, folder: str, schema: str | StructType, files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, at most ``files`` of them a step."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def advance(versions: DataFrame, folder: str, checkpoint: str) -> None:
    """Take in all that has arrived since the last call, then stop."""
    run = versions.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of every key's row."""
    rows = spark.read.parquet(folder)
    rest = [c for c in rows.columns if c not in ("key", "version")]
    return rows.groupBy("key").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("key", "r.*")


def timers(rows: DataFrame, key: Column, stamp: Column, seconds: Column, buckets: int = BUCKETS) -> DataFrame:
    """Versions of (key, stamp, seconds, passed): the newest stamp of each key, the longest
    time to live among equal stamps, and whether the newest stamp of all keys lies
    more than that later (whole seconds).  A key without any stamp has passed.

    Cool-downs, expiring entries and follow-ups due are all this: the renewal of a key, its
    time to live and the moment it has passed.

    A call of the state function costs milliseconds whatever it holds, so keys share one of
    ``buckets`` states: calls a step stay bounded while the keys of a state grow with the
    table.  A state's timer is the earliest deadline of its keys; ``buckets`` is part of
    the checkpoint and must not change."""
    whole = F.unix_timestamp(stamp)
    named = rows.select(key.cast("string").alias("key"), whole.alias("stamp"), F.coalesce(seconds.cast("bigint"), F.lit(0)).alias("seconds"))
    clock = F.timestamp_seconds(F.coalesce("stamp", F.lit(0)) + LAG_DAYS * 86400)
    keyed = named.withColumns({"_clock": clock, "_bucket": F.pmod(F.xxhash64("key"), F.lit(buckets))}).withWatermark("_clock", f"{LAG_DAYS} days").groupBy("_bucket")

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = {k: tuple(v) for k, *v in zip(*state.get)} if state.exists else {}
        newest = {k: (v[0], v[1]) if v[0] is not None else None for k, v in old.items()}
        if not state.hasTimedOut:
            for batch in batches:
                # a batch's best row of every key: rows without a stamp come first
                best = batch[["key", "stamp", "seconds"]].sort_values(["key", "stamp", "seconds"], na_position="first").drop_duplicates("key", keep="last")
                for k, at, life in zip(best["key"].tolist(), best["stamp"].tolist(), best["seconds"].tolist()):
                    k = None if pd.isna(k) else k
                    found = None if pd.isna(at) else (int(at), int(life))
                    was = newest.setdefault(k, found)
                    if found is not None and (was is None or found > was):
                        newest[k] = found
        now, rows_, changed, wait = state.getCurrentWatermarkMs(), [], [], []
        for k, top in newest.items():
            passed = top is None or (top[0] + top[1]) * 1000 < now
            was = old.get(k)
            row = (*(top or (None, 0)), passed)
            version = was[3] if was is not None else 0
            if was is None or row != was[:3]:
                version += 1
                changed.append((k, version, *row))
            rows_.append((k, *row, version))
            if not passed:
                wait.append((top[0] + top[1]) * 1000)
        state.update(tuple(map(list, zip(*rows_))))
        if wait:
            # the timer fires when the watermark lies beyond it
            state.setTimeoutTimestamp(max(min(wait), now + 1))
        if changed:
            k, version, at, life, passed = zip(*changed)
            yield pd.DataFrame({"key": k, "version": version, "stamp": pd.array(at, "Int64"), "seconds": life, "passed": passed})

    held = "keys array<string>, stamps array<bigint>, seconds array<bigint>, passed array<boolean>, versions array<bigint>"
    return keyed.applyInPandasWithState(step, "key string, version bigint, stamp bigint, seconds bigint, passed boolean", held, "append", GroupStateTimeout.EventTimeTimeout)


def ledger(calls: DataFrame, key: Column, outcome: Column) -> DataFrame:
    """Versions of a key's hits, misses, stale and live calls."""
    names = ["cache_hits", "cache_misses", "cache_stale", "live_calls"]

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *sums, version = state.get if state.exists else (0, 0, 0, 0, 0)
        for batch in batches:
            seen = batch["outcome"].value_counts()
            sums = [s + int(seen.get(o, 0)) for s, o in zip(sums, OUTCOMES)]
        state.update((*sums, version + 1))
        yield pd.DataFrame({"key": [group[0]], "version": [version + 1], **{n: [s] for n, s in zip(names, sums)}, "served_from_cache": [sums[3] == 0 and sums[0] > 0]})

    columns = ", ".join(f"{n} bigint" for n in names)
    keyed = calls.select(key.cast("string").alias("key"), outcome.alias("outcome")).groupBy("key")
    return keyed.applyInPandasWithState(step, f"key string, version bigint, {columns}, served_from_cache boolean", f"{columns}, version bigint", "append", GroupStateTimeout.NoTimeout)


def replies(rows: DataFrame, address: Column, received: Column, text: Column) -> DataFrame:
    """Versions of an address's first reply (the least text among equal times) and whether
    it opts out.  A reply without a time counts only where no other has one."""
    named = rows.select(F.lower(address).alias("key"), F.coalesce(received.cast("bigint"), F.lit(2**63 - 1)).alias("at"), F.coalesce(text, F.lit("")).alias("text"))

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, words, version = state.get if state.exists else (None, None, 0)
        first = None if at is None else (at, words)
        for batch in batches:
            top = batch[batch["at"] == batch["at"].min()]
            found = (int(top["at"].iloc[0]), str(top["text"].min()))
            first = found if first is None or found < first else first
        if first != (at, words):
            state.update((*first, version + 1))
            yield pd.DataFrame({"key": [group[0]], "version": [version + 1], "received_at": [first[0]], "text": [first[1]]})

    versions = named.groupBy("key").applyInPandasWithState(step, "key string, version bigint, received_at bigint, text string", "at bigint, text string, version bigint", "append", GroupStateTimeout.NoTimeout)
    return versions.withColumn("opted_out", C("text").rlike(OPT_OUT))


def buckets(rows: DataFrame, stamp: Column, seconds: int) -> DataFrame:
    """Versions of the number of rows per span of ``seconds``; a count since a span's edge is a sum of them."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, version = state.get if state.exists else (0, 0)
        total += sum(len(b) for b in batches)
        state.update((total, version + 1))
        yield pd.DataFrame({"key": [group[0]], "version": [version + 1], "created": [total]})

    keyed = rows.where(stamp.isNotNull()).select(F.floor(F.unix_timestamp(stamp) / seconds).cast("bigint").alias("key")).groupBy("key")
    return keyed.applyInPandasWithState(step, "key bigint, version bigint, created bigint", "created bigint, version bigint", "append", GroupStateTimeout.NoTimeout)
