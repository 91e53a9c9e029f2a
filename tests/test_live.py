"""Streams cut into files, in any order, against the batch operators over all rows."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from demandgrid.streaming import incremental as IN
from demandgrid.streaming import live as L

C = F.col
DAY0 = datetime(2024, 1, 1)


def arrive(spark, folder, rows, schema, order):
    """Three files, stamped so that the stream takes them in ``order``."""
    os.makedirs(folder)
    for place, part in enumerate(order):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.parquet(f"{folder}-part{part}")
        (name,) = [n for n in os.listdir(f"{folder}-part{part}") if n.endswith(".parquet")]
        target = f"{folder}/f{part}.parquet"
        os.link(f"{folder}-part{part}/{name}", target)
        os.utime(target, (1_700_000_000 + 100 * place,) * 2)


ORDERS = [(0, 1, 2), (2, 0, 1)]


@pytest.mark.parametrize("order", ORDERS)
def test_timers(spark, tmp_path, order):
    draw = random.Random(1)
    schema = "key string, as_of timestamp, ttl_seconds bigint"
    rows = [(f"k{draw.randint(0, 15)}", DAY0 + timedelta(seconds=draw.randint(0, 400_000)), draw.choice([0, 3600, 100_000])) for _ in range(90)]
    rows += [("null", None, 5), ("mixed", None, 5), ("mixed", DAY0 + timedelta(seconds=399_999), 3600), ("edge", DAY0 + timedelta(seconds=390_000), 10_001), ("edge2", DAY0 + timedelta(seconds=390_000), 10_000), ("top", DAY0 + timedelta(seconds=400_001), 9)]
    arrive(spark, str(tmp_path / "in"), rows, schema, order)
    stream = L.arriving(spark, str(tmp_path / "in"), schema, 1)
    L.advance(L.timers(stream, C("key"), C("as_of"), C("ttl_seconds")), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.key for r in L.current(spark, str(tmp_path / "out")).where("passed").collect()}
    table = spark.createDataFrame(rows, schema).groupBy("key").agg(F.max(F.struct("as_of", "ttl_seconds")).alias("r")).select("key", "r.*")
    newest = max(r[1] for r in rows if r[1])
    assert got == {r.key for r in IN.expired(table, F.lit(newest)).collect()}
    assert "edge2" in got and "edge" not in got and "null" in got and "mixed" not in got
    # a later file moves the clock on and renews one key
    spark.createDataFrame([("edge2", newest + timedelta(days=30), 60)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    L.advance(L.timers(stream, C("key"), C("as_of"), C("ttl_seconds")), str(tmp_path / "out"), str(tmp_path / "ck"))
    later = {r.key: r.passed for r in L.current(spark, str(tmp_path / "out")).collect()}
    assert not later.pop("edge2") and all(later.values())


@pytest.mark.parametrize("order", ORDERS)
def test_ledger_replies_buckets(spark, tmp_path, order):
    draw = random.Random(2)
    schema = "key string, outcome string, at bigint, text string, made timestamp"
    rows = [(f"A{draw.randint(0, 9)}@x", draw.choice([*L.OUTCOMES, None]), draw.choice([draw.randint(0, 1000), None]), draw.choice(["please unsubscribe", "ok", "call me"]), DAY0 + timedelta(seconds=draw.randint(0, 400_000))) for _ in range(120)]
    arrive(spark, str(tmp_path / "in"), rows, schema, order)
    stream, table = L.arriving(spark, str(tmp_path / "in"), schema, 1), spark.createDataFrame(rows, schema)

    def run(name, versions):
        L.advance(versions, str(tmp_path / name), str(tmp_path / f"{name}-ck"))
        return L.current(spark, str(tmp_path / name))

    batch = IN.run_ledger(table.select("key", "outcome"))
    assert sorted(map(tuple, run("ledger", L.ledger(stream, C("key"), C("outcome"))).collect())) == sorted(map(tuple, batch.collect()))
    first = table.groupBy(F.lower("key").alias("key")).agg(F.min(F.struct(F.coalesce("at", F.lit(2**63 - 1)).alias("at"), "text")).alias("r")).select("key", "r.at", "r.text")
    got = run("replies", L.replies(stream, C("key"), C("at"), C("text"))).collect()
    assert sorted((r.key, r.received_at, r.text) for r in got) == sorted(map(tuple, first.collect()))
    assert {r.opted_out for r in got if "unsub" in r.text} <= {True} and not any(r.opted_out for r in got if "unsub" not in r.text)
    edge = DAY0 + timedelta(hours=48)
    spans = run("buckets", L.buckets(stream, C("made"), 3600))
    since = spans.where(C("key") >= F.lit(int((edge - datetime(1970, 1, 1)).total_seconds()) // 3600)).agg(F.sum("created")).first()[0]
    assert since == sum(r[4] >= edge for r in rows)


def test_keys_of_timers_share_states(spark, tmp_path):
    """The state function is called per state, not per key: calls stay few while keys grow."""
    rows = [(f"k{i % 300}", DAY0 + timedelta(seconds=i % 300 * 10 + i // 300), i % 7) for i in range(600)] + [(None, DAY0, 1)]
    schema = "key string, as_of timestamp, ttl_seconds bigint"
    arrive(spark, str(tmp_path / "in"), rows, schema, (1, 0, 2))
    stream = L.arriving(spark, str(tmp_path / "in"), schema, 1)
    versions = L.timers(stream, C("key"), C("as_of"), C("ttl_seconds"), 4)
    L.advance(versions, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.key: (r.stamp, r.seconds, r.passed) for r in L.current(spark, str(tmp_path / "out")).collect()}
    table = spark.createDataFrame(rows, schema).groupBy("key").agg(F.max(F.struct(F.unix_timestamp("as_of").alias("t"), "ttl_seconds")).alias("r")).collect()
    newest = max(r.r.t for r in table)
    assert got == {r.key: (r.r.t, r.r.ttl_seconds, newest > r.r.t + r.r.ttl_seconds) for r in table}
    states = spark.read.format("statestore").load(str(tmp_path / "ck"))
    assert states.count() <= 4
