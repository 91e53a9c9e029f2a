"""Time-driven table logic as incremental batch operators.

The analytics has no streams of its own: each run takes a state table, the new
rows and an ``as_of`` time, and returns what is due.  ``as_of`` is an argument, so
a run can be repeated exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.exprs import n, pick
from demandgrid.operators.ranks import global_rank

C = F.col

# fixed values: wording of an opt-out
OPT_OUT = r"(?i)unsubscribe|remove me|stop email|do not (?:contact|email)|not interested|no longer interested"


def due_touches(sequences: DataFrame, as_of: Column, cap: int, sent_today: int) -> DataFrame:
    """Follow-ups due now in sequence order; those beyond the daily cap are marked.

    Few rows fit under the cap, so they come from a top-k; only the remaining
    ones are marked by an anti-join, without ranking the table."""
    due = sequences.where((C("status") == "ACTIVE") & (C("next_touch_at") <= as_of))
    send = due.orderBy("position").limit(max(0, cap - sent_today)).select("lead_id").withColumn("_s", F.lit(True))
    return due.join(send, "lead_id", "left").withColumn("outcome", F.when(C("_s"), "send").otherwise("capped")).drop("_s")


def reply_intake(sequences: DataFrame, replies: DataFrame) -> DataFrame:
    """First reply per address stops its open sequence; wording decides how."""
    first = replies.groupBy(F.lower("from_email").alias("to_email")).agg(F.min_by(F.concat_ws(" ", "subject", "snippet"), "received_at").alias("text"))
    open_ = sequences.where(C("status").isin("PENDING_APPROVAL", "ACTIVE", "DONE"))
    out = C("text").rlike(OPT_OUT)
    return open_.join(first, "to_email").select("lead_id", F.when(out, "STOPPED_OPT_OUT").otherwise("STOPPED_REPLIED").alias("status"),
                                                F.when(out, "NOT_INTERESTED").otherwise("REPLIED").alias("outreach_status"))


def refresh_allowed(state: DataFrame, as_of: Column, seconds: int = 900) -> DataFrame:
    """Keys whose last refresh is long enough ago (or unknown)."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp("refreshed_at")
    return state.withColumn("allowed", F.coalesce(age >= seconds, F.lit(True)))


def created_since(log: DataFrame, as_of: Column, hours: float) -> DataFrame:
    edge = F.unix_timestamp(as_of) - F.lit(int(hours * 3600))
    return log.agg(n(F.unix_timestamp("created_at") >= edge).alias("created"))


def expired(entries: DataFrame, as_of: Column) -> DataFrame:
    """Cache entries past their time to live; an unreadable stamp is expired."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp("as_of")
    return entries.where(F.coalesce(age > C("ttl_seconds"), F.lit(True)))


def run_ledger(calls: DataFrame) -> DataFrame:
    """Hits, misses, stale and live calls per key."""
    k = lambda s: n(C("outcome") == s)
    return calls.groupBy("key").agg(k("hit").alias("cache_hits"), k("miss").alias("cache_misses"), k("stale").alias("cache_stale"), k("live").alias("live_calls"),
                                    ((k("live") == 0) & (k("hit") > 0)).alias("served_from_cache"))


def fresh_within(stamp: Column, as_of: Column, days: int) -> Column:
    return F.coalesce(F.unix_timestamp(as_of) - F.unix_timestamp(stamp) <= days * 86400, F.lit(False))
