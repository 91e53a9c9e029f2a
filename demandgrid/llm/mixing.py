"""Mixing sources to target weights by weighted fair queueing.

Sources in code point order (null last) weigh ``weights`` in turn and share
``share`` times all words.  A target stops at ``epochs`` times its source's size;
what is over is shared again by weight.  With the sources sorted by cap / weight
this is one pass: a source is capped if its own ratio lies below the level that
the sources from it onwards would share, and the level of the first one that is
not capped holds for all the rest.

Every source's documents are shuffled by a hash of the id and queued ``epochs``
times over.  A document's virtual finish time is the source's cumulative words up
to its end over the source's target, so all sources run out of budget together
at time 1; the document in service at that moment is served only up to it (at
most one per source is cut).  All queues are merged by a global range sort on the
finish time and truncated at the total budget.

Native: running totals come from range partitions plus offsets, so neither a hot
source nor the whole table is ever ordered in one task.

Defined cases: null text has size 0; documents of size 0 are never taken; a null
source is a source of its own; equal rows share one place in the order and are
both counted; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import n_words, saved
from demandgrid.operators.ranks import global_rank, running_total

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
C = F.col


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, src_no, source_size, target from (source, size) rows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(per, [C("source").isNull(), C("source")], "src_no")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(C("src_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    fair = saved(ranked.select("source", "src_no", "source_size", turn.cast("bigint").alias("w"), (C("source_size") * epochs).alias("cap")))
    ratio = C("cap") / C("w")
    run = running_total(fair, [ratio, C("src_no")], C("w"), "w_upto")
    run = running_total(run, [ratio, C("src_no")], C("cap"), "cap_upto")
    whole = fair.agg(F.struct(F.sum("source_size").alias("n"), F.sum("w").alias("w"))).scalar()
    level = (whole["n"] * F.lit(share) - (C("cap_upto") - C("cap"))) / (whole["w"] - (C("w_upto") - C("w")))
    levels = saved(run.withColumn("level", level).withColumn("capped", ratio < C("level")))
    rest = levels.where(~C("capped")).agg(F.min_by("level", F.struct(ratio, C("src_no")))).scalar()
    return levels.select("source", "src_no", "source_size", F.least(C("cap").cast("double"), rest * C("w")).alias("target"))


def queued(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, size, source, source_size, target, ends (words of the source up to the document's end, first epoch)."""
    sizes = saved(docs.select(C("doc_id").cast("bigint"), C("source").cast("string"), n_words(C("text").cast("string")).alias("size")))
    targets = saved(source_targets(sizes, weights, share, epochs))
    t = targets.select(C("source").alias("_source"), "src_no", "source_size", "target")
    placed = sizes.join(t, C("source").eqNullSafe(C("_source"))).drop("_source")
    shuffled = [F.md5(C("doc_id").cast("string").cast("binary")), C("doc_id")]
    return running_total(placed, shuffled, C("size"), "ends", ["src_no"])


def _served(ends: Column, epoch: Column | int) -> Column:
    """Words of one copy that its source's target still covers."""
    start = ends - C("size") + epoch * C("source_size")
    return F.greatest(F.lit(0), F.least(C("size"), F.floor("target") - start)).cast("bigint")


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, queue: DataFrame | None = None) -> DataFrame:
    """The merged queue: one row per copy taken (doc_id, source, epoch, served words,
    finish, position = words of the mix up to its end)."""
    queue = queued(docs, weights, share, epochs) if queue is None else queue
    copies = queue.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("served", _served(C("ends"), C("epoch")))
    finish = (C("ends") - C("size") + C("epoch") * C("source_size") + C("served")) / C("target")
    sent = copies.where(C("served") > 0).withColumn("finish", finish)
    merged = running_total(sent, [C("finish"), C("src_no"), C("epoch"), C("ends"), C("doc_id")], C("served"), "position")
    budget = queue.agg(F.floor(F.lit(share) * F.sum("size"))).scalar()
    return merged.where(C("position") <= budget)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    queue = saved(queued(docs, weights, share, epochs))
    cut = schedule(docs, weights, share, epochs, queue).agg(F.coalesce(F.max("finish"), F.lit(-1.0))).scalar()

    def taken(epoch: int) -> Column:
        served = _served(C("ends"), epoch)
        finish = F.try_divide(C("ends") - C("size") + epoch * C("source_size") + served, C("target"))
        return F.when((served > 0) & (finish <= cut), served).otherwise(F.lit(0))

    total = taken(0)
    for e in range(1, epochs):
        total = total + taken(e)
    return queue.select("doc_id", "size", "source_size", "target", total.cast("bigint").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The documents of the mix with all their columns, one row per copy.  A copy that
    is cut keeps its first words, joined by one space.

    Within a source and epoch the schedule takes the shuffled documents up to a last
    one, so a row per source and epoch says all; texts are never shuffled for it.  Rows
    repeated under the last one's doc_id are cut alike."""
    last = F.max(F.struct("order", "doc_id", C("served").cast("bigint").alias("served"))).alias("last")
    sent = schedule(docs, weights, share, epochs).withColumn("order", F.md5(C("doc_id").cast("string").cast("binary")))
    cuts = sent.groupBy("src_no", "source", "epoch").agg(last).groupBy(C("source").alias("_src")).agg(F.collect_list("last").alias("_cuts"))
    words = F.array_remove(F.split(C("_row.text").cast("string"), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select(
        F.struct(*[C(f"`{c}`") for c in docs.columns]).alias("_row"), C("source").cast("string").alias("_source"), C("doc_id").cast("bigint").alias("_id"),
        F.md5(C("doc_id").cast("string").cast("binary")).alias("_order"), n_words(C("text").cast("string")).alias("_words")).where("_words > 0")
    both = rows.join(saved(cuts), C("_source").eqNullSafe(C("_src")))
    me = F.struct(C("_order").alias("order"), C("_id").alias("doc_id"))
    served = F.transform("_cuts", lambda c: F.when(me < F.struct(c["order"].alias("order"), c["doc_id"].alias("doc_id")), C("_words")).when(
        (C("_order") == c["order"]) & C("_id").eqNullSafe(c["doc_id"]), F.least(c["served"], C("_words"))).otherwise(F.lit(0)))
    copies = both.select("_row", "_words", F.explode(served).alias("_served")).where("_served > 0")
    text = F.when(C("_served") == C("_words"), C("_row.text")).otherwise(F.array_join(F.slice(words, 1, C("_served").cast("int")), " "))
    return copies.select(*[(text if c == "text" else C("_row")[c]).alias(c) for c in docs.columns])
