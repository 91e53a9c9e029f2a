"""Quality rules judged by host.

Each document gets its counts and the rules it fails; failures are aggregated per
host (here ``source``), each host's failure rate is shrunk towards the mean of all
hosts by a beta prior fitted to the hosts' own rates (method of moments), and the
host's verdict is joined back.  A host is refused when any shrunk rate exceeds
``host_limit``; a document is kept when it passes the base rules and its host
stands.

Native: counts are array and regex expressions evaluated inside the scan stage;
5-word windows are compared by a 64-bit hash within one document, sorted with
their positions, so the work is n log n in a document's words.  Only ten numbers
a document are stored and shuffled, never its text.  The join meets stored
tables on both sides, so AQE can split a host that holds a third of all rows, and
per-host counts are combined before their shuffle.

Defined cases: null text has no words (all counts 0, base_failed true); a null
host is a host of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.exprs import fenced
from demandgrid.llm.common import saved

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
HOST_LIMIT = 0.5
C = F.col
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rules() -> dict[str, Column]:
    """rule -> whether a document with these counts fails it"""
    words = F.greatest(C("n_words"), F.lit(1))
    return {
        "short": C("n_words") < MIN_WORDS,
        "repeats": 100 * C("n_repeat_words") > MAX_REPEAT_PERCENT * C("n_words"),
        "symbols": 10 * C("n_symbols") > 3 * words,
        "lines": 10 * C("n_dup_lines") > 3 * C("n_lines"),
        "word_length": (C("word_chars") < 2 * words) | (C("word_chars") > 15 * words),
    }


def counts(docs: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """``keep`` columns plus the counts of every whole text (and n_lines: lines with a word)."""
    text = F.coalesce(C("text").cast("string"), F.lit(""))
    df = fenced(docs.select(*keep, text.alias("_t")), ["_t"])
    df = df.withColumns({
        "_w": F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+"), ""),
        "_lines": F.filter(F.split("_t", r"\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint"),
        "word_chars": F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("bigint"),
    })
    df = fenced(df, ["_w", "_lines", "n_symbols", "word_chars"]).drop("_t")
    n = F.size("_w")
    # struct order: hash, then position; equal windows end up side by side.  The words
    # are picked one by one, as slice() walks the whole array every time
    windows = F.when(n >= window, F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.struct(F.xxhash64(*[F.get("_w", i + k) for k in range(-1, window - 1)]).alias("h"), i.alias("p"))))
    df = fenced(df.withColumns({
        "n_words": n.cast("bigint"), "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_s": F.sort_array(F.coalesce(windows, F.expr("cast(array() as array<struct<h:bigint,p:int>>)"))),
    }), ["n_words", "n_lines", "n_dup_lines", "_s"]).drop("_w", "_lines")
    like = lambda x, i: F.coalesce(x["h"] == F.get("_s", i)["h"], F.lit(False))  # get() is NULL beyond either end
    twice = F.filter("_s", lambda x, i: like(x, i - 1) | like(x, i + 1))
    df = fenced(df.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["p"]))), ["_p"]).drop("_s")
    # words covered by the windows found twice: each adds what the one before has not covered
    cover = F.aggregate(
        "_p", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-window).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).cast("bigint").alias("n"), p.alias("last")))["n"]
    return df.withColumn("n_repeat_words", cover).drop("_p")


def host_verdicts(judged: DataFrame, host: str, host_limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, a shrunk failure rate per rule, host_kept."""
    names = list(rules())
    per = judged.groupBy(host).agg(F.count("*").alias("n_docs"), *[F.sum(C(f"fails_{r}").cast("bigint")).alias(r) for r in names])
    per = saved(per)
    rate = {r: C(r) / C("n_docs") for r in names}
    prior = per.agg(F.struct(*[x for r in names for x in (F.avg(rate[r]).alias(f"m_{r}"), F.coalesce(F.var_pop(rate[r]), F.lit(0.0)).alias(f"v_{r}"))])).scalar()
    shrunk = {}
    for r in names:
        m, v = prior[f"m_{r}"], prior[f"v_{r}"]
        # strength a + b of the beta prior; hosts that all agree give the strongest
        k = F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.coalesce(F.try_divide(m * (1 - m), v) - 1, F.lit(1000.0))))
        shrunk[r] = (C(r) + m * k) / (C("n_docs") + k)
    out = per.select(host, "n_docs", *[x.alias(f"rate_{r}") for r, x in shrunk.items()])
    return out.withColumn("host_kept", F.greatest(*[C(f"rate_{r}") for r in names]) <= host_limit)


def judge(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, host, counts, fails_<rule>, base_failed, host_kept, kept: one row per document."""
    counted = counts(docs.select(C("doc_id").cast("bigint"), C(f"`{host}`").cast("string").alias("host"), "text"), ["doc_id", "host"])
    judged = saved(counted.withColumns({f"fails_{r}": x for r, x in rules().items()}))
    verdicts = saved(host_verdicts(judged, "host", host_limit)).select(C("host").alias("_host"), "host_kept")
    base_failed = C("fails_short") | C("fails_repeats")
    both = judged.join(verdicts, C("host").eqNullSafe(C("_host")), "left").drop("_host")
    return both.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & C("host_kept"))
