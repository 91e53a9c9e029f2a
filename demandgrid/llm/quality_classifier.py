"""Quality classifier: a sparse rule ensemble.

1. Every whole text becomes a dozen statistics (Arrow batches, nothing else is
   kept of a text).
2. Shallow random-forest trees are grown on a bounded sample of labelled rows
   outside the held-out fold (``fit_rows``, the ids first in md5 order).  Every
   path of a tree to any of its nodes is a conjunctive rule over the statistics.
3. Lasso logistic regression on the 0/1 rules of the sample keeps a sparse set of
   them with weights.
4. The rules that stay compile to one Spark column: the logistic of the sum of
   the weights of the rules that hold.

Defined cases: null and empty texts have all statistics 0 and are scored like any
other; when no labelled rows (or one class only) can be learnt from, the score is
the labels' smoothed mean (0.5 without labels); rows repeated under one doc_id are
scored each but learnt from once; different labels of one doc_id count each.  labels, lang, source and
doc_id never enter a statistic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import WORDS, crc_mod, lean, saved, without

FIT_ROWS = 12_000
THRESHOLD = 0.7
C = F.col
STATS = ("log_words", "word_length", "distinct_share", "upper_share", "digit_share", "mark_share", "bang_share", "bar_share",
         "dot_share", "line_words", "distinct_lines", "common_share", "single_share", "top_share", "repeat_share")
UPPER, DIGIT, MARK = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[#*$%&<>]")


def statistics(text: str) -> tuple[float, ...]:
    import math
    from collections import Counter

    words = WORDS.findall(text)
    n, chars = len(words), len(text)
    if not n:
        return (0.0,) * len(STATS)
    times = Counter(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\r\v\f")]
    top = [k for _, k in times.most_common(10)]
    pairs = set(zip(words, words[1:]))
    return (
        math.log1p(n), sum(map(len, times.elements())) / n, len(times) / n, len(UPPER.findall(text)) / chars, len(DIGIT.findall(text)) / chars,
        len(MARK.findall(text)) / n, text.count("!") / n, text.count("|") / n, text.count(".") / n, min(n / len(lines), 1000.0), len(set(lines)) / len(lines),
        sum(top) / n, sum(1 for k in times.values() if k == 1) / n, top[0] / n, 1.0 - len(pairs) / max(1, n - 1))


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = pd.DataFrame([statistics(t or "") for t in batch["text"]], columns=list(STATS), dtype="float64")
        out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
        out.insert(1, "_text", batch["_text"])
        yield out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, _text (hash of the text) and the statistics of every whole text."""
    rows = docs.select(C("doc_id").cast("bigint"), F.xxhash64(C("text").cast("string")).alias("_text"), C("text").cast("string"))
    return rows.mapInPandas(lean(_measure), "doc_id bigint, _text bigint, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", bound), all of which must hold


def tree_rules(node, path: dict | None = None) -> list[Rule]:
    """The paths from the root to every other node; bounds on one statistic merge."""
    path = path or {}
    if not hasattr(node, "leftChild"):
        return []
    stat, bound = STATS[node.split().featureIndex()], round(node.split().threshold(), 6)
    out = []
    for child, side in ((node.leftChild(), "<="), (node.rightChild(), ">")):
        old = path.get((stat, side))
        to = bound if old is None else (min if side == "<=" else max)(old, bound)
        longer = path | {(stat, side): to}
        out += [tuple((s, o, b) for (s, o), b in sorted(longer.items())), *tree_rules(child, longer)]
    return out


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for stat, side, bound in rule:
        out = out & (C(stat) <= bound if side == "<=" else C(stat) > bound)
    return out


class RuleEnsemble:
    """intercept and weighted rules; ``score`` is a native column over STATS."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]) -> None:
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            z = z + F.when(holds(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def fit(sample: DataFrame, trees: int = 24, depth: int = 3, lasso: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """From rows of STATS and label (0/1); the sample must be bounded by the caller."""
    import math

    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < n:
        p = (ones + 1) / (n + 2)
        return RuleEnsemble(math.log(p / (1 - p)), [])
    rows = sample.select(C("label").cast("double"), array_to_vector(F.array(*[C(s) for s in STATS])).alias("stats"), *STATS)
    forest = RandomForestClassifier(labelCol="label", featuresCol="stats", numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.7, featureSubsetStrategy="0.5", seed=seed).fit(rows)
    found = sorted({rule for tree in forest.trees for rule in tree_rules(_Node(tree._call_java("rootNode")))})
    flags = rows.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in found])).alias("rules")) if found else None
    if flags is None:
        return RuleEnsemble(math.log(ones / (n - ones)), [])
    model = LogisticRegression(labelCol="label", featuresCol="rules", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(flags)
    weights = [(r, float(w)) for r, w in zip(found, model.coefficients.toArray()) if abs(w) > 1e-9]
    return RuleEnsemble(float(model.intercept), weights)


class _Node:
    """A node of a fitted tree (an inner node has children)."""

    def __init__(self, java) -> None:
        self.java = java
        if java.getClass().getSimpleName() == "InternalNode":
            self.leftChild = lambda: _Node(java.leftChild())
            self.rightChild = lambda: _Node(java.rightChild())
            self.split = java.split


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return _scored(saved(measured(docs)), labels, fit_rows, threshold).drop("_text")


def _scored(stats: DataFrame, labels: DataFrame, fit_rows: int, threshold: float) -> DataFrame:
    held = crc_mod(C("doc_id"), 4) == 2
    known = labels.select(C("doc_id").cast("bigint").alias("_id"), C("quality").cast("int").alias("label")).where(C("label").isNotNull() & (crc_mod(C("_id"), 4) != 2))
    order = F.md5(C("_id").cast("string").cast("binary"))
    first = known.distinct().orderBy(order, "_id", "label").limit(fit_rows)
    # at most fit_rows labels; documents without labels never reach the fit
    rows = stats.join(F.broadcast(first), C("doc_id") == C("_id")).dropDuplicates(["_id", "_text", "label"])
    cut = rows.orderBy(order, "_id", "label", "_text").limit(2 * fit_rows).select("label", *STATS)
    # one sorted file of bounded length: the forest's bagging depends on the order of rows
    sample = saved(cut.orderBy("label", *STATS).coalesce(1))
    model = fit(sample)
    return stats.select("doc_id", "_text", F.coalesce(held, F.lit(False)).alias("held_out"), model.score().alias("score")).withColumn("predicted", (C("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted good, with all their columns."""
    stats = saved(measured(docs))
    bad = _scored(stats, labels, fit_rows, threshold).where("predicted = 0")
    return without(docs, saved(bad.select("doc_id", "_text")))
