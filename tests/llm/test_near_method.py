"""The near stage goes through the SimHash operator before the exact join."""

import random

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from demandgrid.llm import near_dedup, simhash


def test_simhash_joins_copies_before_the_exact_join(spark, monkeypatch):
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*words[:-1], f"end{k}"])) for k in range(6)] + [(k, " ".join(f"x{k}y{i}" for i in range(60))) for k in range(6, 9)] + [(9, None), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked, found = [], near_dedup._fingerprinted
    monkeypatch.setattr(near_dedup, "_fingerprinted", lambda *a: linked.append(found(*a)) or linked[-1])
    near = sorted((r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()), key=str)
    assert near == sorted([0, 6, 7, 8, 9, None], key=str)
    prints = simhash.near_duplicates(docs).where("doc_id < 6")
    alike = prints.select("component_id").distinct().count() < 6
    assert alike and linked[0].count() >= 1


def test_unlike_documents_of_one_group_are_not_paired(spark, monkeypatch):
    """Documents that share most shingles, but not enough, with many others: pairs that cannot be similar are no rows."""
    rng, met, bounded = random.Random(2), [], near_dedup._bounded
    passages = [[f"p{k}w{i}" for i in range(12)] for k in range(14)]
    texts = sorted({" ".join(w for k in sorted(rng.sample(range(14), 8)) for w in passages[k]) for _ in range(150)})
    rows = list(enumerate(texts)) + [(1000, texts[0] + " end")]
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string").repartition(3)
    monkeypatch.setattr(near_dedup, "_bounded", lambda prints, pairs, percent: met.append(pairs.count()) or bounded(prints, pairs, percent))
    got = {r.doc_id: r.component_id for r in near_dedup.classes(docs).collect()}
    want = brute.near_classes(rows)
    assert got == dict(zip([k for k, _ in rows], want))
    assert len(met) > 1 and sum(met[1:]) < 5 * len(rows)


def test_a_pair_of_an_open_group_is_met_once(spark, monkeypatch):
    """Documents that share whole passages stand together under many shingles; they are compared, and rows, under one."""
    rng, rows, meet = random.Random(4), [], near_dedup._meet_alike
    passages = [[f"p{k}w{i}" for i in range(40)] for k in range(12)]
    chosen = sorted({tuple(sorted(rng.sample(range(12), 9))) for _ in range(90)})
    texts = [" ".join(w for k in c for w in passages[k]) for c in chosen]
    alike = sum(len({*a} & {*b}) >= 8 for k, a in enumerate(chosen) for b in chosen[:k])

    def counted(percent, named):
        run, count = meet(percent, named), spark.sparkContext.accumulator(0)
        rows.append(count)

        def met(batches):
            for batch in run(batches):
                count.add(batch.num_rows)
                yield batch

        return met

    docs = list(enumerate(texts))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.lit("s")).repartition(3)
    monkeypatch.setattr(near_dedup, "_meet_alike", counted)
    got = {r.doc_id: r.component_id for r in near_dedup.classes(table).collect()}
    assert got == dict(zip([k for k, _ in docs], brute.near_classes(docs)))
    assert rows and max(r.value for r in rows) <= alike
