import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    *[T.StructField(c, T.StringType()) for c in ("_id", "_row", "key", "n", "size", "fp", "kept", "_text", "h", "label", "piece", "words", "_gone", "target")],
])


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edge_rows():
    """Nulls everywhere, empty and blank texts, a very long one, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(5)
    base, passage, line = sentence(rng, 90), sentence(rng, 70), sentence(rng, 15)
    words = base.split(" ")
    texts = [
        None, "", " \n\t ", "one", "two words", base, base, base.upper(), " ".join(words[:-1] + ["zzz"]), sentence(rng, 40) + " " + passage + " " + sentence(rng, 30),
        passage + "\n" + line, line + "\n" + line, line + " extra\n" + sentence(rng, 12), "tick " * 400, sentence(rng, 120) + "\n" + passage, "É Ünïcode ÀÉ 你好 word", sentence(rng, 6000),
        "<|endoftext|> don't +1 (555) 010-9999 a.b@c.org 10.0.0.1", sentence(rng, 300), "a\nb\na\nb\nc",
    ]
    rows = [(k + 1, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", None]), len(t) if t else None) for k, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, base, None, None, None), (-7, base, "en", "s1", None)]
    return [(*r, *["x"] * 14) for r in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
