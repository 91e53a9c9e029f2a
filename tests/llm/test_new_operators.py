"""Prefix trie, rare-feature digests and phrases against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from demandgrid.llm import phrases, prefix_trie, rare_features

from brute import LOWER

# ---- op11


def plain_trie(rows):
    """rows: (conv_id, turn, role, text) -> {(conv_id, depth): rest of the row}"""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        whole = (*own.get(base, [])[:h], *mine[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, tokens = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            tokens[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return {(min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], tokens[p], sha(ends[p])) for p, m in members.items()}


def found_trie(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, block string, i string, p1 string, n_convs string"


def odd_turns():
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "é", "", None])) for c in [-7, -5, *range(40)] for t in range(rng.randint(1, 13))]
    rows += [(1000 + k, t, "user", f"same {t}") for k in range(30) for t in range(12)]  # copies
    rows += [(50, None, "user", "null turn"), (50, None, "user", "null turn"), (50, 3, "z", "tie"), (50, 3, "y", "tie"), (None, 1, "user", "nobody")]
    rows += [(200, t, "user", str(t % 7)) for t in range(60)] + [(201, t, "user", str(t % 7)) for t in range(45)]  # long ones
    rows += [(303, 0, "user", "no base, one turn")]
    return rows


@pytest.mark.parametrize("depths, most", [(4096, 1 << 18), (4, 20)])
def test_trie_equals_plain_one(spark, depths, most):
    rows = odd_turns()
    df = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], TURNS).repartition(4)
    assert found_trie(prefix_trie.trie(df, depths, most)) == plain_trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    for rows in ([(303, 0, "user", "x")], [(8, 1, None, None)], [(None, 1, "u", "x")]):
        assert found_trie(prefix_trie.trie(spark.createDataFrame([(*r, *["x"] * 5) for r in rows], TURNS))) == plain_trie(rows)


def test_trie_of_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found_trie(prefix_trie.trie(df, most=50)) == plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000, 50_000):
        p1, p2 = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        p1[: n // 2] = 5  # only the second half tells these apart
        h = prefix_trie.PerfectHash(p1, p2)
        s = h.slots(p1, p2)
        assert sorted(s) == list(range(n))
        assert (h.slots(p1, p2 ^ np.uint64(1 << 63)) == -1).all()


# ---- op13


def plain_phrases(rows, min_count, longest, inside, top):
    """rows: (lang, text) -> {(lang, rank): (phrase, a, l, r, n, score)}"""
    import re

    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        longer = [b for (m, q), b in cand.items() if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= inside * a for b in longer):
            continue
        s, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-s, -a, " ".join(p).encode(), l, r))
    return {(lang, k + 1): (p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top])}


@pytest.mark.parametrize("min_count, longest, inside, top", [(10, 3, 50, 2000), (3, 4, 40, 30)])
def test_phrases_equal_plain_counts(spark, small, min_count, longest, inside, top):
    rows = [(r["lang"], r["text"]) for r in small.collect()]
    got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in phrases.top_phrases(small, top, min_count, longest, inside).collect()}
    assert got == plain_phrases(rows, min_count, longest, inside, top) and got


def test_phrases_of_odd_rows(spark, edge, empty):
    rows = [(r["lang"], r["text"]) for r in edge.collect()]
    got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in phrases.top_phrases(edge, min_count=2).collect()}
    assert got == plain_phrases(rows, 2, 3, 50, 2000) and got
    assert phrases.top_phrases(empty).count() == 0


def test_long_texts_are_cut_where_pieces_end(monkeypatch, spark):
    monkeypatch.setattr(phrases, "CHUNK", 50)
    text = b"one two three\n" * 9 + b"x " * 60 + b"\nend"
    assert b"".join(phrases._cut(text)) == text
    assert all(b.endswith(b"\n") for b in list(phrases._cut(text))[:-1])


def test_summary_never_loses_a_frequent_hash():
    rng = np.random.default_rng(3)
    for threshold in (2, 5, 10):
        values = rng.zipf(1.3, 20_000).astype(np.uint64) % np.uint64(3000)
        exact = Counter(values.tolist())
        s = phrases.Summary(len(values) // threshold + 1)
        for part in np.array_split(values, 37):
            h, c = np.unique(part, return_counts=True)
            s.add(h, c)
            s.merge()
        found = set(s.frequent(threshold).tolist())
        assert {h for h, n in exact.items() if n >= threshold} <= found
        assert s.lost < threshold and len(s.counts) <= s.capacity


def test_summary_decrements_when_full():
    s = phrases.Summary(4)
    for k in range(60):
        s.add(np.array([7, 100 + k], np.uint64), np.array([3, 1]))
        s.merge()
    assert s.lost > 0 and 7 in s.hashes and s.counts[list(s.hashes).index(7)] + s.lost >= 180


# ---- op12


def plain_levels(data):
    out = []
    for i in range(len(data) - rare_features.SPAN + 1):
        total = sum(int(rare_features.PART[c]) for c in Counter(data[i : i + rare_features.SPAN]).values())
        most = int(rare_features.PART[rare_features.SPAN])
        out.append(min((most - total) // (most // rare_features.LEVELS), rare_features.LEVELS))
    return out


def plain_features(data, place):
    """The byte strings of a text's features."""
    R = rare_features
    if not data:
        return []
    rank = [int(place[v]) for v in plain_levels(data)]
    if not rank:
        return [data]
    run = R.RUN if len(rank) >= R.SMALL else R.SHORT_RUN
    if len(rank) < run:
        return [data[(k := rank.index(min(rank))) : k + R.SPAN]]
    points = Counter()
    for s in range(len(rank) - run + 1):
        points[min(range(s, s + run), key=lambda i: (rank[i], i))] += 1
    return list(dict.fromkeys(data[k : k + R.SPAN] for k in sorted(points) if points[k] >= run // R.POPULAR))


def plain_edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ordered(rows):
    """(doc_id, text) by descending id, null last, equal ids as found."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def test_levels_and_features_equal_plain_ones(small):
    texts = [(r["text"] or "").encode() for r in small.collect()][:60] + [b"", b"a", b"abcdefgh" * 3, b"tick " * 90, "é".encode() * 40]
    counts = Counter(v for t in texts for v in plain_levels(t))
    place = rare_features.ranks(counts)
    joined = b"".join(texts)
    assert rare_features.levels(np.frombuffer(joined, np.uint8)).tolist() == plain_levels(joined)
    owner, h = rare_features._features(texts, place)
    back = {}
    for k, t in enumerate(texts):
        own, want = h[owner == k], plain_features(t, place)
        assert len(own) == len(want)
        for x, f in zip(own.tolist(), want):
            assert back.setdefault(x, f) == f  # one hash, one window
    assert len(set(back.values())) == len(back)


def test_likeness():
    place = rare_features.ranks({})
    rng = np.random.default_rng(1)
    a, b = (bytes(rng.integers(97, 123, 9000, dtype=np.uint8)) for _ in range(2))
    x, y, half = rare_features.chains([a, b, a[:4500] + b[:4500]], place)
    assert rare_features.likeness(x, x) == 1.0 and rare_features.likeness(x, y) < 0.05
    assert 0.35 < rare_features.likeness(x, half) < 0.7 and rare_features.likeness(half, x) == rare_features.likeness(x, half)
    none = rare_features.chains([b""], place)[0]
    assert rare_features.likeness(none, none) == 1.0 and rare_features.likeness(none, x) == 0.0
    assert (rare_features.decoded(rare_features.coded(x)) == x).all() and rare_features.coded(none) == ""


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_fingerprints_of_small_table(monkeypatch, spark, small, block):
    monkeypatch.setattr(rare_features, "BLOCK", block)
    rows = ordered([(r["doc_id"], r["text"] or "") for r in small.collect()])
    place = rare_features.ranks(Counter(v for _, t in rows for v in plain_levels(t.encode())))
    got = {r["doc_id"]: r for r in rare_features.fingerprints(small.repartition(5)).collect()}
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        new = plain_edited(t, nxt)
        own, other, far = (rare_features.chains([x.encode()], place)[0] for x in (t, new, nxt))
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (rare_features.coded(own), rare_features.coded(other))
        assert math.isclose(r["near_edited"], rare_features.likeness(own, other)) and math.isclose(r["near_next"], rare_features.likeness(own, far))
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.4 > 0.1 > np.mean([r["near_next"] for r in got.values()])


def test_fingerprints_of_odd_rows(spark, edge, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in edge.collect()]
    got = rare_features.fingerprints(edge).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    by_text = defaultdict(set)
    for r in got:
        by_text[r["n_chars"], r["doc_id"]].add(r["fingerprint"])
    assert all(len(x) == 1 for (n, d), x in by_text.items() if d is not None)
    line = ordered(rows)
    single = {d: k for k, (d, _) in enumerate(line) if [x for x, _ in line].count(d) == 1}
    for r in got:
        k = single.get(r["doc_id"])
        if k is not None and line[(k + 1) % len(line)][0] in single:
            assert r["edited_sha256"] == hashlib.sha256(plain_edited(line[k][1], line[(k + 1) % len(line)][1]).encode()).hexdigest()
    assert rare_features.fingerprints(empty).count() == 0
    one = rare_features.fingerprints(edge.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


# ---- ids of any type, repeated rows, and the pipeline as a whole


@pytest.mark.parametrize("kind", ["int", "string"])
def test_stages_take_ids_of_any_type(spark, kind):
    from pyspark.sql import functions as F

    from demandgrid.llm import exact_dedup, near_dedup, quality_classifier

    words = [f"w{i}" for i in range(60)]
    texts = {1: " ".join(words), 2: " ".join(words), 3: " ".join(words[:-1] + ["x"]), 4: "something else entirely"}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
    ids = lambda df: sorted(int(r["doc_id"]) for r in df.collect())
    assert ids(exact_dedup.deduplicate(docs)) == [2, 3, 4]
    assert ids(near_dedup.one_of_each(docs)) == [1, 4]
    labels = spark.createDataFrame([(k, int(k == 4)) for k in (1, 2, 3, 4)], "doc_id bigint, quality int")
    wide = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    assert ids(quality_classifier.accepted(docs, labels)) == ids(quality_classifier.accepted(wide, labels))


def test_repeated_labelled_rows_change_no_score(spark):
    from demandgrid.llm import quality_classifier

    good, bad = "A plain sentence of ordinary words stands here, number {}.", "$$$ ### buy buy buy buy ||| {} ***"
    rows = [(k, (good if k % 2 else bad).format(k)) for k in range(24)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id bigint, quality int")
    scores = []
    for times in (1, 500):
        many = rows + [r for r in rows if r[0] % 2 == 0 for _ in range(times - 1)]
        docs = spark.createDataFrame(many, "doc_id bigint, text string")
        scores.append({r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, labels, fit_rows=10).collect()})
    assert scores[0] == scores[1]


def test_language_sample_is_bounded_and_reads_long_texts(spark):
    from demandgrid.llm import language_id

    rows = [(1, "short words here", "en")] * 3000 + [(k, f"text number {k}", "en") for k in range(2, 90)] + [(500 + k, f"langer satz {k} " * 300, "de") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language_id.sample(docs, per_lang=20, fit_chars=200)
    counts = Counter(lang for _, lang in found)
    assert counts["en"] == 20 and 0 < counts["de"] <= 20
    assert all(len(t) <= 200 for t, _ in found) and len(set(found)) == len(found)


def test_pipeline_end_to_end(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.saved(stage(spark, docs, sf))
        if name != "pack":
            assert out.columns == docs.columns
        kept.append(out.count())
        docs = out
    assert kept[0] >= kept[1] >= kept[2] > 0
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, run.drop("sequence_id", "offset").collect())) == sorted(map(str, docs.drop("sequence_id", "offset").collect()))
