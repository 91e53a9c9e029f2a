"""Repeated passages by suffix automata of reference shards.

A window is ``span`` consecutive words.  A word goes when a window over it also
starts in a document with a smaller id.

1. Documents with one word sequence collapse to the smallest id; a later copy of
   ``span`` words or more goes entirely.
2. Anchors: of the ``GRAM``-word hashes inside a window the smallest is its anchor
   (about 2 of 26 words are anchors of some window).  Equal windows have equal
   anchors, so only windows whose anchor occurs in two documents can repeat; only
   anchors are shuffled for the whole corpus, not windows.
3. The windows that are left are hashed (96 bits) and counted; the smallest id of
   a repeated window owns it, at one place of its text.  The owners' runs of such
   windows are the reference: every repeated passage once, whatever the number of its
   copies.
4. The reference is cut into blocks of windows (an owner's text at every 64th of a
   shard's size; neighbours overlap by ``span - 1`` words), which are dealt to shards
   by hash, so neither a long owner nor a pattern in the ids fills one shard.  A
   window's shard follows from its owner's place, for the reference and for lookups
   alike.  A shard goes to the tasks that hold the documents with candidates in it, and to no other: shards that
   many documents need are copied to several tasks (``salt_words`` of documents
   each).  The reference grows with the corpus, so a broadcast of every shard to
   every task has no size bound; this is the same with the bound.
5. Each task builds the suffix automaton of its shard over the words themselves and
   streams the documents' runs through it.  The matching statistics (capped at
   ``span``) and the smallest owner below the state decide; hashes decide nothing.

Defined cases: null text has no words; fewer than ``span`` words: nothing goes; a
null doc_id neither loses nor takes words; rows repeated under one doc_id do not
take words from each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import WORDS, pruned, saved

SPAN = 50
GRAM = 26
SHARD_WORDS = 40_000
SALT_WORDS = 400_000
C = F.col
BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
EMPTY = np.empty(0, np.uint64)
KEY = ["doc_id", "_text"]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the next text."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 4096), np.uint64(base))
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[: n + 1]


def rolled(words: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of every ``width`` consecutive word hashes (a polynomial modulo 2**64, mixed)."""
    n = len(words)
    if n < width:
        return EMPTY
    up, down = _power(int(base), n), _power(pow(int(base), -1, 1 << 64), n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], dtype=np.uint64, out=sums[1:])
    x = (sums[width:] - sums[:-width]) * down[: n - width + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_anchors(words: np.ndarray, span: int, gram: int) -> np.ndarray:
    """The anchor hash of every window."""
    grams, width = rolled(words, gram, BASES[0]), span - gram + 1
    if len(grams) < width:
        return EMPTY
    return np.lib.stride_tricks.sliding_window_view(grams, width).min(1)


def _longs(lists: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([EMPTY, *lists]).view(np.int64)))


def _scan(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, anchors = [], [], []
            for text in batch.column(2):
                words = WORDS.findall(text.as_py() or "")
                n.append(len(words))
                digest.append(hashlib.sha256(" ".join(words).encode()).digest())
                anchors.append(np.unique(window_anchors(word_hashes(words), span, gram)) if len(words) >= span else EMPTY)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _longs(anchors)], [*KEY, "n_words", "sha", "anchors"])

    return run


def _windows(span: int, gram: int):
    """Windows of candidate documents whose anchor is shared, by 96 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, shared in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = word_hashes(WORDS.findall(text.as_py()))
                wanted = np.array(shared.as_py(), dtype=np.int64).view(np.uint64)
                at = np.flatnonzero(np.isin(window_anchors(words, span, gram), wanted))
                one, two = (rolled(words, span, b)[at] for b in BASES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), doc)), pa.array(at.astype(np.int32)), pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["doc", "at", "w1", "w2"])

    return run


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """First and last of every run of consecutive numbers."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    return list(zip(at[np.r_[0, cut]].tolist(), at[np.r_[cut - 1, len(at) - 1]].tolist()))


def shard_of(owner: np.ndarray, place: np.ndarray, block: int, shards: int) -> np.ndarray:
    """The shard of the windows that ``owner`` has at ``place``."""
    x = owner.astype(np.int64).view(np.uint64) * BASES[0] + (place // block).astype(np.uint64) * BASES[1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(shards)).astype(np.int64)


def _deal(span: int, block: int, shards: int):
    """Reference runs (kind 0) and the runs to look up (kind 1), each under its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, doc, text, *found in zip(*(c.to_pylist() for c in batch.columns)):
                words = WORDS.findall(text)
                at, owner, place = map(np.array, found)
                order = np.argsort(at)
                at, owner, place = at[order], owner[order], place[order]
                shard = shard_of(owner, place, block, shards)
                # a window that the document itself has again, at another place, is neither
                for kind, these in enumerate(((owner == doc) & (place == at), owner != doc)):
                    order = np.flatnonzero(these)[np.argsort(shard[these], kind="stable")]
                    ends = np.flatnonzero(np.diff(shard[order])) + 1
                    for part in np.split(order, ends) if len(order) else ():
                        for a, b in _runs(at[part]):
                            rows.append((int(shard[part[0]]), kind, rid, doc, a, " ".join(words[a : b + span]), b - a + span))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["shard", "kind", "rid", "doc_id", "start", "words", "n"])

    return run


class SuffixAutomaton:
    """Of several passages; every state knows the smallest owner of a passage it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _state(self, length: int, link: int, moves: dict, owner: int | None) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: str) -> int:
        """A state for the shorter of q's strings, those that p extends by the word."""
        clone = self._state(self.length[p] + 1, self.link[q], self.next[q].copy(), None)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[str], owner: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                self.owner[last] = owner if self.owner[last] is None else min(owner, self.owner[last])
                continue
            state, p = self._state(self.length[last] + 1, 0, {}, owner), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = state

    def finish(self) -> None:
        """Owners reach the states of their suffixes."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up, mine = self.link[s], self.owner[s]
            if up > 0 and mine is not None and (self.owner[up] is None or mine < self.owner[up]):
                self.owner[up] = mine

    def spans(self, words: list[str], doc: int, span: int) -> list[tuple[int, int]]:
        """(start, end) of the maximal runs covered by windows that an earlier document owns."""
        out: list[list[int]] = []
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while state and self.length[self.link[state]] >= span:
                state = self.link[state]
            matched = min(matched, span) if matched >= span else matched
            if matched >= span and self.owner[state] is not None and self.owner[state] < doc:
                if out and out[-1][1] >= i - span + 1:
                    out[-1][1] = i + 1
                else:
                    out.append([i - span + 1, i + 1])
        return [(a, b) for a, b in out]


def _match(span: int):
    """Per (shard, salt): the reference rows come first, then the runs to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, automaton, ready = None, SuffixAutomaton(), False
        for batch in batches:
            rows = []
            for shard, salt, kind, rid, doc, start, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, salt) != group:
                    group, automaton, ready = (shard, salt), SuffixAutomaton(), False
                if kind == 0:
                    automaton.add(words.split(" "), doc)
                    continue
                if not ready:
                    automaton.finish()
                    ready = True
                rows += [(rid, start + a, start + b) for a, b in automaton.spans(words.split(" "), doc, span)]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rid", "start", "end"])

    return run


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept = [], []
        for text, spans in zip(batch.column(2), batch.column(3).to_pylist()):
            words = np.array(WORDS.findall(text.as_py()), dtype=object)
            gone = np.zeros(len(words), bool)
            for s in spans:
                gone[s["start"] : s["end"]] = True
            removed.append(int(gone.sum()))
            kept.append(" ".join(words[~gone]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*KEY, "n_removed", "kept_text"])


def repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, shard_words: int = SHARD_WORDS, salt_words: int = SALT_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three stored tables: the scanned documents (doc_id, _text, n_words, sha, copy:
    a document with a smaller id has the same words), the candidates' texts (rid,
    doc_id, _text, text), and the spans (rid, start, end in words) that go from
    documents that are no copies."""
    gram = min(gram, span)
    rows = docs.select(C("doc_id").cast("bigint"), F.xxhash64(C("text").cast("string")).alias("_text"), C("text").cast("string"))
    scanned = saved(rows.mapInArrow(_scan(span, gram), "doc_id bigint, _text bigint, n_words bigint, sha binary, anchors array<bigint>"))
    many = saved(scanned.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    base = saved(scanned.drop("anchors").join(many, "sha", "left").withColumn("copy", F.coalesce(C("doc_id") > C("first"), F.lit(False))).drop("first"))
    # an anchor counts when two different texts have it; copies of one text are of one digest
    anchors = scanned.where(C("doc_id").isNotNull()).select(*KEY, F.xxhash64("sha").alias("_sha"), F.explode("anchors").alias("h"))
    shared = saved(anchors.groupBy("h").agg(F.min("_sha").alias("a"), F.max("_sha").alias("b")).where("a < b").select("h"))
    wanted = anchors.join(shared, "h").groupBy(*KEY).agg(F.collect_set("h").alias("anchors"))
    wanted = saved(wanted.join(base.where("copy").select(*KEY), KEY, "left_anti"))
    texts = saved(pruned(rows, wanted).join(wanted, KEY).dropDuplicates(KEY).select(F.monotonically_increasing_id().alias("rid"), *KEY, "text", "anchors"))
    # rid is a fact once written: one short number per text from here on
    columns = ("text", "anchors")
    counted = texts.select("doc_id", *columns).mapInArrow(_windows(span, gram), "doc bigint, at int, w1 bigint, w2 int")
    # of an owner's several places any one will do; once written it is a fact
    owned = saved(counted.groupBy("w1", "w2").agg(F.min("doc").alias("owner"), F.min_by("at", "doc").alias("place"), F.max("doc").alias("_b")).where("owner < _b").drop("_b"))
    windows = texts.select("rid", *columns).mapInArrow(_windows(span, gram), "doc bigint, at int, w1 bigint, w2 int").withColumnRenamed("doc", "rid")
    found = windows.join(owned, ["w1", "w2"]).groupBy("rid").agg(F.collect_list("at").alias("at"), F.collect_list("owner").alias("owner"), F.collect_list("place").alias("place"))
    block = max(span, shard_words // 64)
    shards = max(1, -(-owned.count() // shard_words))
    dealt = texts.select("rid", "doc_id", "text").join(found, "rid").mapInArrow(_deal(span, block, shards), "shard bigint, kind int, rid bigint, doc_id bigint, start bigint, words string, n bigint")
    dealt = saved(dealt)
    salts = saved(dealt.where("kind = 1").groupBy("shard").agg(F.ceil(F.sum("n") / salt_words).alias("_salts")))
    salted = dealt.join(salts, "shard").withColumn("_mine", F.pmod(F.xxhash64("rid", "start"), C("_salts")))
    salt = F.explode(F.when(C("kind") == 0, F.sequence(F.lit(0).cast("bigint"), C("_salts") - 1)).otherwise(F.array("_mine"))).alias("salt")
    placed = salted.select("shard", salt, "kind", "rid", "doc_id", "start", "words").repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    spans = saved(placed.mapInArrow(_match(span), "rid bigint, start bigint, end bigint"))
    return base, texts.drop("anchors"), spans


def strip_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, shard_words: int = SHARD_WORDS, salt_words: int = SALT_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (the kept words joined by one
    space; null where nothing went, the document then stays as it is)."""
    base, texts, spans = repeats(docs, span, gram, shard_words, salt_words)
    per = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = saved(texts.join(per, "rid").select(*KEY, "text", "spans").mapInArrow(_strip, "doc_id bigint, _text bigint, n_removed bigint, kept_text string"))
    gone = C("copy") & (C("n_words") >= span)
    kept = F.when(gone, F.lit("")).otherwise(C("kept_text"))
    return base.join(cut, KEY, "left").select(
        "doc_id", "n_words", F.when(gone, C("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(kept.isNull(), F.lower(F.hex("sha"))).otherwise(F.sha2(kept, 256)).alias("kept_sha256"), kept.alias("kept_text"))
