"""Personal data: fixed forms plus bootstrapped contextual extraction.

1. One scan finds the base spans (e-mail, IP, card, phone) of every whole text, and
   beside them loose candidates: a run of neighbouring words with digits, or a single
   word with digits or an @, that looks like an identifier of a kind but matches no
   base form.  Of each, the lexical patterns around it are kept: the two words to the
   left, and the word to the left with the word to the right.
2. Base spans are the seed instances of the bipartite graph of (pattern, instance)
   pairs, copies collapsed.  A second scan counts what speaks against a pattern:
   ordinary words in its slot.  A table of fixed size tells the scan which patterns
   have instances enough to matter, and how many distinct words decide against each
   for good: a pattern that a task has seen with more is out whatever the rounds say,
   so the task need not go on with it.  The join that follows is exact.
3. The graph is scored in rounds of Spark aggregations.  Candidates are unknown, not
   wrong: a pattern's trust is (sure instances + ``prior`` x background) / (sure
   instances + contrary instances + ``prior``), where contrary ones are seeds of other
   kinds and distinct ordinary words, and the background is the share of seeds among
   all instances of the kind.  A pattern needs ``min_seeds`` sure instances, no fewer
   sure than unknown ones, and ``confident`` trust.  An instance's confidence is one
   minus the product of the doubts of its trusted patterns.
4. Candidates that reach ``accept`` are sure in the next round and, after the last
   one, unseen identifiers; all their occurrences are added.  Base spans always stay.

The graph's rounds join stored tables on both sides, so AQE can split a pattern
that a third of all instances share; partial aggregation comes before every
shuffle, and no node's neighbours are ever gathered.

Offsets count code points, ends are exclusive.  Defined cases: null text is empty
and has no spans; an empty table gives no rows; rows repeated under one doc_id and
text get the same spans each; a context word of more than ``LONGEST`` characters says
nothing (as if empty), so very long words cost no more than their length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import WORDS, lean, saved

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SEEDS = 5
#: five sure instances and nothing contrary give at least 5 / 7; two such patterns give 0.918
CONFIDENT = 0.7
ACCEPT = 0.9
PRIOR = 2.0
#: slots of the table that tells the second scan which patterns to look for, and how many
#: (pattern, word) pairs a task holds before it passes them on
PLACES = 1 << 18
HELD = 500_000
LONGEST = 32
#: characters of a candidate other than an e-mail address
SLOT = 40
C = F.col
# the contract's forms; (?<![0-9]) and ++ only spare retries inside one run of digits, which fail alike
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
DIGIT = re.compile(r"[0-9]")
# whole words with a digit or an @, in one pass over the text
MARKED = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
ALNUM = re.compile(r"[^\W_]")
TRIM = "\"'()[]{}<>,;:!?.|*$%&#="
OCCURRENCE = "array<struct<kind:int,start:int,end:int,value:bigint,seed:boolean,patterns:array<bigint>>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: a match is decided at its @, as the part before holds none."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in the contract's order."""
    out = [(0, *x) for x in emails(text)]
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def likely_kind(words: str) -> int | None:
    """The kind that a slot outside all base spans would be of, by its looks."""
    if "@" in words:
        return 0 if "@" in words.strip("@") and " " not in words else None
    digits = len(DIGIT.findall(words))
    if len(words) > SLOT or digits < 7 or 2 * digits < len(ALNUM.findall(words)):
        return None
    if words.count(".") >= 3 and " " not in words:
        return 1
    return 2 if digits >= 12 else 3


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without punctuation at both ends; the bracket stays that opens one closed inside."""
    first = start
    while start < end and text[start] in TRIM:
        start += 1
    while end > start and text[end - 1] in TRIM:
        end -= 1
    if start > first and text[start - 1] == "(" and ")" in text[start:end]:
        start -= 1
    return start, end


def slots(text: str, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of words with digits, one space apart, and the single marked words;
    words that a base span touches belong to none."""
    out, run, at = [], [], 0
    for m in MARKED.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        free = at == len(covered) or covered[at][0] >= end
        joins = run and free and start - run[-1][1] == 1 and text[start - 1] == " " and "@" not in m[0] and "@" not in text[slice(*run[-1])]
        if run and not joins:
            out += run + [(run[0][0], run[-1][1])] * (len(run) > 1)
            run = []
        if free:
            run.append((start, end))
    return out + run + ([(run[0][0], run[-1][1])] if len(run) > 1 else [])


def _signed(x: str) -> int:
    h = xxhash.xxh64_intdigest(x)
    return h - (1 << 64) if h >= 1 << 63 else h


def word_key(word: str) -> int:
    """Hash of a context word without case, digits and outer punctuation; 0: nothing is left."""
    plain = DIGIT.sub("0", word.strip(TRIM).lower()) if len(word) <= LONGEST else ""
    return xxhash.xxh64_intdigest(plain) if plain else 0


def pattern_keys(side: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of patterns: side 0 (two words to the left) or 1 (one on each side)."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(side)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _around(text: str, starts: list[int], ends: list[int], start: int, end: int) -> list[int | None]:
    """Keys of the two words to the left and of the one to the right (None: there is none)."""
    left, right = bisect_left(starts, start) - 1, bisect_right(ends, end)
    pieces = [(starts[i], min(ends[i], start)) if i >= 0 else None for i in (left - 1, left)]
    pieces.append((max(starts[right], end), ends[right]) if right < len(starts) else None)
    return [None if p is None else 0 if p[1] - p[0] > LONGEST else word_key(text[slice(*p)]) for p in pieces]


def occurrences(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """Seeds and candidates with the patterns around them."""
    found = [(k, s, e, True) for k, s, e in spans]
    if DIGIT.search(text) or "@" in text:
        for place in slots(text, sorted((s, e) for _, s, e in spans)):
            start, end = _trimmed(text, *place)
            kind = likely_kind(text[start:end])
            if kind is not None:
                found.append((kind, start, end, False))
    if not found:
        return []
    starts, ends = map(list, zip(*(m.span() for m in WORDS.finditer(text))))
    out = []
    for kind, start, end, seed in found:
        two, one, right = _around(text, starts, ends, start, end)
        pairs = [(side, a, b) for side, a, b in ((0, two, one), (1, one, right)) if a is not None and b is not None and (a or b)]
        patterns = [int(pattern_keys(side, np.array([a], np.uint64), np.array([b], np.uint64)).view(np.int64)[0]) for side, a, b in pairs]
        out.append((kind, start, end, _signed(f"{kind} {text[start:end].lower()}"), seed, patterns))
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("kind", "start", "end", "value", "seed", "patterns")
    for batch in batches:
        rows = []
        for text in batch["text"]:
            text = text or ""
            spans = base_spans(text)
            kinds = [k for k, _, _ in spans]
            joined = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
            rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest(), [{"kind": k, "start": s, "end": e} for k, s, e in spans],
                         [dict(zip(names, o)) for o in occurrences(text, spans)]))
        out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "occurrences"])
        out.insert(0, "doc_id", batch["doc_id"].array)
        out.insert(1, "_text", batch["_text"].array)
        yield out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, _text (hash of the text), the base counts and spans, and the occurrences."""
    rows = docs.select(C("doc_id").cast("bigint"), F.xxhash64(C("text").cast("string")).alias("_text"), C("text").cast("string"))
    return rows.mapInPandas(_scan, "doc_id bigint, _text bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
                                   f"base array<struct<kind:int,start:int,end:int>>, occurrences {OCCURRENCE}")


def _plain_slots(levels: np.ndarray):
    """(pattern, word) of the ordinary words (no digit, no @) in slots of the patterns that the
    table holds, until 2**level distinct ones are known of a pattern."""

    def passed_on(seen: dict[int, set[int]]) -> pa.RecordBatch:
        patterns = np.repeat(np.fromiter(seen, np.int64, len(seen)), np.fromiter(map(len, seen.values()), np.int64, len(seen)))
        words = np.fromiter((w for of in seen.values() for w in of), np.int64, len(patterns))
        return pa.RecordBatch.from_arrays([pa.array(patterns), pa.array(words)], ["pattern", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        mask = np.uint64(len(levels) - 1)
        seen: dict[int, set[int]] = {}
        held = 0
        for batch in batches:
            patterns, fillers = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for text in batch.column(0):
                words = WORDS.findall(text.as_py() or "")
                if len(cache) > 200_000:
                    cache.clear()
                for w in words:
                    if w not in cache and len(w) <= LONGEST:
                        cache[w] = word_key(w)
                key = np.fromiter((cache.get(w, 0) for w in words), np.uint64, len(words))
                plain = np.fromiter((DIGIT.search(w) is None and "@" not in w for w in words), bool, len(words))
                for side, first, second, fill in ((0, key[:-2], key[1:-1], slice(2, None)), (1, key[:-2], key[2:], slice(1, -1))):
                    if len(words) > 2:
                        p = pattern_keys(side, first, second)
                        hit = plain[fill] & ((first | second) != 0) & (levels[(p & mask).astype(np.int64)] > 0)
                        patterns.append(p[hit])
                        fillers.append(key[fill][hit])
            pairs = np.unique(np.stack([np.concatenate(patterns), np.concatenate(fillers)], 1), axis=0).view(np.int64)
            for pattern, word in pairs.tolist():
                of = seen.setdefault(pattern, set())
                if len(of) < 1 << int(levels[pattern & int(mask)]) and word not in of:
                    of.add(word)
                    held += 1
            if held > HELD:
                yield passed_on(seen)
                seen, held = {}, 0
        yield passed_on(seen)

    return run


def against(docs: DataFrame, edges: DataFrame, min_seeds: int, confident: float, prior: float) -> DataFrame:
    """(pattern, kind, contrary): of the patterns with instances enough to be trusted, how many
    seeds of other kinds and how many distinct ordinary words they name (no fewer than
    rule the pattern out, where there are more than that)."""
    enough = saved(edges.groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.count_if("seed").alias("mine")).where(C("n") >= min_seeds))
    # were all its instances sure, this many contrary ones would still be too many
    decides = (C("n") + prior) * (1.01 * (1 - confident) / confident) + 3
    table = enough.groupBy(C("pattern").bitwiseAND(PLACES - 1).alias("at")).agg(F.max(F.ceil(F.log2(decides))).cast("int").alias("level"))
    levels = np.zeros(PLACES, np.int8)
    for row in table.collect():  # PLACES rows at most
        levels[row["at"]] = row["level"]
    wanted = enough.select("pattern").distinct()
    plain = saved(docs.select(C("text").cast("string")).mapInArrow(lean(_plain_slots(levels)), "pattern bigint, word bigint").distinct().join(wanted, "pattern").groupBy("pattern").agg(F.count("*").alias("plain")))
    seeds = edges.where("seed").join(wanted, "pattern").groupBy("pattern").agg(F.count("*").alias("seeds"))
    both = enough.join(plain, "pattern", "left").join(seeds, "pattern", "left")
    none = F.lit(0)
    return both.select("pattern", "kind", (F.coalesce("plain", none) + F.coalesce("seeds", none) - C("mine")).alias("contrary"))


def unseen(docs: DataFrame, occ: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT, accept: float = ACCEPT, prior: float = PRIOR) -> DataFrame:
    """(value) of the candidates that the graph's patterns make sure enough."""
    edges = saved(occ.select("kind", "value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed")))
    contrary = against(docs, edges, min_seeds, confident, prior)
    values = edges.groupBy("kind", "value").agg(F.max("seed").alias("seed"))
    background = values.groupBy("kind").agg((F.count_if("seed") / (F.count("*") + 1)).alias("background"))
    names = saved(contrary.join(background, "kind"))
    known = saved(values.select("value", "seed", C("seed").cast("double").alias("sure")))
    for _ in range(rounds):
        per = edges.drop("seed").join(known, "value").groupBy("pattern", "kind").agg(F.count_if(C("sure") >= accept).alias("n"), F.count("*").alias("all"))
        trust = F.least(F.round((C("n") + prior * C("background")) / (C("n") + C("contrary") + prior), 9), F.lit(0.999999))
        trusted = saved(per.join(names, ["pattern", "kind"]).select("pattern", "kind", "n", "all", trust.alias("trust")).where(
            (C("n") >= min_seeds) & (2 * C("n") >= C("all")) & (C("trust") >= confident)))
        found = edges.join(trusted, ["pattern", "kind"]).groupBy("value").agg(F.round(1.0 - F.exp(F.sum(F.log1p(-C("trust")))), 9).alias("found"))
        known = saved(known.drop("sure").join(found, "value", "left").select("value", "seed", F.when(C("seed"), F.lit(1.0)).otherwise(F.coalesce("found", F.lit(0.0))).alias("sure")))
    return known.where((C("sure") >= accept) & ~C("seed")).select("value")


def find(docs: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT, accept: float = ACCEPT, prior: float = PRIOR) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    base = saved(scan(docs))
    occ = base.select("doc_id", "_text", F.inline("occurrences"))
    new = saved(unseen(docs, occ, rounds, min_seeds, confident, accept, prior))
    added = occ.where(~C("seed")).join(new, "value").groupBy("doc_id", "_text").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    added = saved(added).withColumnsRenamed({"doc_id": "_id", "_text": "_hash"})
    both = base.join(added, C("doc_id").eqNullSafe(C("_id")) & (C("_text") == C("_hash")), "left")
    every = F.sort_array(F.when(C("added").isNull(), C("base")).otherwise(F.array_union("base", "added")))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    return both.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))
