"""Packing documents into token sequences by minimum bin slack.

1. Documents are tokenized where they lie; a document longer than a sequence is
   cut into full pieces and a rest.  White space ends a token and words repeat,
   so a bounded cache per worker maps words to their ids (the tokenizer's result
   for a text is the concatenation of its results for the words).
2. Piece lengths are counted: at most ``max_len`` distinct numbers, whatever the
   corpus, so the counts go to the driver.
3. Minimum bin slack on the counts: a bin takes the longest piece left; a bitset
   of reachable sums over the lengths left (a shift per binary share of each
   length's count) finds the fullest feasible rest.  The combination is removed
   as often as the counts allow, which uses up one of its lengths below its
   multiplicity.  Hence the number of combinations is below the sum of
   max_len / l over all l (16,000 for 2,048), whatever the number of pieces.
4. Pieces are ranked by (length, doc_id, piece) over range partitions; the rank
   alone tells the combination, the repetition and the place, by binary search in
   the (bounded) table of rank intervals that every task gets.

Defined cases: null text is empty and has the end id alone; equal rows are packed
each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import saved
from demandgrid.operators.ranks import global_rank

MAX_LEN = 2048
CACHED_WORDS = 300_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Texts of ASCII and Latin-1 letters: NFC leaves them alone and they lower-case one to one.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
#: What the pre-tokenizer makes of such a text in lower case; the tokenizer treats each by itself.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
RUN = re.compile(r"[a-zß-öø-ÿ]+")
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The parts of a plain text are looked up in a bounded cache.  New runs of letters
    are encoded together, a line of them at once, and told apart by the mark that ends
    a word; other new parts and texts that are not plain are encoded by themselves."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.parts = _tokenizer(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for t, n in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _learn(self, new: set[str], line: int = 500) -> None:
        runs = [p for p in new if RUN.fullmatch(p)]
        rest = list(new.difference(runs))
        for p, ids in zip(rest, self._encode(rest)):
            self.parts[p] = ids.tobytes()
        lines = [runs[k : k + line] for k in range(0, len(runs), line)]
        for words, ids in zip(lines, self._encode([" ".join(x) for x in lines])):
            ends, raw = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
            if len(ends) != len(words):
                raise ValueError("the vocabulary does not mark word ends")
            start = 0
            for w, end in zip(words, ends):
                self.parts[w] = raw[start:end]
                start = end

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        split = [PARTS.findall(t.lower()) if PLAIN.fullmatch(t) and not SPECIAL.search(t) else None for t in texts]
        if len(self.parts) > CACHED_WORDS:
            self.parts = {}
        known, new = self.parts, set()
        for parts in split:
            new.update(filterfalse(known.__contains__, parts or ()))
        if new:
            self._learn(new)
        for text, parts in zip(texts, split):
            yield self._encode([text])[0].tobytes() if parts is None else b"".join(map(known.__getitem__, parts))


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    """One cache a worker process, kept from task to task."""
    return WordIds(path)


def _cut(path: str, max_len: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, last = _word_ids(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows, texts = [], [t or "" for t in batch["text"]]
            ids_of_all = (x for k in range(0, len(texts), 256) for x in ids_of(texts[k : k + 256]))
            for doc_id, ids in zip(batch["doc_id"], ids_of_all):
                ids += last
                for k in range(0, len(ids), 4 * max_len):
                    piece = ids[k : k + 4 * max_len]
                    rows.append((doc_id, k // (4 * max_len), k // 4, len(piece) // 4, zlib.crc32(piece), *([piece] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]).astype({"doc_id": "Int64"})

    return run


def pieces(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids as little-endian bytes)."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInPandas(_cut(tokenizer_path, max_len, end_id, with_ids), schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats, within ``counts``) whose sum is the largest not above ``room``."""
    if counts.get(room):
        return [room]
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # reachable sums before the step, length, pieces of it taken together
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, share = min(counts[length], room // length), 1
        while left:
            share = min(share, left)
            steps.append((reach, length, share))
            reach |= (reach << (share * length)) & mask
            left, share = left - share, 2 * share
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for before, length, share in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * share
            total -= share * length
    return chosen


def combinations(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[list[int], int]]:
    """(lengths of one bin, how many such bins), emptying ``counts``."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = [longest, *fullest(left, max_len - longest)]
        left[longest] += 1
        need = {x: chosen.count(x) for x in chosen}
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((chosen, times))
    return out


def places(counts: dict[int, int], max_len: int = MAX_LEN) -> np.ndarray:
    """Rank intervals, a row each: first rank, pieces of the length in a bin, first sequence, offset in the bin, length.

    Ranks count from 0 over all pieces ordered by length."""
    first, at = 0, {}
    for length in sorted(counts):
        at[length] = first
        first += counts[length]
    rows, sequence = [], 0
    for chosen, times in combinations(counts, max_len):
        offset = 0
        for length in dict.fromkeys(chosen):
            n = chosen.count(length)
            rows.append((at[length], n, sequence, offset, length))
            at[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _place(table: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch["_rank"].to_numpy() - 1
            row = table[np.searchsorted(table[:, 0], rank, side="right") - 1]
            nth = rank - row[:, 0]
            yield batch.drop(columns="_rank").assign(sequence_id=row[:, 2] + nth // row[:, 1], offset=row[:, 3] + nth % row[:, 1] * row[:, 4])

    return run


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    cut = saved(pieces(docs, tokenizer_path, max_len, end_id, with_ids))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_len rows at most
    ranked = global_rank(cut, [F.col("length"), F.col("doc_id"), F.col("piece")], "_rank")
    schema = cut.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"
    return ranked.select(*cut.columns, "_rank").mapInPandas(_place(places(counts, max_len)), schema.replace(":", " "))
