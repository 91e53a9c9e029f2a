"""Language identification by a linear-chain conditional random field.

Every word of a text is a position (a word of more than ``LONG`` characters is several),
every language a label.  A word's emission is
the sum of hashed weights of its affixes (1 to 3 letters), letter trigrams and, if
it is frequent enough in the sample, of the word itself (the lexicon); learned
transitions say how likely a text stays in a language or switches.  The weights
are trained by stochastic gradients on chains that string passages of documents
in different languages together, so switches occur in training.

Prediction runs forward-backward over each whole text and averages the words'
marginals, weighted by their letters; the language with the largest share wins and
its share is the score.  Long texts are not cut: a text is laid out in blocks, the
blocks' transfer matrices are multiplied for all blocks at once, block ends are
chained, and the marginals inside all blocks follow, which equals the sequential
recursion.

The sample is bounded: ``per_lang`` whole documents per language (first in md5
order of the id, held-out fold excluded); repeated rows count once, and of texts over
``fit_chars`` characters, taken last, a passage of that length is learnt from.
The model is a fixed 2**18 x languages table, shipped to every task.

Defined cases: `und` with score 0 if the text is null or has no letter, or if
nothing could be learnt; ties go to the language first in code point order; rows
repeated under one doc_id are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demandgrid.llm.common import WORDS, crc_mod, saved

PER_LANG = 250
FIT_CHARS = 20_000
BUCKETS = 1 << 18
BLOCK = 32
LONG = 64
LETTER = re.compile(r"[^\W\d_]")
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
CACHED_WORDS = 400_000
C = F.col


def positions(text: str) -> list[str]:
    """The words of a text; one of more than ``LONG`` characters (an unspaced script) in runs
    of that length, which overlap by two so that no trigram is lost."""
    words = WORDS.findall(text)
    if not words or max(map(len, words)) <= LONG:
        return words
    return [w[k : k + LONG] for w in words for k in range(0, max(1, len(w) - 2), LONG - 2)]


def features(word: str, lexicon: set[str]) -> list[int]:
    """Hashed features of a word; empty if it has no letter."""
    w = EDGES.sub("", word).lower()
    if not w:
        return []
    names = ["<" + w[:k] for k in (1, 2, 3)] + [">" + w[-k:] for k in (1, 2, 3)]
    names += [w[k : k + 3] for k in range(len(w) - 2)]
    if w in lexicon:
        names.append("=" + w)
    return [zlib.crc32(x.encode()) & BUCKETS - 1 for x in names]


class Chain:
    """Weights of the field and its recursions."""

    def __init__(self, langs: list[str], weights: np.ndarray, moves: np.ndarray, lexicon: set[str]) -> None:
        self.langs, self.weights, self.moves, self.lexicon = langs, weights, moves, lexicon

    def marginals(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label probabilities of every word; texts lie one after another in ``emission``.

        A virtual uniform label precedes the first word."""
        n, k = emission.shape
        p = np.exp(emission - emission.max(1, keepdims=True))
        step = np.exp(self.moves - self.moves.max()).astype(p.dtype)
        lengths = lengths[lengths > 0]
        if not n:
            return p
        blocks = -(-lengths // BLOCK)
        total, first = int(blocks.sum()), np.concatenate([[0], np.cumsum(blocks)[:-1]])
        # place of each word: its block and the position in it
        within = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        block, at = np.repeat(first, lengths) + within // BLOCK, within % BLOCK
        probs, real = np.ones((total, BLOCK, k), p.dtype), np.zeros((total, BLOCK), bool)
        probs[block, at], real[block, at] = p, True

        def scaled(x: np.ndarray, axes) -> np.ndarray:
            return x / x.max(axes, keepdims=True)

        transfer = np.broadcast_to(np.eye(k, dtype=p.dtype), (total, k, k)).copy()
        for t in range(BLOCK):
            moved = scaled((transfer.reshape(-1, k) @ step).reshape(total, k, k) * probs[:, t, None, :], (1, 2))
            transfer = np.where(real[:, t, None, None], moved, transfer)
        # chain the block ends; texts advance together, the longer ones last longest
        start, end = np.ones((total, k), p.dtype), np.ones((total, k), p.dtype)
        for b in range(1, int(blocks.max())):
            on = first[blocks > b] + b
            start[on] = scaled(np.einsum("ij,ijk->ik", start[on - 1], transfer[on - 1]), 1)
        for b in range(int(blocks.max()) - 2, -1, -1):
            on = first[blocks > b + 1] + b
            end[on] = scaled(np.einsum("ijk,ik->ij", transfer[on + 1], end[on + 1]), 1)
        forward = np.empty_like(probs)
        for t in range(BLOCK):
            moved = scaled((start @ step) * probs[:, t], 1)
            start = np.where(real[:, t, None], moved, start)
            forward[:, t] = start
        for t in range(BLOCK - 1, -1, -1):
            forward[:, t] *= end
            moved = scaled((probs[:, t] * end) @ step.T, 1)
            end = np.where(real[:, t, None], moved, end)
        out = forward[block, at]
        return out / out.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 4, chain: int = 64, passage: int = 16, batch: int = 64, rate: float = 0.3, seed: int = 11) -> Chain | None:
    """Fit on a bounded sample held in memory; None if there is no language."""
    langs = sorted(set(labels))
    if not langs:
        return None
    docs = [positions(t) for t in texts]
    seen = Counter(EDGES.sub("", w).lower() for d in docs for w in d)
    lexicon = {w for w, n in seen.items() if n >= 5 and w}
    k, rng = len(langs), np.random.default_rng(seed)
    known: dict[str, list[int]] = {}
    passages = []  # (label, words' features)
    for words, lang in zip(docs, labels):
        f = [known.setdefault(w, features(w, lexicon)) for w in words]
        f = [x for x in f if x]
        passages += [(langs.index(lang), f[i : i + passage]) for i in range(0, len(f) - passage + 1, passage)] or ([(langs.index(lang), (f * passage)[:passage])] if f else [])
    if not passages:
        return None
    weights, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    seen_w, seen_m = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    per = chain // passage
    for _ in range(epochs):
        order = rng.permutation(len(passages))
        # half of the neighbours are of one language, so staying is learnt as well as switching
        order = np.concatenate([sorted(part, key=lambda i: passages[i][0]) if rng.random() < 0.5 else part for part in np.array_split(order, max(1, len(order) // (4 * per)))])
        chains = [order[i : i + per] for i in range(0, len(order) - per + 1, per)] or [np.resize(order, per)]
        for i in range(0, len(chains), batch):
            part = chains[i : i + batch]
            rows = [f for c in part for j in c for f in passages[j][1]]
            gold = np.array([passages[j][0] for c in part for j in c for _ in range(passage)]).reshape(len(part), -1)
            sizes = np.array([len(f) for f in rows])
            flat = np.concatenate([np.asarray(f) for f in rows])
            emission = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0).reshape(len(part), -1, k)
            g_emit, g_move = _gradient(emission, moves, gold)
            grads = np.repeat(g_emit.reshape(-1, k), sizes, axis=0)
            hit, where = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(where, grads[:, y], len(hit)) for y in range(k)], 1)
            g -= 1e-4 * weights[hit]
            seen_w[hit] += g * g
            weights[hit] += rate * g / np.sqrt(seen_w[hit])
            g_move -= 1e-3 * moves
            seen_m += g_move * g_move
            moves += rate * g_move / np.sqrt(seen_m)
    return Chain(langs, weights.astype(np.float32), moves, lexicon)


def _gradient(emission: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of ``gold`` in equally long chains, by forward-backward."""
    n, t, k = emission.shape
    p, step = np.exp(emission - emission.max(2, keepdims=True)), np.exp(moves)
    fore, back = np.empty((n, t, k)), np.ones((n, t, k))
    before = np.full((n, k), 1.0 / k)
    for i in range(t):
        a = (before @ step) * p[:, i]
        fore[:, i] = before = a / a.sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        b = (p[:, i + 1] * back[:, i + 1]) @ step.T
        back[:, i] = b / b.sum(1, keepdims=True)
    gamma = fore * back
    gamma /= gamma.sum(2, keepdims=True)
    pair = fore[:, :-1, :, None] * step * (p * back)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    g_emit = -gamma
    np.add.at(g_emit, (np.arange(n)[:, None], np.arange(t)[None, :], gold), 1.0)
    g_move = -pair.sum((0, 1))
    np.add.at(g_move, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1.0)
    return g_emit, g_move


class Reader:
    """Emissions of words through a bounded cache."""

    def __init__(self, chain: Chain) -> None:
        self.chain = chain
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.empty((1024, len(self.chain.langs) + 1), np.float32)  # emission, letters

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHED_WORDS:
            self.clear()
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        while len(known) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        if new:
            found = [features(w, self.chain.lexicon) or [-1] for w in new]
            sizes = np.array([len(f) for f in found])
            flat = np.fromiter((x for f in found for x in f), np.int64, sizes.sum())
            sums = np.add.reduceat(self.chain.weights[flat], np.cumsum(sizes) - sizes, axis=0)
            bare = flat[np.cumsum(sizes) - sizes] < 0  # words without a letter say nothing
            sums[bare] = 0.0
            at = len(known)
            self.rows[at : at + len(new), :-1] = sums
            self.rows[at : at + len(new), -1] = np.where(bare, 0, [len(w) for w in new])
            known.update(zip(new, range(at, at + len(new))))
        return self.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]


def predict(texts: list[str | None], reader: Reader, words_at_once: int = 60_000) -> tuple[list[str], list[float]]:
    """Language and score of each whole text."""
    langs, out_lang, out_score = reader.chain.langs, [], []
    part: list[list[str]] = []

    def flush() -> None:
        if not part:
            return
        rows = reader([w for words in part for w in words])
        lengths = np.array([len(w) for w in part])
        gamma = reader.chain.marginals(rows[:, :-1], lengths) * rows[:, -1:]
        ends = np.cumsum(lengths)
        sums = np.concatenate([np.zeros((1, len(langs))), np.cumsum(gamma, 0, dtype=np.float64)])
        share = sums[ends] - sums[ends - lengths]
        for s in share:
            total = s.sum()
            best = int(s.argmax())
            out_lang.append(langs[best] if total > 0 else "und")
            out_score.append(float(min(1.0, s[best] / total)) if total > 0 else 0.0)
        part.clear()

    size = 0
    for text in texts:
        words = positions(text) if text and LETTER.search(text) else []
        if size and size + len(words) > words_at_once:
            flush()
            size = 0
        part.append(words)
        size += len(words)
    flush()
    return out_lang, out_score


def sample(docs: DataFrame, per_lang: int = PER_LANG, fit_chars: int = FIT_CHARS) -> list[tuple[str, str]]:
    """(text, lang) of at most ``per_lang`` documents a language outside the held-out fold.

    Repeated rows count once.  Texts of up to ``fit_chars`` characters come first; of a
    longer one a passage of that length is taken, at a place that its hash decides."""
    open_ = docs.where(C("lang").isNotNull() & C("text").isNotNull() & (crc_mod(C("doc_id"), 3) != 1)).withColumns(
        {"_hash": F.xxhash64("text"), "_more": F.greatest(F.length("text") - fit_chars, F.lit(0))})
    order = [C("_more") > 0, F.md5(C("doc_id").cast("string").cast("binary")), C("doc_id"), C("_hash")]
    # no texts; the group limit keeps per_lang rows a language before the shuffle
    ids = open_.select("doc_id", "lang", "_hash", "_more").distinct().withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(C("_n") <= per_lang)
    named = F.broadcast(ids.select(C("doc_id").alias("_id"), C("lang").alias("_lang"), C("_hash").alias("_wanted")))
    picked = open_.join(named, (C("doc_id") == C("_id")) & (C("lang") == C("_lang")) & (C("_hash") == C("_wanted")))
    passage = F.substring("text", F.pmod(C("_hash"), C("_more") + 1).cast("int") + 1, F.lit(fit_chars))
    rows = picked.select("doc_id", "lang", "_hash", passage.alias("text")).dropDuplicates(["doc_id", "lang", "_hash"])
    return sorted((r["text"], r["lang"]) for r in rows.collect())


def identify(docs: DataFrame, per_lang: int = PER_LANG, fit_chars: int = FIT_CHARS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    rows = docs.select(C("doc_id").cast("bigint"), C("text").cast("string"), C("lang").cast("string"))
    found = sample(rows, per_lang, fit_chars)
    chain = train([t for t, _ in found], [x for _, x in found])
    shipped = docs.sparkSession.sparkContext.broadcast(chain)  # BUCKETS x languages, whatever the corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shipped.value) if shipped.value else None
        for batch in batches:
            texts = batch["text"].tolist()
            langs, scores = predict(texts, reader) if reader else (["und"] * len(texts), [0.0] * len(texts))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": langs, "score": scores})

    held = F.coalesce(crc_mod(C("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return rows.select("doc_id", held, "text").mapInPandas(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
