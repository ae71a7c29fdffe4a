"""Language identification by a linear-chain conditional random field.

Every word of a text gets a distribution over languages, so code-switched texts are told apart word by word. Word
scores come from hashed features (the word, prefixes and suffixes of 1 to 3 letters, letter bigrams and trigrams) and
from lexicon features (smoothed log odds of the word in each language of the sample); transitions between the languages
of neighbouring words are learned with them. Marginals are found by forward-backward. A text's language is the one
that its words are expected to be in most often; its score is that share.

Learning: at most ``ROWS`` texts of each language, chosen by a hash of the id, on the driver. Words take their text's
language as label; sequences are spliced from pieces of different texts, so that switches occur and transitions can be
learned. The gradient is observed minus expected counts, both for features and transitions (Adagrad).

Prediction: one pass in Arrow batches over whole texts. Each distinct word is scored once by a worker (a bounded
cache). Forward-backward is exact over the whole text at any length: texts are cut into blocks, the blocks' transfer
matrices are multiplied out side by side, chained by text, and the marginals inside all blocks found side by side.

Cases: null texts and texts without a letter are ``und`` with score 0; texts of unknown languages get the nearest
learned one; with no learnable rows every text is ``und``; very long texts are read whole; ties go to the language that
sorts first; repeated rows get a row each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_samples, learnable, table

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
#: Texts of each language that are learned from at most.
ROWS = 300
#: Words whose scores a worker keeps.
CACHE = 300_000
BLOCK = 32
UND = "und"


#: Letters of a word at most. Scripts without spaces run whole sentences together: such runs are cut, and every piece is labelled.
PIECE = 40


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    found = WORD.findall(text.lower())
    if max(map(len, found), default=0) <= PIECE:
        return found
    return [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]


def features(word: str) -> list[int]:
    """Hashed features of a word, each kind with a seed of its own."""
    crc = zlib.crc32
    w, b = word, f"^{word}$"
    out = [crc(word.encode("utf-8", "surrogatepass"), 1)]
    out += [crc(w[:n].encode("utf-8", "surrogatepass"), 2) for n in (1, 2, 3) if n <= len(w)]
    out += [crc(w[-n:].encode("utf-8", "surrogatepass"), 3) for n in (1, 2, 3) if n <= len(w)]
    out += [crc(b[i : i + n].encode("utf-8", "surrogatepass"), 4) for n in (2, 3) for i in range(len(b) - n + 1)]
    return [x % BUCKETS for x in out]


def forward_backward(e: np.ndarray, a: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (sequences, places, labels) and summed pair expectations of padded sequences; the plain way.

    e: potentials of words, positive; a: potentials of transitions. Before the first word every label is as likely.
    """
    s, t, n = e.shape
    alpha, beta, pairs = np.zeros_like(e), np.zeros_like(e), np.zeros((n, n))
    now = np.full((s, n), 1.0 / n)
    for i in range(t):
        new = (now @ a) * e[:, i]
        new /= new.sum(1, keepdims=True)
        now = np.where((i < lens)[:, None], new, now)
        alpha[:, i] = now
    now = np.full((s, n), 1.0)
    for i in range(t - 1, -1, -1):
        live = (i < lens)[:, None]
        beta[:, i] = now
        if i:
            ahead = e[:, i] * now
            joint = alpha[:, i - 1, :, None] * a[None] * ahead[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            pairs += (joint * live[:, :, None]).sum(0)
            new = ahead @ a.T
            now = np.where(live, new / new.sum(1, keepdims=True), now)
    out = alpha * beta
    return out / np.maximum(out.sum(2, keepdims=True), 1e-300), pairs


def marginals(e: np.ndarray, a: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Marginals (words, labels) of texts laid end to end, none empty; equal to forward_backward(), block by block."""
    n = e.shape[1]
    blocks = -(-lens // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    total = int(blocks.sum())
    text = np.repeat(np.arange(len(lens)), lens)
    within = np.arange(len(e)) - np.repeat(np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
    place = (first[text] + within // BLOCK, within % BLOCK)
    laid = np.ones((total, BLOCK, n))
    laid[place] = e
    live = np.zeros((total, BLOCK), bool)
    live[place] = True

    carry = np.broadcast_to(np.eye(n), (total, n, n)).copy()
    for i in range(BLOCK):
        new = (carry.reshape(-1, n) @ a).reshape(total, n, n) * laid[:, i, None, :]
        new /= new.max((1, 2), keepdims=True)
        carry = np.where(live[:, i, None, None], new, carry)

    into, back = np.empty((total, n)), np.empty((total, n))
    order = np.argsort(-blocks, kind="stable")
    counts = blocks[order]
    now = np.full((len(lens), n), 1.0 / n)
    for j in range(int(blocks.max(initial=0))):
        k = int(np.searchsorted(-counts, -j))  # texts with more than j blocks
        at = first[order[:k]] + j
        into[at] = now[:k]
        new = np.einsum("si,sij->sj", now[:k], carry[at])
        now[:k] = new / new.sum(1, keepdims=True)
    now = np.ones((len(lens), n))
    for j in range(int(blocks.max(initial=0))):
        k = int(np.searchsorted(-counts, -j))
        at = first[order[:k]] + blocks[order[:k]] - 1 - j
        back[at] = now[:k]
        new = np.einsum("sij,sj->si", carry[at], now[:k])
        now[:k] = new / new.sum(1, keepdims=True)

    alpha = np.empty_like(laid)
    now = into
    for i in range(BLOCK):
        new = (now @ a) * laid[:, i]
        new /= new.sum(1, keepdims=True)
        now = np.where(live[:, i, None], new, now)
        alpha[:, i] = now
    now = back
    for i in range(BLOCK - 1, -1, -1):
        alpha[:, i] *= now
        new = (laid[:, i] * now) @ a.T
        now = np.where(live[:, i, None], new / new.sum(1, keepdims=True), now)
    out = alpha[place]
    return out / out.sum(1, keepdims=True)


class Crf:
    """labels, weights of hashed features (buckets, labels), weights of lexicon features, transitions."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.w = np.zeros((BUCKETS, n), np.float32)
        self.lex_weight = np.full(n, 0.5)
        self.t = np.zeros((n, n))
        self.lexicon: dict[str, np.ndarray] = {}

    def lexical(self, word: str) -> np.ndarray:
        got = self.lexicon.get(word)
        return got if got is not None else np.zeros(len(self.labels))

    def scores(self, words: list[str]) -> np.ndarray:
        """Log potentials of words (words, labels); a word without letters says nothing."""
        if not words:
            return np.zeros((0, len(self.labels)))
        found = [features(w) for w in words]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for f in found for x in f), np.int64, int(lens.sum()))
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        out = np.add.reduceat(self.w[flat], starts, axis=0).astype(np.float64)
        return out + np.array([self.lexical(w) for w in words]) * self.lex_weight

    def fit(self, texts: Iterable[list[str]], labels: list[int], epochs: int = 3, piece: int = 100, batch: int = 48, rate: float = 0.15, seed: int = 3) -> None:
        n, rng = len(self.labels), np.random.default_rng(seed)
        number: dict[str, int] = {}
        rows = [np.array([number.setdefault(w, len(number)) for w in t], np.int64) for t in texts]
        counts = np.zeros((len(number), n))
        for r, label in zip(rows, labels):
            np.add.at(counts[:, label], r, 1)
        share = (counts + 0.3) / (counts.sum(0) + 0.3 * len(number))
        odds = np.log(share) - np.log(share).mean(1, keepdims=True)
        sure = counts.sum(1)
        odds *= (sure / (sure + 5))[:, None]
        names = list(number)
        self.lexicon = {names[i]: odds[i].copy() for i in np.flatnonzero(sure >= 3)}
        odds[sure < 3] = 0
        hashed_all, sizes = array("i"), array("i")
        for w in names:
            own = features(w)
            hashed_all.extend(own)
            sizes.append(len(own))
        flat, size = np.frombuffer(hashed_all, np.int32), np.frombuffer(sizes, np.int32)
        start = np.concatenate([[0], np.cumsum(size)])
        pieces = [(r[i : i + piece], label) for r, label in zip(rows, labels) for i in range(0, len(r), piece)]
        gw, gt, gl = np.full(self.w.shape, 1e-3, np.float32), np.full((n, n), 1e-3), np.full(n, 1e-3)
        for _ in range(epochs):
            order = rng.permutation(len(pieces))
            at, sequences = 0, []
            while at < len(order):
                k = int(rng.choice([1, 2, 3], p=[0.5, 0.3, 0.2]))
                sequences.append([pieces[i] for i in order[at : at + k]])
                at += k
            for at in range(0, len(sequences), batch):
                some = sequences[at : at + batch]
                ids = [np.concatenate([p for p, _ in s]) for s in some]
                gold = [np.concatenate([np.full(len(p), y) for p, y in s]) for s in some]
                lens = np.array([len(x) for x in ids])
                used, local = np.unique(np.concatenate(ids), return_inverse=True)
                spans = np.concatenate([np.arange(start[u], start[u + 1]) for u in used])
                widths = size[used]
                heads = np.concatenate([[0], np.cumsum(widths)[:-1]])
                score = np.add.reduceat(self.w[flat[spans]], heads, axis=0) + odds[used] * self.lex_weight
                e = np.ones((len(some), int(lens.max()), n))
                live = np.arange(e.shape[1])[None] < lens[:, None]
                pots = np.exp(score - score.max(1, keepdims=True))
                e[live] = np.maximum(pots[local], 1e-30)
                p, pairs = forward_backward(e, np.exp(self.t), lens)
                want = np.eye(n)[np.concatenate(gold)]
                diff = np.zeros((len(used), n))
                np.add.at(diff, local, p[live] - want)
                diff /= len(local) / 100
                for s in gold:
                    np.add.at(pairs, (s[:-1], s[1:]), -1.0)
                grad = pairs / len(local) * 10 + 1e-3 * self.t
                gt += grad * grad
                self.t -= rate * grad / np.sqrt(gt)
                lex = (diff * odds[used]).sum(0)
                gl += lex * lex
                self.lex_weight -= rate * lex / np.sqrt(gl)
                hashed, inverse = np.unique(flat[spans], return_inverse=True)
                g = np.zeros((len(hashed), n), np.float32)
                np.add.at(g, inverse, np.repeat(diff, widths, axis=0).astype(np.float32))
                gw[hashed] += g * g
                self.w[hashed] -= rate * g / np.sqrt(gw[hashed])

    def expected(self, scores: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Expected words by label (texts, labels) of texts laid end to end; ids are rows of scores."""
        out = np.zeros((len(lens), len(self.labels)))
        some = np.flatnonzero(lens)
        if len(some):
            s = scores[ids]
            e = np.maximum(np.exp(s - s.max(1, keepdims=True)), 1e-30)
            p = marginals(e, np.exp(self.t), lens[some])
            out[some] = np.add.reduceat(p, np.concatenate([[0], np.cumsum(lens[some])[:-1]]), axis=0)
        return out


class Words(dict):
    """Word to row, assigned as words come; words without a letter are row -1."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.count = 0

    def __missing__(self, word: str) -> int:
        if not any(map(str.isalpha, word)):
            self[word] = -1
            return -1
        self[word] = n = self.count
        self.count += 1
        self.fresh.append(word)
        return n


class Predictor:
    """Predicts texts, keeping the scores of words seen."""

    def __init__(self, model: Crf):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.words = Words()
        self.table = np.zeros((1024, len(self.model.labels)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.words) > CACHE:
            self._reset()
        known = self.words
        rows = [[i for i in map(known.__getitem__, words_of(t)) if i >= 0] for t in texts]
        if known.fresh:
            done = known.count - len(known.fresh)
            if known.count > len(self.table):
                grown = np.zeros((max(known.count, 2 * len(self.table)), self.table.shape[1]))
                grown[:done] = self.table[:done]
                self.table = grown
            self.table[done : known.count] = self.model.scores(known.fresh)
            known.fresh = []
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.fromiter((i for r in rows for i in r), np.int64, int(lens.sum()))
        if not self.model.labels:
            return [(UND, 0.0)] * len(rows)
        got = self.model.expected(self.table, ids, lens)
        best = got.argmax(1)
        return [(self.model.labels[b], float(min(1.0, g[b] / n))) if n else (UND, 0.0) for b, g, n in zip(best, got, lens)]


def fit(docs: DataFrame, rows: int = ROWS) -> Crf:
    """A field learned from up to rows learnable texts of each language."""
    known = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(counts)
    model = Crf(langs)
    if langs:
        found = bounded_samples(known, F.col("doc_id"), "lang", rows, counts)
        got = found.toPandas().sort_values(["lang", "doc_id", "text"])
        lettered = lambda t: [w for w in words_of(t) if any(map(str.isalpha, w))]
        kept = [(t, langs.index(x)) for t, x in zip(got["text"], got["lang"]) if any(map(str.isalpha, t))]
        if kept:
            model.fit((lettered(t) for t, _ in kept), [y for _, y in kept])
    return model


def identify(docs: DataFrame, model: Crf, text: str = "text"):
    """A column struct<lang_pred, lang_score> for docs."""

    @F.pandas_udf("struct<lang_pred: string, lang_score: double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(model)
        for s in batches:
            values, out, at = s.tolist(), [], 0
            while at < len(values):
                to, held = at, 0
                while to < len(values) and (to == at or held + len(values[to] or "") < 300_000):
                    held += len(values[to] or "")
                    to += 1
                out += predictor.predict(values[at:to])
                at = to
            yield pd.DataFrame(out, columns=["lang_pred", "lang_score"])

    # Not to be evaluated again for every place where its result is used, as the optimiser does with deterministic functions.
    return of.asNondeterministic()(docs[text])


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    found = docs.select("doc_id", identify(docs, model).alias("x"))
    return found.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), F.col("x.lang_pred").alias("lang_pred"), F.col("x.lang_score").alias("score"))
