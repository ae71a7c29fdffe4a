"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three rows of one hashed table: the word's and those of its first 4 and 5 letters, so
that inflected forms that weren't seen share what was learned. Filters of widths 1, 2 and 3 slide over all words of the
text; each is pooled by its maximum, and a logistic layer scores the pooled values. Training (Adam, gradients through
the pooled places only) runs on the driver over at most ``ROWS`` labelled texts of each class, chosen by a hash of the
id; the first embedding coordinate starts from the smoothed log odds of its bucket. The bias is corrected from the
sampled to the true share of labels. Thresholds by language are calibrated on a fold of the sample that isn't trained
on; where it has too few positives the common threshold holds.

Scoring is one pass in Arrow batches over whole texts. By the distributive law the filters are applied to each
distinct word once (a bounded cache of products in each worker), and a text costs a gather, two sums and a maximum.

Cases: null and empty texts get the score of no words; very long texts are scored whole; null ids are never learned
from; an empty or one-class label table gives the constant score of its share (0.0 without labels); repeated rows get a
row each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, learnable, table

WORD = re.compile(r"[^\W_]+")
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
#: Labelled texts of each class that are learned from at most.
ROWS = 3000
THRESHOLD = 0.3
#: Words whose products a worker keeps.
CACHE = 150_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def buckets_of(word: str) -> tuple[int, int, int]:
    b = word.encode("utf-8", "surrogatepass")
    p4, p5 = word[:4].encode("utf-8", "surrogatepass"), word[:5].encode("utf-8", "surrogatepass")
    return zlib.crc32(b) % BUCKETS, zlib.crc32(p4, 4) % BUCKETS, zlib.crc32(p5, 5) % BUCKETS


class Vocabulary(dict):
    """Word to row, assigned as words come; rows holds their buckets. Row 0 is the padding."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int, int]] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.rows) + 1
        self.rows.append(buckets_of(word))
        return n


def laid_out(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Word rows of texts one after the other, each followed by padding as wide as a filter may look; their starts."""
    pad = max(WIDTHS)
    lens = np.fromiter((len(t) + pad for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
    ids = np.zeros(int(lens.sum()), np.int64)
    for s, t in zip(starts, texts):
        ids[s : s + len(t)] = t
    return ids, starts


class Classifier:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.E = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.W = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for w in self.W:
            w[0, 0, : FILTERS // 2] += 0.4
        n = FILTERS * len(WIDTHS)
        self.c = np.full(n, -0.3, np.float32)
        self.v = np.full(n, 0.15, np.float32)
        self.b = np.float32(-0.5)
        self.constant: float | None = None
        self.thresholds: dict[str, float] = {}

    def products(self, rows: np.ndarray) -> np.ndarray:
        """What a word gives to each place of each filter: (words, sum of widths * filters)."""
        e = self.E[rows[:, 0]] + self.E[rows[:, 1]] + self.E[rows[:, 2]]
        return np.concatenate([e @ m for w in self.W for m in w], axis=1)

    def convolved(self, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Filter outputs at each place; the last places of a text look into its padding."""
        n = len(ids)
        got = table[ids]
        out, at = np.empty((n, FILTERS * len(WIDTHS)), np.float32), 0
        for j, w in enumerate(WIDTHS):
            o = out[:, j * FILTERS : (j + 1) * FILTERS]
            o[:] = got[:, at : at + FILTERS]
            for k in range(1, w):
                o[: n - k] += got[k:, at + k * FILTERS : at + (k + 1) * FILTERS]
            at += w * FILTERS
        return out

    def fit(self, vocabulary: Vocabulary, texts: list[list[int]], y: np.ndarray, epochs: int = 6, steps: int = 150, batch: int = 150, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        rows = np.array([(0, 0, 0), *vocabulary.rows], np.int64)
        counts = np.zeros((2, BUCKETS))
        for t, label in zip(texts, y):
            seen = rows[np.unique(np.asarray(t, np.int64))] if t else rows[:0]
            counts[int(label), np.unique(seen)] += 1
        n1, n0 = y.sum(), len(y) - y.sum()
        odds = np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5) / (n0 + 1))
        self.E[:, 0] = np.clip(odds, -3, 3) * counts.sum(0) / (counts.sum(0) + 3)  # a word that is seen once says little
        moments: dict[str, list] = {}
        step = 0

        def adam(name: str, value: np.ndarray, grad: np.ndarray, at: np.ndarray | slice = slice(None)) -> None:
            """at: the rows that have a gradient; the others and their moments rest."""
            m, v = moments.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
            m[at] += 0.1 * (grad - m[at])
            v[at] += 0.01 * (grad * grad - v[at])
            value[at] -= (rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

        for _ in range(max(epochs, -(-steps * batch // len(texts)))):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                step += 1
                pick = order[at : at + batch]
                ids, starts = laid_out([texts[i] for i in pick])
                used, local = np.unique(ids, return_inverse=True)
                emb = self.E[rows[used, 0]] + self.E[rows[used, 1]] + self.E[rows[used, 2]]
                emb[used == 0] = 0
                out = self.convolved(np.concatenate([emb @ m for w in self.W for m in w], axis=1), local)
                top = np.maximum.reduceat(out, starts, axis=0)
                z = np.maximum(top + self.c, 0)
                p = 1 / (1 + np.exp(-(z @ self.v + self.b)))
                d = ((p - y[pick]) / len(pick)).astype(np.float32)
                dz = d[:, None] * self.v[None] * (z > 0)
                doc = np.repeat(np.arange(len(pick)), np.diff([*starts, len(ids)]))
                grads, de = [np.zeros_like(w) for w in self.W], np.zeros_like(emb)
                for f in range(out.shape[1]):
                    places = np.flatnonzero(out[:, f] == top[doc, f])
                    docs, first = np.unique(doc[places], return_index=True)
                    live = dz[docs, f] != 0
                    place, g, j = places[first[live]], dz[docs[live], f], f // FILTERS
                    for k in range(WIDTHS[j]):
                        inside = place + k < len(ids)
                        word, gk = local[place[inside] + k], g[inside, None]
                        grads[j][k, :, f % FILTERS] += (emb[word] * gk).sum(0)
                        np.add.at(de, word, gk * self.W[j][k, :, f % FILTERS])
                de[used == 0] = 0
                touched = np.flatnonzero(np.abs(de).sum(1))
                hashed, inverse = np.unique(rows[used[touched]].ravel(), return_inverse=True)
                dE = np.zeros((len(hashed), DIM), np.float32)
                np.add.at(dE, inverse, np.repeat(de[touched], 3, axis=0))
                adam("E", self.E, dE, hashed)
                for j, g in enumerate(grads):
                    adam(f"W{j}", self.W[j], g)
                adam("c", self.c, dz.sum(0))
                dv = (d[:, None] * z).sum(0)
                adam("v", self.v, dv)
                bias = np.array([self.b], np.float32)
                adam("b", bias, np.array([d.sum()], np.float32))
                self.b = bias[0]

    def scores(self, vocabulary: Vocabulary, table: np.ndarray, texts: list[list[int]]) -> np.ndarray:
        """Probabilities of texts given as word rows; table has the products of all rows."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (held == 0 or held + len(texts[to]) < 1 << 14):
                held += len(texts[to])
                to += 1
            ids, starts = laid_out(texts[at:to])
            z = np.maximum(np.maximum.reduceat(self.convolved(table, ids), starts, axis=0) + self.c, 0)
            out[at:to] = 1 / (1 + np.exp(-np.clip((z @ self.v + self.b).astype(np.float64), -50, 50)))
            at = to
        return out


def trained(texts: list[str | None], labels: list[int], langs: list[str | None], share: float | None = None, seed: int = 7) -> Classifier:
    """A classifier learned from a balanced sample; share: the true share of label 1."""
    model, y = Classifier(seed), np.asarray(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        model.constant = float(y[0]) if len(y) else 0.0
        return model
    vocabulary = Vocabulary()
    rows = [[vocabulary[w] for w in words_of(t)] for t in texts]
    fold = np.arange(len(y)) % 6 == 5
    fit = np.flatnonzero(~fold) if 0 < y[~fold].sum() < (~fold).sum() else np.arange(len(y))
    model.fit(vocabulary, [rows[i] for i in fit], y[fit])
    if share:
        was = float(y[fit].mean())
        model.b = np.float32(model.b + np.log(share / (1 - share)) - np.log(was / (1 - was)))
    table = np.concatenate([np.zeros((1, FILTERS * sum(WIDTHS)), np.float32), model.products(np.array(vocabulary.rows, np.int64))])
    scored = model.scores(vocabulary, table, rows)
    for lang in sorted({x for x in langs if x is not None}):
        pick = np.array([x == lang for x in langs]) & fold
        p, t = scored[pick], y[pick] > 0
        if t.sum() >= 20 and (~t).sum() >= 20:
            cuts = np.unique(p)
            f1 = [2 * (t & (p >= c)).sum() / (t.sum() + (p >= c).sum()) for c in cuts]
            best = int(np.argmax(f1))
            model.thresholds[lang] = float((cuts[best] + (cuts[best - 1] if best else 0)) / 2)
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS, target: str = "toxic") -> tuple[pd.DataFrame, float | None]:
    """Up to rows learnable texts of each class, by hash of the id, and the true share of label 1. An id labelled both ways counts as 1."""
    known = labels.where(learnable(F.col("doc_id")) & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    by_hash = [bounded_sample(known.where(F.col("label") == v), F.col("doc_id"), rows, counts.get(v, 0)) for v in (0, 1)]
    few = F.broadcast(by_hash[0].unionByName(by_hash[1]))
    found = docs.select("doc_id", "text", "lang").join(few, "doc_id").toPandas().sort_values(["doc_id", "text"], na_position="first")
    found = found.drop_duplicates("doc_id").sample(frac=1, random_state=5).reset_index(drop=True)
    n = sum(counts.values())
    return found, counts.get(1, 0) / n if n else None


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Classifier:
    found, share = sample(docs, labels, rows)
    return trained(found["text"].tolist(), found["label"].tolist(), found["lang"].tolist(), share)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs (doc_id, text, lang) with score and flagged (score over the threshold of its language)."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        width = FILTERS * sum(WIDTHS)
        vocabulary, table = Vocabulary(), np.zeros((1, width), np.float32)
        for s in batches:
            out = np.empty(len(s))
            for at in range(0, len(s), 64):
                if len(vocabulary) > CACHE:
                    vocabulary, table = Vocabulary(), np.zeros((1, width), np.float32)
                rows = [list(map(vocabulary.__getitem__, words_of(t))) for t in s.iloc[at : at + 64]]
                n = len(vocabulary.rows) + 1
                if n > len(table):
                    grown = np.zeros((max(n, 2 * len(table)), width), np.float32)
                    grown[: len(table)] = table
                    table = grown
                if n > filled(vocabulary):
                    fresh = np.array(vocabulary.rows[filled(vocabulary) - 1 :], np.int64)
                    table[filled(vocabulary) : n] = model.products(fresh)
                    vocabulary.filled = n
                out[at : at + 64] = model.scores(vocabulary, table, rows)
            yield pd.Series(out)

    def filled(v: Vocabulary) -> int:
        return getattr(v, "filled", 1)

    limit = F.lit(THRESHOLD)
    for lang, cut in model.thresholds.items():
        limit = F.when(F.col("lang") == lang, F.lit(cut)).otherwise(limit)
    return docs.select("doc_id", "lang", of("text").alias("score")).withColumn("flagged", F.col("score") >= limit)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "flagged")
