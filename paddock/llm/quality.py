"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in tasks (counts of byte classes, words,
repeated words, lines and shingles).  The trees are grown on the driver from at
most ``MAX_TRAIN`` labelled rows, over 64 quantile bins of each statistic, and
flattened into arrays: node i of a tree has the children 2i+1 and 2i+2, so a
batch of documents walks down all trees with a few numpy look-ups per level.

Labels, language, source and id are never inputs of a score.

Defined cases: NULL and empty texts have statistics of zero and get a score
like any other.  Labels that are NULL or without a document are ignored;
repeated rows count as often as they occur.  Without labels the score is 0.5,
with labels of one kind near 0 or 1.  Other columns pass or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import kept_rows, remainder, unit_hash, with_computed
from paddock.llm.words import shingles, word_hashes

MAX_TRAIN = 30_000
TREES, DEPTH, BINS, RATE, LEAST, SMOOTH = 80, 4, 64, 0.15, 20, 1.0
THRESHOLD = 0.7

_KIND = np.zeros(256, dtype=np.uint8)       # 0: other ASCII signs
for _k, (_a, _b) in enumerate(((97, 123), (65, 91), (48, 58), (9, 14), (128, 256)), 1):
    _KIND[_a:_b] = _k
_KIND[32] = 6
for _c in b".,;:?'\"-()":
    _KIND[_c] = 7
NAMES = ("log_bytes", "log_words", "word_length", "lower", "upper", "digit", "breaks", "high", "space", "point", "sign",
         "distinct", "top_word", "repeated_next", "log_lines", "line_length", "distinct_lines", "shingles", "upper_of_letters")


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    out = np.zeros((len(texts), len(NAMES)))
    for i, (text, words) in enumerate(zip(texts, word_hashes(texts), strict=True)):
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if not len(raw):
            continue
        kind = np.bincount(_KIND[raw], minlength=8)
        n, w = len(raw), len(words)
        lines = text.split("\n")
        row = out[i]
        row[0], row[1], row[2] = np.log1p(n), np.log1p(w), (n - kind[4] - kind[6]) / max(1, w)
        row[3:11] = kind[[1, 2, 3, 4, 5, 6, 7, 0]] / n
        if w:
            sorted_words = np.sort(words)
            edge = np.flatnonzero(np.r_[True, sorted_words[1:] != sorted_words[:-1], True])
            row[11], row[12] = (len(edge) - 1) / w, np.diff(edge).max() / w
            row[13] = np.mean(words[1:] == words[:-1]) if w > 1 else 0.0
            row[17] = len(shingles(words)) / max(1, w - 4)
        row[14], row[15], row[16] = np.log1p(len(lines)), np.log1p(n / len(lines)), len(set(lines)) / len(lines)
        row[18] = kind[2] / max(1, kind[1] + kind[2])
    return out


@dataclass
class Trees:
    """Flattened trees: ``feature`` and ``cut`` [tree, inner node], ``leaf`` [tree, leaf]."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(self.feature.shape[1] + 1).bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting with the logistic loss; gains from histograms of the bins."""
    inner = (1 << DEPTH) - 1
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    if not len(y):
        return Trees(0.0, feature[:0], cut[:0], leaf[:0])
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Trees(base, feature[:0], cut[:0], leaf[:0])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    total = np.full(len(y), base)
    offset = np.arange(x.shape[1]) * BINS
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, x.shape[1] * BINS
            slot = ((node - first)[:, None] * width + offset + binned).ravel()
            shape = (1 << level, x.shape[1], BINS)
            gs, hs, ns = (np.bincount(slot, np.repeat(v, x.shape[1]), minlength=width << level).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(len(y))))
            gain = gs**2 / (hs + SMOOTH) + (gs[..., -1:] - gs) ** 2 / (hs[..., -1:] - hs + SMOOTH) - gs[..., -1:] ** 2 / (hs[..., -1:] + SMOOTH)
            gain[(ns < LEAST) | (ns[..., -1:] - ns < LEAST)] = 0
            for k in range(1 << level):
                j, b = divmod(int(gain[k].argmax()), BINS)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, first + k], cut[t, first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        at = node - inner
        leaf[t] = RATE * np.bincount(at, g, minlength=inner + 1) / (np.bincount(at, h, minlength=inner + 1) + SMOOTH)
        total += leaf[t, at]
    return Trees(base, feature, cut, leaf)


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, skip: int = 2) -> Trees:
    """Trees from a hash sample of about ``max_train`` labelled rows at most,
    of documents whose crc32 remainder modulo 4 is not ``skip``.  Where sampled ids
    repeat in ``docs``, at most ``2 * max_train`` rows are taken."""
    known = labels.where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), 4) != skip)).select("doc_id", "quality")
    share = max_train / max(1, known.count())
    # At most about max_train rows of two numbers.
    known = F.broadcast(known.where(unit_hash(F.col("doc_id"), seed=6) < share))
    kind = "array<double>"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"quality": batch["quality"], "x": list(statistics(batch["text"].tolist()))})

    rows = docs.select("doc_id", "text").join(known, "doc_id").select("text", "quality").mapInPandas(measure, f"quality int, x {kind}").limit(2 * max_train).toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(NAMES))
    y = rows["quality"].to_numpy(dtype=float)
    # Rows come in any order; sums of floats shall not depend on it.
    order = np.lexsort((*x.T, y))
    return grow(x[order], y[order])


def quality_scores(docs: DataFrame, trees: Trees, skip: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""

    def score(texts: list[str | None]) -> list:
        s = trees.score(statistics(texts))
        return [s, (s >= THRESHOLD).astype("int32")]

    held = docs.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 4) == skip, F.lit(False)))
    return with_computed(held, ["doc_id", "held_out"], "text", score, "score double, predicted int")


def good_documents(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of ``docs`` that the trees score at the threshold or above."""

    return kept_rows(docs, "text", lambda texts: trees.score(statistics(texts)) >= THRESHOLD)
