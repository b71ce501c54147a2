"""Importance resampling towards a target distribution, by bit-sliced aggregation.

Documents and target texts are bags of hashed features: all runs of 1 to
``width`` consecutive words, each in bucket ``crc32 mod buckets``.  A bucket's
gain is the floored 1000-fold logarithm of its smoothed share in the target
over that in the documents.  A document's weight is the floored mean gain of its
features, made exactly without touching features one by one:

1. its bucket counts become bit planes: plane k is a bitmap of ``buckets`` bits
   that holds bit k of every count;
2. the gains become signed bit planes (two's complement: the highest plane
   counts negative);
3. every pair of planes is ANDed and popcounted; the popcounts, times powers of
   two, add up to the sum of count times gain.

Weights plus Gumbel noise (from sha256 of seed and doc_id, so free of order and
partition) give scores; the highest ones are drawn without replacement.

Scale: bucket counts are summed within each task first (at most ``buckets``
rows a task).  The draw's cut-off comes from the number of documents by score:
scores are whole numbers between about -47 000 and 67 000 whatever the input
(gains are bounded by the logarithm of the feature count), so that table is
bounded.  Only documents at or above the cut-off are sorted, by range pieces;
a rank is the place in the piece plus the sizes of the pieces before, so no
window or task sees all of them, and equal scores or repeated ids spread over
pieces by row number.  Scores are stored in the shared folder once.

Defined cases: NULL and empty texts have no features, weight 0 and are not
drawn.  A NULL doc_id counts as the text ''; it sorts after all others.
Repeated rows have equal scores and are drawn one by one.  Texts of any length
are read in parts of about ``CHUNK`` bytes; empty tables (either) work.  Other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import shuffle_parts, small_batches, stored, with_computed

BUCKETS = 10_000
CHUNK = 1 << 20
DOCS = 64
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def text_words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, as lists of bounded size (a longer single word apart)."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    at = 0
    while len(raw) - at > CHUNK:
        gap = _GAP.search(raw, at + CHUNK)
        cut = gap.end() if gap else len(raw)
        yield _WORD.findall(raw, at, cut)
        at = cut
    yield _WORD.findall(raw, at)


def text_features(text: str | None, width: int) -> Iterator[list[bytes]]:
    """All runs of 1 to ``width`` words, joined by one space."""
    tail: list[bytes] = []
    for words in text_words(text):
        runs = list(words)
        for n in range(2, width + 1):
            # Runs that end in these words: they may begin in the words before.
            line = tail[len(tail) - min(len(tail), n - 1):] + words
            runs += [b" ".join(run) for run in zip(*(islice(line, k, None) for k in range(n)), strict=False)]
        tail = (tail + words)[-(width - 1):] if width > 1 else []
        yield runs


def text_buckets(text: str | None, buckets: int, width: int) -> np.ndarray:
    """The bucket of every feature of the text, repeats included."""
    parts = [np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % np.uint32(buckets) for runs in text_features(text, width)]
    return np.concatenate(parts)


def bucket_totals(texts: DataFrame, buckets: int, width: int) -> np.ndarray:
    """How many features of all texts fall in each bucket: one partial sum a task, added by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for runs in text_features(text.as_py(), width):
                    total += np.bincount(np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    small_batches(texts.sparkSession)
    sums = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in sums.collect():              # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed target share / smoothed source share)) of each bucket."""
    buckets = len(source)
    s_all, t_all = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def packed_plane(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 values as rows of 64-bit words."""
    raw = np.packbits(bits, axis=-1)
    return np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, -raw.shape[-1] % 8)]).view(np.uint64)


def signed_planes(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(coefficient, bitmap) pairs whose sum is ``values``: two's complement, top plane negative."""
    top = max(int(values.max(initial=0)).bit_length(), int(-values.min(initial=0)).bit_length())
    planes = [(1 << j, packed_plane(((values >> j) & 1).astype(np.uint8))) for j in range(top)]
    return [*planes, (-(1 << top), packed_plane((values < 0).astype(np.uint8)))]


def sliced_sums(counts: np.ndarray, gains: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """For each row of counts the exact sum of count times gain, from bit planes alone."""
    total = np.zeros(len(counts), dtype=np.int64)
    for k in range(int(counts.max(initial=0)).bit_length()):
        plane = packed_plane((counts >> counts.dtype.type(k)) & counts.dtype.type(1) != 0)
        rows = np.flatnonzero(plane.any(axis=1))
        plane = plane[rows]
        for coefficient, gain in gains:
            total[rows] += (coefficient << k) * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
    return total


def weigher(gains: np.ndarray, width: int) -> Callable[[list], list]:
    """From texts to their feature counts, word counts and weights, ``DOCS`` texts at a time."""
    planes, buckets = signed_planes(gains), len(gains)

    def weigh(texts: list[str | None]) -> list:
        features, words, weights = [], [], []
        for at in range(0, len(texts), DOCS):
            some = texts[at:at + DOCS]
            counts = np.zeros((len(some), buckets), dtype=np.int64)
            for i, text in enumerate(some):
                counts[i] = np.bincount(text_buckets(text, buckets, width), minlength=buckets)
            n = counts.sum(axis=1)
            if counts.max(initial=0) < 256:
                counts = counts.astype(np.uint8)
            total = sliced_sums(counts, planes)
            features += n.tolist()
            words += n.tolist() if width == 1 else [sum(map(len, text_words(t))) for t in some]
            weights += np.where(n > 0, total // np.maximum(n, 1), 0).tolist()
        return [features, words, weights]

    return weigh


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hexadecimal digits of sha256('seed:doc_id')."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def cut_off(scored: DataFrame, percent: int) -> tuple[int, int]:
    """How many rows are drawn, and the lowest score among them (from counts by score, a bounded table)."""
    counts = sorted(scored.groupBy("score").agg(F.count("*").alias("n")).collect(), reverse=True)
    draw = percent * sum(n for _, n in counts) // 100
    left = draw
    for score, n in counts:
        left -= n
        if left <= 0:
            return draw, score
    return draw, 0


def ranked(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``df`` with the place 1, 2, 3, ... of each row in the global order: pieces by
    range, stored with the place in the piece, then moved by the sizes of the pieces before."""
    pieces = shuffle_parts(df.sparkSession)
    place = stored(
        df.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
        .withColumn("__piece", F.spark_partition_id())
        .withColumn("__place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "places")
    sizes = dict(place.groupBy("__piece").count().collect())    # one row a piece
    before, rows = 0, []
    for piece in sorted(sizes):
        rows.append((piece, before))
        before += sizes[piece]
    offsets = df.sparkSession.createDataFrame(rows, "piece int, before long")
    joined = place.join(F.broadcast(offsets), F.col("__piece") == F.col("piece"))
    return joined.select(*df.columns, (F.col("before") + F.col("__place") + 1).alias(rank))


def importance_sample(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, width: int = 1,
                      percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs``; rank is NULL where not drawn.

    ``percent`` of the documents with at least ``min_words`` words are drawn, highest
    scores first, ties to the smaller doc_id."""
    gains = bucket_gains(bucket_totals(docs, buckets, width), bucket_totals(target, buckets, width))
    weighed = with_computed(docs, ["doc_id"], "text", weigher(gains, width), "n_features long, n_words long, weight long")
    scored = stored(
        weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
        .withColumn("row", F.monotonically_increasing_id()), "scores")
    enough = F.col("n_words") >= min_words
    draw, lowest = cut_off(scored.where(enough), percent)
    drawn = enough & (F.col("score") >= lowest) & F.lit(draw > 0)
    columns = ["doc_id", "n_features", "weight", "score"]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("row")]
    top = ranked(scored.where(drawn), order, "rank")
    top = top.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return top.unionByName(scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
