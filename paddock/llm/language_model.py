"""Interpolated modified Kneser-Ney language model, counted in Spark and kept
as sorted hash arrays that workers memory-map.

Order 2: ``P(w|v) = (c(vw) - D(c(vw))) / c(v) + g(v) P1(w)``, where P1 is the
same form over continuation counts (in how many different contexts w was seen)
and ends in the uniform ``1 / (V + 1)``, one share for all unknown words.  The
three discounts of each level come from its counts of counts.

Counting.  Tasks count the words, then the word pairs, of a block of texts and
send packed arrays to hash-range buckets: a frequent word or pair is one entry
a block.  Pairs are dealt by their first word, so a bucket can sum up each
context; the pairs of words that make up more than 1/2000 of all tokens, or than
a mean bucket where there are more buckets (so fewer words than buckets), are
dealt by the whole pair instead and their sums are added up afterwards.  Each bucket writes its arrays to the shared folder under its
own name (written aside and renamed, so a repeated task changes nothing).

Scoring.  A narrow pass over whole texts; the look-ups of a block are sorted,
so the mapped arrays are read in order.  Mapped pages are shared by a machine's
workers and can be dropped by its kernel.  A shared folder that is not mounted
as files is copied to the worker's own folder first.

The model grows with the corpus.  Words are told apart by 64-bit hashes (48
bits within pairs).

Defined cases: NULL and wordless texts are the end token alone.  Repeated rows
count and are scored each time.  Texts without words to learn from: V counts
the end token if there was any text.  Empty tables give an empty result.
Discounts whose counts of counts are zero are half of 1, 2 and 3.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import new_path, remainder, shuffle_parts, small_batches, with_computed
from paddock.llm.words import each_words, mix, word_hashes

BLOCK_TOKENS = 2_500_000
SCORE_TOKENS = 400_000
BUCKET_BYTES = 16 << 20          # text whose pairs make one bucket
HOT_SHARE = 2_000
START, END = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x7B1C5F0A9E6D3B85)
_SHIFT = np.uint64(16)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hash ranges of equal width: arrays of successive buckets are sorted as a whole."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0x9FB21C651E98DF25) + w * np.uint64(0xD6E8FEB86659FD93))


def _six(x: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _small(counts: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts as 16-bit numbers; an entry of more is repeated."""
    if len(counts) and counts.max() > 65535:
        times = (counts + 65534) // 65535
        columns = tuple(np.repeat(c, times) for c in columns)
        rest = np.repeat(counts, times)
        place = np.arange(len(rest)) - np.repeat(np.cumsum(times) - times, times)
        counts = np.minimum(65535, rest - place * 65535)
    return (counts.astype("<u2"), *columns)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return (keys[new], *(np.add.reduceat(v[order].astype(np.int64), new) if len(new) else v.astype(np.int64) for v in values))


def counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)] + [int((c >= 3).sum())]


def discounts(n: list[int]) -> np.ndarray:
    """For counts 0, 1, 2 and 3 or more, from counts of counts 1 to 4."""
    out = [0.0, 0.5, 1.0, 1.5]
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        out[1] = 1 - 2 * y * n[1] / n[0]
        if n[2]:
            out[2] = 2 - 3 * y * n[2] / n[1]
            if n[3]:
                out[3] = 3 - 4 * y * n[3] / n[2]
    return np.array([min(max(d, 0.0), float(k)) for k, d in enumerate(out)])


class Folder:
    """Arrays by name in the shared folder."""

    def __init__(self, uri: str):
        self.uri = uri

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, name: str, array: np.ndarray) -> None:
        system, path = self._system()
        system.create_dir(path, recursive=True)
        aside = f"{path}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as out:
            out.write(np.ascontiguousarray(array).tobytes())
        system.move(aside, f"{path}/{name}")

    def map(self, name: str, dtype: str) -> np.ndarray:
        from pyarrow import fs

        system, path = self._system()
        at = f"{path}/{name}"
        if not isinstance(system, fs.LocalFileSystem):
            own = os.path.join(tempfile.gettempdir(), os.path.basename(path))
            at = os.path.join(own, name)
            if not os.path.exists(at):
                os.makedirs(own, exist_ok=True)
                aside = f"{at}-{uuid.uuid4().hex}"
                fs.copy_files(f"{path}/{name}", aside, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
                os.replace(aside, at)
        return np.memmap(at, dtype=dtype, mode="r") if os.path.getsize(at) else np.zeros(0, dtype)


def _blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        for words in each_words(batch["text"].tolist()):
            held.append(words)
            n += len(words) + 1
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


_WORDS = "bucket long, key binary, count binary"
_PAIRS = "bucket long, first binary, run binary, second binary, count binary"
_STATS = "kind string, bucket long, numbers array<long>, top array<long>"


def _count_words(buckets: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts in _blocks(batches, BLOCK_TOKENS):
            key, n = np.unique(np.concatenate(texts), return_counts=True)
            key, n = _sums(np.r_[key, END].astype(np.uint64), np.r_[n, len(texts)])
            n, key = _small(n, key)
            at = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
            yield pd.DataFrame([(b, key[at[b]:at[b + 1]].astype("<u8").tobytes(), n[at[b]:at[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(at))], columns=["bucket", "key", "count"])

    return count


def _join(column: pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype)


def _write_words(folder: Folder):
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        key, n = _sums(_join(rows["key"], "<u8"), _join(rows["count"], "<u2"))
        folder.write(f"word-{bucket}", key.astype("<u8"))
        folder.write(f"count-{bucket}", n.astype("<i8"))
        top = np.argsort(-n, kind="stable")[:200]
        return pd.DataFrame({"kind": ["words"], "bucket": [bucket], "numbers": [[len(key), int(n.sum())]], "top": [np.r_[key[top].astype(np.uint64).view(np.int64), n[top]].tolist()]})

    return write


def _count_pairs(buckets: int, hot: np.ndarray):
    def deal(v: np.ndarray, w: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> list[tuple]:
        """Rows by bucket; the entries come sorted by (bucket, v)."""
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(at)):
            of = slice(at[b], at[b + 1])
            first = np.flatnonzero(np.r_[True, v[of][1:] != v[of][:-1]])
            run = np.diff(np.r_[first, at[b + 1] - at[b]]).astype("<u4")
            out.append((int(b), _six(v[of][first]), run.tobytes(), _six(w[of]), n[of].tobytes()))
        return out

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts in _blocks(batches, BLOCK_TOKENS):
            ends = np.cumsum([len(t) + 1 for t in texts])
            w = np.full(ends[-1], END)
            mask = np.ones(len(w), bool)
            mask[ends - 1] = False
            w[mask] = np.concatenate(texts)
            v = np.r_[START, w[:-1]]
            v[ends[:-1]] = START
            v, w = v >> _SHIFT, w >> _SHIFT
            order = np.lexsort((w, v))
            v, w = v[order], w[order]
            new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
            n, v, w = _small(np.diff(np.r_[new, len(v)]), v[new], w[new])
            often = np.isin(v, hot)
            rows = deal(v[~often], w[~often], n[~often], bucket_of(v[~often] << _SHIFT, buckets))
            if often.any():
                v, w, n = v[often], w[often], n[often]
                b = bucket_of(pair_hash(v, w), buckets)
                order = np.argsort(b, kind="stable")
                rows += deal(v[order], w[order], n[order], b[order])
            yield pd.DataFrame(rows, columns=["bucket", "first", "run", "second", "count"])

    return count


_SIDES = "bucket long, key binary, seen binary, total binary, one binary, two binary, more binary, numbers array<long>"
_SIDE_COLUMNS = ["bucket", "key", "seen", "total", "one", "two", "more", "numbers"]


def _write_pairs(folder: Folder, buckets: int):
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        v = np.repeat(np.concatenate([_from_six(x) for x in rows["first"]]), _join(rows["run"], "<u4"))
        w = np.concatenate([_from_six(x) for x in rows["second"]])
        n = _join(rows["count"], "<u2").astype(np.int64)
        order = np.lexsort((w, v))
        v, w, n = v[order], w[order], n[order]
        new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
        v, w, n = v[new], w[new], np.add.reduceat(n, new)
        key = pair_hash(v, w)
        order = np.argsort(key)
        folder.write(f"pair-{bucket}", key[order].astype("<u8"))
        folder.write(f"pairs-{bucket}", np.minimum(n[order], 255).astype(np.uint8))
        big = n[order] >= 255
        folder.write(f"big-{bucket}", key[order][big].astype("<u8"))
        folder.write(f"bigs-{bucket}", n[order][big].astype("<i8"))
        context, total, one, two, more = _sums(v, n, n == 1, n == 2, n >= 3)
        word, seen = _sums(w, np.ones(len(w), np.int64))
        # Both sides by word: as a context, and in how many contexts it was seen.
        every = np.union1d(context, word)
        side = lambda keys, values: _spread(every, keys, values)
        columns = [side(word, seen), side(context, total).astype("<u8"), *(side(context, x) for x in (one, two, more))]
        columns = [c if c.dtype == np.uint64 else c.astype("<u4") for c in columns]
        at = np.searchsorted(bucket_of(every << _SHIFT, buckets), np.arange(buckets + 1))
        out = [(int(b), _six(every[at[b]:at[b + 1]]), *(c[at[b]:at[b + 1]].tobytes() for c in columns), None) for b in np.flatnonzero(np.diff(at))]
        out.append((-1 - bucket, None, None, None, None, None, None, [len(n), *counts_of_counts(n)]))
        return pd.DataFrame(out, columns=_SIDE_COLUMNS)

    return write


def _spread(every: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(every), np.int64)
    out[np.searchsorted(every, keys)] = values
    return out


def _write_sides(folder: Folder):
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        if bucket < 0:
            return pd.DataFrame({"kind": ["pairs"], "bucket": [-1 - bucket], "numbers": [rows["numbers"].iloc[0]], "top": [[]]})
        key = np.concatenate([_from_six(x) for x in rows["key"]])
        columns = [_join(rows[c], "<u8" if c == "total" else "<u4") for c in _SIDE_COLUMNS[2:7]]
        key, seen, total, one, two, more = _sums(key, *columns)
        folder.write(f"side-{bucket}", key.astype("<u8"))
        wide = 4 if total.max(initial=0) < 1 << 32 else 8
        folder.write(f"sides-{bucket}", np.stack([seen, total, one, two, more], axis=1).astype(f"<u{wide}"))
        return pd.DataFrame({"kind": ["sides"], "bucket": [bucket], "numbers": [[int(seen.sum()), *counts_of_counts(seen), wide]], "top": [[]]})

    return write


@dataclass
class KneserNey:
    """The numbers of a model and where its arrays are."""

    uri: str
    buckets: int
    hot: list[int]
    tokens: int
    vocabulary: int
    wide: dict[int, int]                 # bytes a number in each bucket's side columns
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    word_total: int
    word_rest: float                     # mass that the lower level leaves for the uniform
    filled: dict[str, list[int]]         # buckets that have arrays, by kind
    _maps: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_maps": {}}

    def _map(self, name: str, bucket: int, dtype: str) -> np.ndarray:
        at = (name, bucket)
        if at not in self._maps:
            self._maps[at] = Folder(self.uri).map(f"{name}-{bucket}", dtype)
        return self._maps[at]

    def _look_up(self, kind: str, keys: np.ndarray, bucket: np.ndarray, values: str, dtype, width: int = 1) -> np.ndarray:
        """Values of sorted (bucket, key); zero where the key is unknown."""
        out = np.zeros((len(keys), width), np.int64)
        at = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in self.filled.get(kind, ()):
            if at[b] < at[b + 1]:
                have = self._map(kind, b, "<u8")
                mine = keys[at[b]:at[b + 1]]
                place = np.minimum(np.searchsorted(have, mine), len(have) - 1)
                known = np.flatnonzero(have[place] == mine)
                table = self._map(values, b, dtype(b)).reshape(-1, width)
                out[at[b] + known] = table[place[known]]
        return out

    def _pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        key = pair_hash(v, w)
        often = np.isin(v, np.array(self.hot, dtype=np.uint64))
        bucket = np.where(often, bucket_of(key, self.buckets), bucket_of(v << _SHIFT, self.buckets))
        order = np.lexsort((key, bucket))
        n = self._look_up("pair", key[order], bucket[order], "pairs", lambda b: "u1")[:, 0]
        big = np.flatnonzero(n == 255)
        if len(big):
            n[big] = self._look_up("big", key[order][big], bucket[order][big], "bigs", lambda b: "<i8")[:, 0]
        out = np.empty(len(n), np.int64)
        out[order] = n
        return out

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base score and model score of each text's word hashes."""
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        w = np.full(ends[-1], END)
        mask = np.ones(len(w), bool)
        mask[ends - 1] = False
        w[mask] = np.concatenate(texts)
        v = np.r_[START, w[:-1]]
        v[starts] = START
        distinct, at = np.unique(w, return_inverse=True)
        count = self._look_up("word", distinct, bucket_of(distinct, self.buckets), "count", lambda b: "<i8")[:, 0][at]
        base = np.log10((count + 1) / (self.tokens + self.vocabulary + 1))
        short_v, short_w = v >> _SHIFT, w >> _SHIFT
        distinct, at = np.unique(np.r_[short_v, short_w], return_inverse=True)
        sides = self._look_up("side", distinct, bucket_of(distinct << _SHIFT, self.buckets), "sides", lambda b: f"<u{self.wide[b]}", 5)
        context, word = sides[at[:len(v)]], sides[at[len(v):]]
        seen = word[:, 0]
        lower = (seen - self.word_discounts[np.minimum(seen, 3)]) / max(1, self.word_total) + self.word_rest / (self.vocabulary + 1)
        n = self._pairs(short_v, short_w)
        total = context[:, 1]
        rest = context[:, 2:] @ self.pair_discounts[1:]
        upper = (n - self.pair_discounts[np.minimum(n, 3)] + rest * lower) / np.maximum(1, total)
        p = np.where(total > 0, upper, lower)
        add = lambda x: np.add.reduceat(x, starts)
        return lengths, add((count > 0).astype(np.int64)), add(base), add(np.log10(p))


def learn(docs: DataFrame) -> KneserNey:
    """Counts all texts of ``docs``; driver-side are only some numbers a bucket."""
    spark = docs.sparkSession
    small_batches(spark)
    uri = new_path(spark, "kneser-ney")
    folder = Folder(uri)
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_parts(spark), size // BUCKET_BYTES + 1)
    words = texts.mapInPandas(_count_words(buckets), _WORDS).groupBy("bucket").applyInPandas(_write_words(folder), _STATS).collect()
    vocabulary, tokens = (sum(r["numbers"][k] for r in words) for k in (0, 1))
    hot = [START >> _SHIFT]
    for r in words:
        k = len(r["top"]) // 2
        hot += [np.uint64(key & (1 << 64) - 1) >> _SHIFT for key, n in zip(r["top"][:k], r["top"][k:], strict=True) if n * max(HOT_SHARE, buckets) > tokens]
    hot_words = np.unique(np.array(hot, dtype=np.uint64))
    sides = (texts.mapInPandas(_count_pairs(buckets, hot_words), _PAIRS).groupBy("bucket").applyInPandas(_write_pairs(folder, buckets), _SIDES)
             .groupBy("bucket").applyInPandas(_write_sides(folder), _STATS).collect())
    sums = lambda kind, n: [sum(r["numbers"][k] for r in sides if r["kind"] == kind) for k in range(n)]
    _, *pair_counts = sums("pairs", 6)
    total, *word_counts = sums("sides", 6)
    word_discounts = discounts(word_counts)
    rest = float(word_discounts[1:] @ np.array([word_counts[0], word_counts[1], word_counts[4]])) / total if total else 1.0
    of = lambda rows, kind: sorted(r["bucket"] for r in rows if r["kind"] == kind)
    filled = {"word": of(words, "words"), "pair": of(sides, "pairs"), "big": of(sides, "pairs"), "side": of(sides, "sides")}
    wide = {r["bucket"]: r["numbers"][6] for r in sides if r["kind"] == "sides"}
    return KneserNey(uri, buckets, hot_words.tolist(), tokens, vocabulary, wide, discounts(pair_counts), word_discounts, total, rest, filled)


def model_scores(docs: DataFrame, of: int = 7, skip: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every row, by a model of the rows whose crc32 remainder is not ``skip``."""
    held = docs.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), of) == skip, F.lit(False)))
    model = learn(held.where("NOT held_out"))

    def score(texts: list[str | None]) -> list:
        columns: list[list] = [[], [], [], [], []]
        group: list[np.ndarray] = []

        def flush() -> None:
            n, known, base, own = model.score(group)
            for c, x in zip(columns, (n, known, np.full(len(n), model.tokens), base, own), strict=True):
                c.extend(x.tolist())
            group.clear()

        size = 0
        for words in word_hashes(texts):
            group.append(words)
            size += len(words) + 1
            if size >= SCORE_TOKENS:
                flush()
                size = 0
        if group:
            flush()
        return columns

    return with_computed(held, ["doc_id", "held_out"], "text", score, "n_tokens long, n_known long, train_tokens long, base_score double, score double")
