"""Vector codes by product quantisation, assigned over tries of distinct parts.

Components become whole numbers, ``floor(4096 x)``; vectors are cut into equal
consecutive parts, and each part position has a codebook that starts as that
part of the first vectors and is refined by rounds of assigning every part to
its nearest entry and replacing entries by floored means.

Parts are assigned over a lexicographic trie of the distinct ones.  A part's
distances to all entries are sums over its components, so equal prefixes have
equal partial sums: a depth-first traversal carries the vector of partial sums
(one number an entry) from a node to its children, and the leaves take the
argmin and add their parts, times how often they occur, to their entry's sums.
Sorted parts are the trie: a node is a run of rows with a common prefix.  A run
of at most ``LEAVES`` rows is finished at once, one depth after another, all its
nodes of a depth together.

Scale: distinct parts are counted by Spark (partial counts first, so a vector
that a third of the rows share is one row a task), sorted within their hash
partition, packed into trie blocks and stored once; each round reads those
blocks and returns one sum for each position, entry and component.  Codes and
errors come from a narrow pass over the vectors.  The driver holds codebooks
only.  Error sums by label are pre-aggregated; they are broadcast while there
are at most ``MAX_LABELS`` labels, else the labels of over 1/2000 of the rows are
broadcast and the rest joined by shuffle.

Defined cases: vectors that are NULL or hold NULL, NaN or infinite components
are dropped, and so are those whose length is 0, no multiple of the number of
parts, or not the most frequent such length (ties: the longer).  Numbers beyond
2**26 raise, since errors would not fit 64 bits.  Fewer vectors than entries
give fewer entries.  The first vectors are those of the smallest ids; NULL ids
come last, equal ids in order of their numbers.  Entries without parts stay as
they are; ties go to the lower entry.  Repeated rows are coded one by one, NULL
labels are one label, empty tables give an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paddock.llm.common import stored

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
LARGEST = 1 << 26
LEAVES = 8_192
BLOCK = 65_536
MAX_LABELS = 500_000


def whole_numbers(vectors: DataFrame, column: str, parts: int) -> DataFrame:
    """The kept rows with ``numbers`` (array of long) in place of the vector column."""
    x = F.col(column)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(x.isNotNull()).where((F.size(x) > 0) & (F.size(x) % parts == 0) & sound)
    lengths = kept.groupBy(F.size(x).alias("n")).agg(F.count("*").alias("rows"))
    length = lengths.orderBy(F.col("rows").desc(), F.col("n").desc()).first()
    if length is None:
        return kept.select("*", F.lit(None).cast("array<bigint>").alias("numbers")).drop(column)
    fits = F.transform(x, lambda v: F.when(
        F.abs(v.cast("double")) <= LARGEST / SCALE, F.floor(v.cast("double") * float(SCALE))
    ).otherwise(F.raise_error(F.lit("vector components are too large for 64-bit errors")).cast("bigint")))
    return kept.where(F.size(x) == length["n"]).select("*", fits.alias("numbers")).drop(column)


def matrix(column: pa.ListArray) -> np.ndarray:
    """The rows of an array column as a matrix of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


class Trie:
    """Distinct parts in lexicographic order: each run of rows with a common prefix is a node."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        n, depth = rows.shape
        # new[d]: the rows where a prefix of d + 1 components begins.
        differs = np.ones((n, depth), dtype=bool)
        if n:
            differs[1:] = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
        self.new = differs

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every row."""
        code = np.empty(len(self.rows), dtype=np.int64)
        error = np.empty(len(self.rows), dtype=np.int64)
        depth = self.rows.shape[1]
        # Nodes yet to be walked, the leftmost on top: rows, depth, partial sums of the common prefix.
        stack = [(0, len(self.rows), 0, np.zeros(len(entries), dtype=np.int64))]
        while stack:
            low, high, d, sums = stack.pop()
            if high - low <= LEAVES or d == depth:
                at = self.leaves(low, high, d, sums, entries)
                code[low:high] = at.argmin(axis=1)
                error[low:high] = at[np.arange(high - low), code[low:high]]
                continue
            begins = low + np.flatnonzero(self.new[low:high, d])
            begins[0] = low
            ends = np.r_[begins[1:], high]
            below, first = [], 0
            while first < len(begins):
                # Small children are walked together from this node, a large one by itself.
                last = max(first + 1, int(np.searchsorted(ends, begins[first] + LEAVES, "right")))
                if last > first + 1 or ends[first] - begins[first] <= LEAVES:
                    below.append((begins[first], ends[last - 1], d, sums))
                else:
                    below.append((begins[first], ends[first], d + 1, sums + (self.rows[begins[first], d] - entries[:, d]) ** 2))
                first = last
            stack += reversed(below)
        return code, error

    def leaves(self, low: int, high: int, d: int, sums: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Distances of the rows low..high, whose first d components are common and summed up in ``sums``."""
        rows, new = self.rows[low:high], self.new[low:high]
        node = np.zeros(high - low, dtype=np.int64)         # the node of each row at the depth above
        at = sums[None, :]
        for k in range(d, rows.shape[1]):
            begins = new[:, k].copy()
            begins[:1] = True
            first = np.flatnonzero(begins)
            at = at[node[first]] + (rows[first, k][:, None] - entries[:, k]) ** 2
            node = np.cumsum(begins) - 1
        return at[node]


def sorted_distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and where each row stands among them."""
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    place = np.empty(len(rows), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def trie_blocks(numbers: DataFrame, parts: int) -> DataFrame:
    """(position, width, values, weights): blocks of sorted distinct parts and how often each occurs, stored."""
    width = F.size("numbers") / parts
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice("numbers", (k * width + 1).cast("int"), width.cast("int")))
    counted = numbers.select(F.posexplode(cut).alias("position", "part")).groupBy("position", "part").agg(F.count("*").alias("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            where, rows, n = (np.concatenate(x) for x in zip(*held, strict=True))
            for p in np.unique(where):
                mine = where == p
                yield pa.RecordBatch.from_pydict({
                    "position": pa.array([int(p)], pa.int32()), "width": pa.array([rows.shape[1]], pa.int32()),
                    "values": pa.array([rows[mine].astype("<i4").tobytes()], pa.binary()),
                    "weights": pa.array([n[mine].astype("<i8").tobytes()], pa.binary())})

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("position").to_numpy(), matrix(batch.column("part")), batch.column("n").to_numpy()))
            if sum(len(n) for _, _, n in held) >= BLOCK:
                yield from blocks()
                held = []
        if held:
            yield from blocks()

    packed = counted.sortWithinPartitions("position", "part").mapInArrow(pack, "position int, width int, values binary, weights binary")
    return stored(packed, "tries")


def refined(tries: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: every part to its nearest entry, entries to floored means."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in books]
        for batch in batches:
            for p, width, values, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = np.frombuffer(values, "<i4").reshape(-1, width).astype(np.int64)
                n = np.frombuffer(weights, "<i8")
                code, _ = Trie(rows).nearest(books[p])
                np.add.at(sums[p], code, np.column_stack([rows * n[:, None], n]))
        for p, s in enumerate(sums):
            used = np.flatnonzero(s[:, -1])
            yield pa.RecordBatch.from_pydict({
                "position": pa.array(np.full(len(used), p, np.int32)), "entry": pa.array(used.astype(np.int32)),
                "total": pa.array(list(s[used]), pa.list_(pa.int64()))})

    each = tries.mapInArrow(tally, "position int, entry int, total array<bigint>")
    added = each.select("position", "entry", F.posexplode("total").alias("k", "x")).groupBy("position", "entry", "k").agg(F.sum("x").alias("x"))
    totals: dict[tuple[int, int], dict[int, int]] = {}
    for row in added.collect():             # a number for each entry and component
        totals.setdefault((row["position"], row["entry"]), {})[row["k"]] = row["x"]
    out = [b.copy() for b in books]
    for (p, e), total in totals.items():
        width = out[p].shape[1]
        out[p][e] = [total[k] // total[width] for k in range(width)]
    return out


def fit_codebooks(numbers: DataFrame, id_column: str, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """A codebook for each part position."""
    first = numbers.select(id_column, "numbers").orderBy(F.col(id_column).asc_nulls_last(), "numbers").limit(entries).collect()
    start = np.array([r["numbers"] for r in first], dtype=np.int64)
    books = np.split(start, parts, axis=1)
    if rounds:
        tries = trie_blocks(numbers.select("numbers"), parts)
        for _ in range(rounds):
            books = refined(tries, books)
    return books


def coded_rows(numbers: DataFrame, keep: list[str], books: list[np.ndarray]) -> DataFrame:
    """``keep`` columns, code and error of every row: one trie a position over a batch's distinct parts."""
    width = books[0].shape[1]
    schema = StructType([numbers.schema[k] for k in keep]).add("code", "string").add("error", "long")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column("numbers"))
            codes = np.empty((len(rows), len(books)), dtype=np.uint8)
            error = np.zeros(len(rows), dtype=np.int64)
            for p, entries in enumerate(books):
                distinct, place = sorted_distinct(rows[:, p * width:(p + 1) * width])
                near, far = Trie(distinct).nearest(entries)
                codes[:, p] = near[place]
                error += far[place]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=schema.names)

    return numbers.select(*keep, "numbers").mapInArrow(code, schema)


def with_label_sums(coded: DataFrame, label: str, value: str, name: str) -> DataFrame:
    """``coded`` with ``name``: the sum of ``value`` over the rows of equal ``label``, NULLs together."""
    sums = coded.groupBy(F.col(label).alias("__label")).agg(F.sum(value).alias(name), F.count("*").alias("__n"))
    labels, rows = sums.agg(F.count("*"), F.sum("__n")).first()
    same = F.col(label).eqNullSafe(F.col("__label"))
    columns = [*coded.columns, name]
    if labels <= MAX_LABELS:
        return coded.join(F.broadcast(sums), same).select(*columns)
    frequent = F.col("__n") > rows // 2000          # fewer than 2000 labels
    hot = F.broadcast(sums.where(frequent))
    some = coded.join(hot, same).select(*columns)
    rest = coded.join(hot, same, "left_anti").join(sums.where(~frequent), same).select(*columns)
    return some.unionByName(rest)


def vector_codes(vectors: DataFrame, *, vector: str = "embedding", id_column: str = "vec_id", label: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code (two hexadecimal digits a part), error, label_error, codebooks_sha256 for every kept vector.

    ``entries`` is at most 256."""
    numbers = whole_numbers(vectors.select(id_column, label, vector), vector, parts)
    if not numbers.take(1):
        return numbers.select(id_column, *(F.lit(None).cast(t).alias(c) for c, t in (
            ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")))).limit(0)
    books = fit_codebooks(numbers, id_column, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    coded = stored(coded_rows(numbers, [id_column, label], books), "codes")
    summed = with_label_sums(coded, label, "error", "label_error")
    return summed.select(id_column, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
