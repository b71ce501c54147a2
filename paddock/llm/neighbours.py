"""Approximate nearest neighbours by learned partitions.

1. A neighbour graph is built over a hash sample of at most about ``SAMPLE``
   vectors and cut into balanced parts: principal-axis bisection first, then
   rounds in which vertices move to the part of most of their neighbours while
   the parts' capacities allow.
2. A small classifier (one hidden layer) learns to tell from a vector how its
   neighbours are spread over the parts.
3. Every row is put in its most probable part.  A query is routed to its most
   probable parts and reranked there by exact distances on the original
   vectors.  How many parts are visited is measured on held-out vectors of the
   sample: the fewest with a recall of at least ``TARGET``.

The number of parts grows with the root of the rows.  Beyond ``MAX_PARTS`` each part
is cut again by a router of its own, learnt from a sample of its rows in one task a
part; a query then visits the most probable inner parts of its most probable parts.

Every row is indexed.  A part of any size is cut into blocks of at most about
``ROWS`` rows and ``QUERIES`` queries, so a vector that a third of the rows
share only makes more blocks; nothing is capped.

Defined cases: vectors that are NULL, zero, of another length than the most
frequent one, or hold NULL, NaN or infinite components take no part.  Ties go
to the smaller id.  Rows with the query's own id are no candidates.  A query id
that occurs more than once asks with its smallest vector.  Fewer than k
candidates: all of them.  Few rows: one part, hence exact.  Empty: empty.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.common import stored, unit_hash, with_computed

SAMPLE = 8_192
INNER_SAMPLE = 8_192
HELD_OUT = 512
TARGET = 0.94
NEAR = 12
HIDDEN, EPOCHS, BATCH, STEP = 128, 30, 256, 2e-3
MAX_PARTS = 256
ROWS, QUERIES = 16_384, 2_048


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the inner-product form (rounded; for choosing, not for results)."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k nearest other rows, in blocks."""
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 512):
        d = distances(x[at:at + 512], x)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out[at:at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1) -> np.ndarray:
    """A part for each row of the sample."""
    part = np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        part[rows] = first
        if n > 1:
            centred = x[rows] - x[rows].mean(0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = rows[np.argsort(centred @ axis, kind="stable")]
            cut = len(order) * (n // 2) // n
            todo += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    size = np.bincount(part, minlength=parts)
    room = int(np.ceil(slack * len(x) / parts))
    rows = np.arange(len(x))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), dtype=np.int32)
        np.add.at(votes, (np.repeat(rows, graph.shape[1]), part[graph].ravel()), 1)
        best = votes.argmax(1)
        gain = votes[rows, best] - votes[rows, part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """Classifier from vectors to parts; ``probes``: how many parts a query visits."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, ((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def parts(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x).argmax(1)


def train(x: np.ndarray, goal: np.ndarray, seed: int = 3) -> Router:
    """Adam steps on the cross entropy with the neighbours' parts as soft goals."""
    rng = np.random.default_rng(seed)
    r = Router(x.mean(0), float(x.std()) or 1.0, rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
               rng.normal(0, (2 / HIDDEN) ** 0.5, (HIDDEN, goal.shape[1])), np.zeros(goal.shape[1]))
    z = (x - r.mean) / r.scale
    weights = [r.w1, r.b1, r.w2, r.b2]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            b = order[at:at + BATCH]
            hidden = np.maximum(0, z[b] @ r.w1 + r.b1)
            out = hidden @ r.w2 + r.b2
            p = np.exp(out - out.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - goal[b]) / len(b)
            back = (g @ r.w2.T) * (hidden > 0)
            t += 1
            for w, m, v, grad in zip(weights, first, second, (z[b].T @ back, back.sum(0), hidden.T @ g, g.sum(0)), strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                w -= STEP * (1 - epoch / EPOCHS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return r


def learn_router(x: np.ndarray, parts: int, k: int, target: float = TARGET) -> Router:
    """From sampled vectors; the number of probes is measured on rows that the training leaves out."""
    held = min(HELD_OUT, len(x) // 8)
    test, base = x[:held], x[held:]
    graph = neighbour_graph(base, min(NEAR, len(base) - 1))
    part = balanced_parts(base, graph, parts)
    goal = np.zeros((len(base), parts))
    near = np.c_[np.arange(len(base)), graph]
    np.add.at(goal, (np.repeat(np.arange(len(base)), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    router = train(base, goal)
    placed = router.parts(base)
    wanted = placed[np.argpartition(distances(test, base), k - 1, axis=1)[:, :k]]
    scores = router.scores(test)
    rank = np.empty_like(scores, dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-scores, axis=1, kind="stable"), np.arange(parts)[None, :], axis=1)
    need = np.take_along_axis(rank, wanted, axis=1)
    router.probes = next(p for p in range(1, parts + 1) if (need < p).mean() >= target)
    return router


def _usable(vector: Column) -> Column:
    number = vector.cast("array<double>")
    return F.when(~F.exists(number, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(number, lambda c: c != 0), number)


def _search(k: int):
    """The k nearest of a block of rows for each of a block of queries."""

    def nearest(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(asked):
            x, ids = np.stack(rows["vec"]), rows["vec_id"].to_numpy()
            q = np.stack(asked["vec"])
            spread = (x * x).sum(1).max()
            for at in range(0, len(q), 64):
                d = distances(q[at:at + 64], x)
                for i, qid in enumerate(asked["query_id"].iloc[at:at + 64]):
                    own = ids == qid
                    line = np.where(own, np.inf, d[i])
                    n = min(k, len(x) - int(own.sum()))
                    if not n:
                        continue
                    # What rounding could have kept out of the first n is measured exactly too.
                    far = np.partition(line, n - 1)[n - 1] + 1e-9 * (spread + (q[at + i] ** 2).sum())
                    near = np.flatnonzero(line <= far)
                    exact = np.sqrt(((x[near] - q[at + i]) ** 2).sum(1))
                    order = np.lexsort((ids[near], exact))[:n]
                    found += zip([qid] * n, ids[near][order], exact[order], strict=True)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return nearest


def inner_routers(placed: DataFrame, inner: int, k: int, target: float) -> dict[int, Router | None]:
    """A router for each part, learnt in Spark from about ``INNER_SAMPLE`` of its rows; None for small parts.

    What the driver gets is bounded by MAX_PARTS * HIDDEN * (dimension + inner) numbers."""
    rows = placed.groupBy("part").count()
    drawn = placed.join(F.broadcast(rows), "part").where(F.rand(5) < INNER_SAMPLE / F.col("count")).select("part", "vec_id", "vec")

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.iloc[np.argsort([hash_order(i) for i in group["vec_id"]], kind="stable")]
        x = np.stack(group["vec"])
        router = learn_router(x, inner, k, target) if len(x) > max(64 * k, 8 * inner) else None
        return pd.DataFrame({"part": [group["part"].iloc[0]], "router": [pickle.dumps(router)]})

    return {r["part"]: pickle.loads(r["router"]) for r in drawn.groupBy("part").applyInPandas(learn, "part int, router binary").collect()}


def cut_again(placed: DataFrame, routed: DataFrame, inner: int, k: int, target: float) -> tuple[DataFrame, DataFrame]:
    """Every part cut in ``inner`` parts by a router of its own: number part * inner + the part within."""
    routers = inner_routers(placed, inner, k, target)

    def within(part: pd.Series, vec: pd.Series, choose) -> list:
        out: list = [None] * len(part)
        for p in part.unique():
            at = np.flatnonzero(part.to_numpy() == p)
            router = routers.get(int(p))
            chosen = choose(router, np.stack(vec.iloc[at])) if router else [[0]] * len(at)
            for i, c in zip(at, chosen, strict=True):
                out[i] = [int(p) * inner + int(x) for x in c]
        return out

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = within(b["part"], b["vec"], lambda r, x: r.parts(x)[:, None])
            yield b.assign(part=np.array([p[0] for p in parts], dtype=np.int32))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = within(b["part"], b["vec"], lambda r, x: np.argsort(-r.scores(x), axis=1, kind="stable")[:, :r.probes])
            yield b.assign(part=pd.Series(parts, index=b.index)).explode("part").astype({"part": "int32"})

    return stored(placed.mapInPandas(place, placed.schema), "placed-again"), stored(routed.mapInPandas(route, routed.schema), "routed-again")


def nearest_vectors(vectors: DataFrame, queries: Column, k: int = 10, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for the rows where
    ``queries`` holds.  ``vectors``: vec_id, embedding."""
    rows = vectors.select("vec_id", _usable(F.col("embedding")).alias("vec"), queries.alias("asks")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    total = lengths["count"] if lengths else 0
    rows = rows.where(F.size("vec") == (lengths["d"] if lengths else 0))
    # About SAMPLE vectors come to the driver, at most twice as many where ids repeat.
    got = rows.where(unit_hash(F.col("vec_id"), seed=3) < sample / max(1, total)).select("vec_id", "vec").limit(2 * sample).toPandas()
    x = np.stack(got["vec"])[np.argsort([hash_order(i) for i in got["vec_id"]], kind="stable")] if len(got) else np.zeros((0, 1))
    wanted = max(1, round(total**0.5 / 4))
    parts = min(wanted, MAX_PARTS)
    inner = -(-wanted // parts)
    # With two levels a neighbour must be found by both.
    target = TARGET if inner == 1 else TARGET**0.5
    router = learn_router(x, parts, k, target) if parts > 1 and len(x) > 64 * k else None
    probes = router.probes if router else 1

    def place(batch: list) -> list:
        if not router or not batch:
            return [[0] * len(batch)]
        return [router.parts(np.array(batch)).tolist()]

    def route(batch: list) -> list:
        if not router or not batch:
            return [[[0]] * len(batch)]
        return [np.argsort(-router.scores(np.array(batch)), axis=1, kind="stable")[:, :probes].tolist()]

    placed = with_computed(rows.select("vec_id", "vec"), ["vec_id", "vec"], "vec", place, "part int")
    asked = rows.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
    routed = with_computed(asked, ["query_id", "vec"], "vec", route, "parts array<int>").select("query_id", "vec", F.explode("parts").alias("part"))
    placed, routed = stored(placed, "placed"), stored(routed, "routed")
    if router and inner > 1:
        placed, routed = cut_again(placed, routed, inner, k, target)
    # One row for each part (about a quarter of the root of the rows).
    blocks = placed.groupBy("part").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("rblocks")).join(
        routed.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qblocks")), "part")
    blocks = F.broadcast(stored(blocks, "blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, name: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    keys = ["part", "rblock", "qblock"]
    left = placed.join(blocks, "part").withColumn("rblock", own("rblocks", "vec_id")).withColumn("qblock", every("qblocks")).select(*keys, "vec_id", "vec")
    right = routed.join(blocks, "part").withColumn("qblock", own("qblocks", "query_id")).withColumn("rblock", every("rblocks")).select(*keys, "query_id", "vec")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def hash_order(i: int) -> int:
    """An order of ids that is unrelated to their size."""
    return (int(i) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) >> 16
