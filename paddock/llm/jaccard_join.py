"""Exact n-gram Jaccard join by set relations.

Documents are sets of distinct 5-word shingles; two link when
``100 * intersection >= 80 * union``.  The result is the connected component
of each document, exactly: no cap, no sampling of candidates.

1. *Shared shingles.*  Equal sets are one class.  A shingle of one class only
   can be in no intersection, so a class with fewer than 80 % shared shingles
   has no partner.  Tasks deal the shingles of a block of texts into hash
   buckets as packed arrays; a shingle that two classes of the block share is
   announced once (this is the map-side combine that keeps frequent shingles
   small), any other travels with its class.  Buckets return what is shared.
   Equal texts of a block count once; a class with over ``BUCKET_TOKENS`` shingles
   in all its copies is dealt by one row only (its smallest id hash).
2. *Index lists, skipped by position.*  Each remaining class puts the first
   ``s - ceil(0.8 n) + 1`` of its ``s`` shared shingles, rarest first, into
   index lists.  Lists are cut into blocks of set sizes 1.25 apart.  A class
   visits its own block, and the next one only if the shingles that follow its
   position suffice for the overlap that the smallest size there requires.
3. *Answers from a similar set.*  The most central class of a block is its hub
   and is compared with every member.  Members that link with it need no
   comparison with each other: their component is known.  Only members left
   outside the hub group's largest component are compared with the others,
   block by block, and a pair is skipped when the distances to the hub differ
   by more than 0.2 (Jaccard distance is a metric).

Nothing quadratic is emitted: a hub group of k classes gives k pairs, then at
most one link for each outside class and component.

Defined cases: NULL or wordless text: empty set, own component.  Repeated rows
link like copies.  NULL doc_id: it links, but is never the smallest id of a
component unless no other id is there (then component_id is NULL).  Other
columns are ignored.  An empty table gives an empty result.

Shingles are compared by hashes: 64 bits for whole sets, 40 bits and the
bucket within pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import fresh, named, shuffle_parts, stored, with_computed, with_totals
from paddock.llm.components import components
from paddock.llm.words import each_words, mix, packed, shingles, unpacked

BLOCK_TOKENS = 1_000_000
BUCKET_TOKENS = 1_000_000
MOST_COPIED = 1_000_000
LOW_BITS = np.uint64(40)
LOW_MASK = np.uint64((1 << 40) - 1)
MEMBERS, OUTSIDERS = 1024, 128
_PACKED = "bucket long, digest binary, size binary, count binary, low binary, high binary, shared binary"


def _digest(values: np.ndarray) -> int:
    """64 bits of a whole set; 0 is kept for announcements."""
    with np.errstate(over="ignore"):
        return int(mix(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(values)))[0]) or 1


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _sizes(texts: list[str | None]) -> list:
    found = [(len(s), _digest(s) if len(s) else 0) for s in map(shingles, each_words(texts))]
    digest = _signed(np.array([d for _, d in found], dtype=np.uint64)).tolist()
    return [[n for n, _ in found], [d if n else None for (n, _), d in zip(found, digest, strict=True)]]


def set_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest) for each row; digest is NULL for empty sets."""
    return with_computed(docs, ["doc_id"], "text", _sizes, "n long, digest long")


def _packed_row(bucket: int, digest: np.ndarray, size: np.ndarray, tokens: np.ndarray, shared: np.ndarray | None = None) -> tuple:
    """Tokens sorted by class, with the classes given once each."""
    first = np.flatnonzero(np.r_[True, digest[1:] != digest[:-1]]) if len(digest) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(digest)]).astype("<u4")
    return (bucket, packed(digest[first]), packed(size[first].astype("<u4")), packed(count), packed((tokens & np.uint64(0xFFFFFFFF)).astype("<u4")),
            packed((tokens >> np.uint64(32)).astype("<u4")) if shared is None else packed((tokens >> np.uint64(32)).astype("<u1")), packed(shared) if shared is not None else None)


_COLUMNS = ["bucket", "digest", "size", "count", "low", "high", "shared"]


def _read_rows(rows: pd.DataFrame, high: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """class, size and token of all entries of packed rows."""
    cat = lambda name, kind: np.concatenate([unpacked(x, kind) for x in rows[name]]) if len(rows) else np.zeros(0, kind)
    count = cat("count", "<u4")
    return (np.repeat(cat("digest", "<u8"), count), np.repeat(cat("size", "<u4"), count),
            cat("low", "<u4").astype(np.uint64) | (cat("high", high).astype(np.uint64) << np.uint64(32)))


def _dealer(buckets: int, copied: np.ndarray, speaker: np.ndarray):
    """Deals the shingles of blocks of texts to buckets.

    ``copied``: sorted digests of classes with so many copies that only the rows
    with the id hash in ``speaker`` deal; others deal once a block."""

    def flush(sets: dict[int, np.ndarray]) -> pd.DataFrame:
        digests = np.fromiter(sets.keys(), np.uint64, len(sets))
        sizes = np.fromiter((len(s) for s in sets.values()), np.uint32, len(sets))
        token = np.concatenate(list(sets.values()))
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        key = ((token >> LOW_BITS) % np.uint64(buckets) << LOW_BITS) | (token & LOW_MASK)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        new = np.r_[True, key[1:] != key[:-1]]
        run = np.diff(np.r_[np.flatnonzero(new), len(key)])
        many = np.repeat(run > 1, run)
        announced = key[new][run > 1]
        bucket = (key >> LOW_BITS).astype(np.int64)
        rows = []
        alone = np.flatnonzero(~many)
        alone = alone[np.lexsort((owner[alone], bucket[alone]))]
        at = np.searchsorted(bucket[alone], np.arange(buckets + 1))
        said = np.searchsorted(announced >> LOW_BITS, np.arange(buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero((np.diff(at) > 0) | (np.diff(said) > 0)):
            mine = alone[at[b]:at[b + 1]]
            rows.append(_packed_row(int(b), digests[owner[mine]], sizes[owner[mine]], key[mine] & LOW_MASK, announced[said[b]:said[b + 1]] & LOW_MASK))
        # Shared within this block: back to the class, through its own bucket.
        both = np.flatnonzero(many)
        home = (digests[owner[both]] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((owner[both], home))
        both, home = both[order], home[order]
        at = np.searchsorted(home, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(at)):
            mine = both[at[b]:at[b + 1]]
            rows.append(_packed_row(-1 - int(b), digests[owner[mine]], sizes[owner[mine]], key[mine]))
        return pd.DataFrame(rows, columns=_COLUMNS)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        tokens = 0
        for batch in batches:
            for words, name in zip(each_words(batch["text"].tolist()), batch["id_hash"].tolist(), strict=True):
                if len(words):
                    values = shingles(words)
                    digest = _digest(values)
                    at = int(np.searchsorted(copied, np.uint64(digest)))
                    if at < len(copied) and int(copied[at]) == digest and speaker[at] != name:
                        continue
                    if held.setdefault(digest, values) is values:
                        tokens += len(values)
                if tokens >= BLOCK_TOKENS:
                    yield flush(held)
                    held, tokens = {}, 0
        if held:
            yield flush(held)

    return deal


def _returner(buckets: int):
    """A bucket's shingles that two classes share, dealt back to the classes."""

    def back(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        if bucket < 0:
            return rows
        digest, size, low = _read_rows(rows, "<u1")
        announced = np.unique(np.concatenate([unpacked(x) for x in rows["shared"]]))
        order = np.lexsort((digest, low))
        digest, size, low = digest[order], size[order], low[order]
        if len(low):
            new = np.r_[True, low[1:] != low[:-1]]
            begin = np.flatnonzero(new)
            end = np.r_[begin[1:], len(low)] - 1
            two = digest[begin] != digest[end]
            if len(announced):
                at = np.minimum(np.searchsorted(announced, low[begin]), len(announced) - 1)
                two |= announced[at] == low[begin]
            first = np.r_[True, (low[1:] != low[:-1]) | (digest[1:] != digest[:-1])]
            keep = np.flatnonzero(np.repeat(two, end - begin + 1) & first)
            digest, size, low = digest[keep], size[keep], low[keep]
        home = (digest % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((digest, home))
        digest, size, low, home = digest[order], size[order], low[order], home[order]
        at = np.searchsorted(home, np.arange(buckets + 1))
        token = low | (np.uint64(bucket) << LOW_BITS)
        return pd.DataFrame([_packed_row(-1 - int(b), digest[at[b]:at[b + 1]], size[at[b]:at[b + 1]], token[at[b]:at[b + 1]])
                             for b in np.flatnonzero(np.diff(at))], columns=_COLUMNS)

    return back


def _gather(percent: int):
    """Classes whose shared shingles can reach the bound, with those shingles."""

    def classes(rows: pd.DataFrame) -> pd.DataFrame:
        digest, size, token = _read_rows(rows, "<u4")
        order = np.lexsort((token, digest))
        digest, size, token = digest[order], size[order], token[order]
        keep = np.r_[True, (digest[1:] != digest[:-1]) | (token[1:] != token[:-1])]
        digest, size, token = digest[keep], size[keep], token[keep]
        begin = np.flatnonzero(np.r_[True, digest[1:] != digest[:-1]])
        count = np.diff(np.r_[begin, len(digest)])
        good = np.flatnonzero(100 * count >= percent * size[begin].astype(np.int64))
        return pd.DataFrame({"digest": _signed(digest[begin[good]]), "n": size[begin[good]].astype(np.int64),
                             "tokens": pd.Series([_signed(token[begin[g]:begin[g] + count[g]]) for g in good], dtype=object)})

    return classes


def candidate_sets(docs: DataFrame, percent: int, buckets: int, copied: list[tuple[int, int]] = ()) -> DataFrame:
    """(digest, n, tokens): classes with enough shared shingles, and those.

    ``copied``: digest and id hash of the speaker of classes with many copies."""
    speakers = sorted((d % (1 << 64), name) for d, name in copied)
    digests = np.array([d for d, _ in speakers], dtype=np.uint64)
    names = np.array([name for _, name in speakers], dtype=np.int64)
    dealt = docs.select("text", F.xxhash64("doc_id").alias("id_hash")).mapInPandas(_dealer(buckets, digests, names), _PACKED)
    back = dealt.groupBy("bucket").applyInPandas(_returner(buckets), _PACKED)
    return back.groupBy("bucket").applyInPandas(_gather(percent), "digest long, n long, tokens array<long>")


def _hub_members(sets: DataFrame, percent: int) -> DataFrame:
    """(hub, digest): distinct pairs of a list block's hub and its members."""
    flat = sets.select("digest", "n", F.explode("tokens").alias("token"))
    frequency = flat.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = flat.join(frequency, "token").groupBy("digest", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"),
        (F.sum(F.log2("df")) / F.first("n")).alias("central"))
    # A set of n needs an overlap of at least ceil(percent * n / 100).
    need = F.expr(f"({percent} * n + 99) div 100")
    step = math.log(100 / percent)
    postings = (
        ranked.withColumn("s", F.size("ranked")).withColumn("need", need).where("s >= need")
        .select("digest", "n", "s", "central", F.posexplode(F.slice("ranked", F.lit(1), (F.col("s") - F.col("need") + 1).cast("int"))).alias("at", "entry"))
        .withColumn("token", F.col("entry.token"))
        # Overlap from this position on is at most s - at; a partner of m needs percent * (n + m) / (100 + percent).
        .withColumn("reach", F.expr(f"(s - at) * {100 + percent} div {percent} - n"))
        .withColumn("band", F.floor(F.log(F.col("n")) / step + 1e-9))
        .withColumn("edge", F.floor(F.exp((F.col("band") + 1) * step) - 1e-6))
        .select("digest", "central", "token", F.explode(F.when(F.col("reach") >= F.col("edge"), F.array("band", F.col("band") + 1)).otherwise(F.array("band"))).alias("block"))
    )
    blocks = postings.groupBy("token", "block").agg(F.count("*").alias("k"), F.max(F.struct("central", "digest")).alias("top")).where("k > 1")
    return postings.join(blocks.select("token", "block", F.col("top.digest").alias("hub")), ["token", "block"]).select("hub", "digest").distinct()


def _compare(percent: int):
    """Outside classes of a hub group against a block of its members."""

    def links(key: tuple, members: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(members) and len(outside):
            sizes = members["n"].to_numpy()
            lengths = np.array([len(t) for t in members["tokens"]])
            tokens = np.concatenate([np.asarray(t, dtype=np.int64) for t in members["tokens"]])
            start = np.r_[0, np.cumsum(lengths)[:-1]]
            far, root, ids = members["far"].to_numpy(), members["root"].to_numpy(), members["digest"].to_numpy()
            for x in outside.itertuples():
                near = (np.abs(far - x.far) <= (100 - percent) / 100 + 1e-9) & (root != x.root)
                near &= (100 * np.minimum(sizes, x.n) >= percent * np.maximum(sizes, x.n)) & (lengths > 0)
                if not near.any():
                    continue
                mine = np.sort(np.asarray(x.tokens, dtype=np.int64))
                at = np.minimum(np.searchsorted(mine, tokens), len(mine) - 1)
                overlap = np.add.reduceat((mine[at] == tokens).astype(np.int64), start)
                hit = np.flatnonzero(near & (100 * overlap >= percent * (sizes + x.n - overlap)))
                found += [(x.digest, ids[hit[k]]) for k in np.unique(root[hit], return_index=True)[1]]
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return links


def similar_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) over the classes in ``sets`` that link with another."""
    pairs = _hub_members(sets, percent)
    hubs = sets.select(F.col("digest").alias("hub"), F.col("n").alias("hub_n"), F.col("tokens").alias("hub_tokens"))
    shared = F.size(F.array_intersect("tokens", "hub_tokens"))
    compared = stored(
        pairs.join(sets, "digest").join(hubs, "hub").withColumn("shared", shared)
        .select("hub", "digest", "n", (F.col("n") + F.col("hub_n") - F.col("shared")).alias("all"), "shared"), "compared")
    linked = compared.where(f"100 * shared >= {percent} * all AND hub != digest").select(F.col("hub").alias("u"), F.col("digest").alias("v"))
    first = components(linked)
    members = (
        compared.join(first, compared["digest"] == first["node"], "left")
        .select("hub", "digest", "n", (1 - F.col("shared") / F.col("all")).alias("far"), F.coalesce("root", "digest").alias("root")))
    by_root = members.groupBy("hub", "root").agg(F.count("*").alias("k"))
    groups = by_root.groupBy("hub").agg(F.sum("k").alias("k"), F.count("*").alias("roots"), F.max(F.struct("k", "root")).alias("main")).where("roots > 1 AND k > 2")
    groups = groups.select("hub", F.col("main.root").alias("main"), F.ceil(F.col("k") / MEMBERS).alias("mblocks"), F.ceil((F.col("k") - F.col("main.k")) / OUTSIDERS).alias("oblocks"))
    open_members = stored(members.join(groups, "hub"), "open-groups")
    if open_members.isEmpty():
        return first
    with_tokens = open_members.join(sets.select("digest", "tokens"), "digest")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("digest"), F.col(n))
    shape = ["hub", "mblock", "oblock", "digest", "n", "far", "root", "tokens"]
    left = with_tokens.withColumn("mblock", own("mblocks")).withColumn("oblock", every("oblocks")).select(*shape)
    right = with_tokens.where("root != main").withColumn("oblock", own("oblocks")).withColumn("mblock", every("mblocks")).select(*(F.col(c).alias(f"{c}_") for c in shape)).toDF(*shape)
    rest = left.groupBy("hub", "mblock", "oblock").cogroup(right.groupBy("hub", "mblock", "oblock")).applyInPandas(_compare(percent), "u long, v long")
    rest = stored(rest.distinct(), "rest")
    if rest.isEmpty():
        return first
    return components(linked.unionByName(rest))


def _answers(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, digest and root (one digest of the component; NULL without words) for every row."""
    spark = docs.sparkSession
    rows = stored(set_sizes(docs), "sets")
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffle_parts(spark), total // BUCKET_TOKENS + 1)
    worded = rows.where("n > 0")
    classes = stored(worded.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.min(F.xxhash64("doc_id")).alias("speaker")), "classes")
    # At most MOST_COPIED classes: each has over a MOST_COPIED-th of all shingles.
    heavy = classes.where(F.col("copies") * F.col("n") > max(BUCKET_TOKENS, total // MOST_COPIED))
    sets = stored(candidate_sets(docs, percent, int(buckets), [tuple(r) for r in heavy.select("digest", "speaker").collect()]), "candidates")
    roots = similar_sets(sets, percent)
    joined = roots.join(classes.select("digest", "first"), roots["node"] == classes["digest"]).select("digest", "first", "root")
    smallest = joined.groupBy("root").agg(F.min("first").alias("smallest"), F.count("*").alias("size"))
    linked = with_totals(joined.select("digest", "root"), smallest, "root", "size")
    answers = classes.join(linked, "digest", "left").select(
        "digest", F.coalesce("smallest", "first").alias("component_id"), F.coalesce("root", "digest").alias("root"), "copies")
    out = with_totals(worded, answers, "digest", "copies").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "digest", "root")
    wordless = rows.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("digest"), F.lit(None).cast("long").alias("root"))
    return out.unionByName(wordless)


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    ``percent``: the least similarity in hundredths."""
    return _answers(docs, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, percent: int = 80, max_broadcast: int = 4_000_000) -> DataFrame:
    """The documents without those whose component has a smaller id.

    A doc_id that repeats is judged row by row: of each component that it is the
    smallest id of, one row stays (the smallest set digest; any of equal ones), so
    different texts under one id do not displace each other.  Of the rows without
    doc_id one of each component stays, beside the smallest id.  Rows without words
    stay, once for a doc_id.  The ids to drop or to judge by row are broadcast while
    they are at most ``max_broadcast`` (16 MB a million); beyond that the join
    shuffles."""
    found = stored(_answers(docs, percent), "components")
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    drop = found.where("component_id != doc_id").select("doc_id").distinct()
    gone = stored(drop.withColumn("again", F.lit(False)).unionByName(again.withColumn("again", F.lit(True))), "gone")
    counts = {r["again"]: r["count"] for r in gone.groupBy("again").count().collect()}
    few = F.broadcast if sum(counts.values()) <= max_broadcast else lambda ids: ids
    kept = docs.join(few(gone.select("doc_id")), "doc_id", "left_anti")
    unnamed = not found.where("doc_id IS NULL").isEmpty()
    if not counts.get(True) and not unnamed:
        return kept.select(*map(named, docs.columns))
    repeated = few(gone.where("again").select("doc_id"))
    by_row = lambda rows: rows.join(repeated, "doc_id", "left_semi").select(*map(named, rows.columns)).unionByName(rows.where("doc_id IS NULL"))
    digest, of, digest_of = fresh(docs, "set_digest", "winner_of", "digest_of")
    winners = by_row(found).where("digest IS NOT NULL AND (doc_id IS NULL OR component_id = doc_id)").groupBy("root", "doc_id").agg(F.min("digest").alias(digest))
    winners = winners.select(F.col("doc_id").alias(of), F.col(digest).alias(digest_of))
    judged = with_computed(by_row(docs), docs.columns, "text", lambda texts: _sizes(texts)[1:], f"{digest} long")
    with_words = judged.join(winners, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(digest) == F.col(digest_of)), "left_semi").dropDuplicates(["doc_id", digest])
    wordless = judged.where(F.col(digest).isNull())
    stay = [with_words, wordless.where("doc_id IS NULL"), wordless.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])]
    out = kept.where("doc_id IS NOT NULL").select(*map(named, docs.columns))
    for rows in stay:
        out = out.unionByName(rows.select(*map(named, docs.columns)))
    return out
