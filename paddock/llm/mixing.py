"""Mixing sources to target weights by Poisson replication.

Source s with target share w_s and present share p_s gets the mean repetition
rate ``w_s / p_s * size``.  Each document's number of copies is the inverse of
the Poisson distribution function at a number in [0, 1) made from md5 of seed
and doc_id, so it depends on no order, partition or run.  Documents are
exploded by their counts and shuffled globally: copies are dealt to partitions
by one part of a hash of (seed, doc_id, copy) and sorted in them by another.

All in DataFrame operations.  Counts by source are pre-aggregated and stored,
so documents are read twice.  The sources' distribution tables are broadcast
while they are at most ``MAX_BYTES``; beyond that only those of the most frequent
sources are, and the others are joined by shuffle.

Defined cases: a NULL source is a source of its own.  A source without a target
weight gets none (0 copies); targets default to equal shares.  Repeated rows
(the same doc_id) get equal counts.  A NULL doc_id counts as the text ''.
Empty tables give an empty result.  The input's columns pass unchanged under
any names; one with the name of an added column (``copy``, ``order``) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import fresh, named, shuffle_parts, stored

MAX_BYTES = 32 << 20
PART = 400.0


def md5_number(text: Column, first: int = 1, digits: int = 12) -> Column:
    """Hexadecimal digits of md5, as a whole number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), first, digits), 16, 10).cast("long")


def poisson_table(rate: Column) -> Column:
    """Distribution function of a Poisson at 0, 1, ... far into its tail (rate at most PART)."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), (rate + 12 * F.sqrt(rate) + 20).cast("int")), start, add, lambda s: s["cdf"])


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None, size: float) -> DataFrame:
    """(source, n, rate, parts, cdf): mean repetitions of each source's documents, which are counted once.

    A Poisson is the sum of independent ones: rates over PART are cut into
    ``parts`` equal parts, and cdf is that of one part."""
    counts = stored(docs.groupBy("source").agg(F.count("*").alias("n")), "sources")
    total, sources = counts.agg(F.sum("n"), F.count("*")).first()
    if weights is None:
        share = F.lit(1.0 / max(1, sources))
    else:
        whole = float(sum(weights.values()))
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(w / whole)).otherwise(share)
    rate = share * F.lit(float(total or 0)) * F.lit(float(size)) / F.col("n")
    rated = counts.select("source", "n", rate.alias("rate")).withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)))
    return rated.withColumn("cdf", poisson_table(F.col("rate") / F.col("parts")))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = 17, copy: str = "copy_no", order: str = "mix_key") -> DataFrame:
    """``docs`` repeated to the target weights, globally shuffled.

    ``weights``: target share by source (any scale; None: equal shares).
    ``size``: expected rows out per row in.  Adds ``copy`` (0, 1, ...) and
    ``order`` (the sort key of the global order)."""
    of, parts, cdf, many_of = fresh(docs, "rate_source", "rate_parts", "rate_cdf", "copies")
    rates = repetition_rates(docs, weights, size)
    small = rates.select(F.col("source").alias(of), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    same = F.col("source").eqNullSafe(F.col(of))
    size_of = F.size("cdf") * 8 + F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 32
    held, rows = rates.agg(F.sum(size_of), F.sum("n")).first()
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))

    def drawn(part: Column) -> Column:
        """How many values of the distribution function are at most this part's number."""
        u = md5_number(F.concat(F.lit(f"{seed}:"), name, F.lit("/"), part.cast("string"))) / float(1 << 48)
        return F.size(F.filter(cdf, lambda c: c <= u)).cast("long")

    copies = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1), F.lit(0).cast("long"), lambda total, part: total + drawn(part))
    kept = [named(c) for c in docs.columns if c not in (copy, order)]
    if (held or 0) <= MAX_BYTES:
        joined = docs.select(*kept).join(F.broadcast(small), same)
    else:
        # Sources of over 1/2000 of the rows, fewer than 2000, to all tasks; the others by shuffle.
        frequent = small.join(F.broadcast(rates.where(F.col("n") > rows // 2000).select("source")), same, "left_semi")
        rest = docs.select(*kept).join(F.broadcast(frequent), same, "left_anti").join(small, same)
        joined = docs.select(*kept).join(F.broadcast(frequent), same).unionByName(rest)
    joined = joined.withColumn(many_of, copies).where(F.col(many_of) > 0)
    many = joined.select(*kept, F.explode(F.sequence(F.lit(0).cast("long"), F.col(many_of) - 1)).alias(copy))
    key = F.concat(F.lit(f"{seed}:"), name, F.lit(":"), F.col(copy).cast("string"))
    keyed = many.withColumn(order, md5_number(key))
    return keyed.repartition(shuffle_parts(docs.sparkSession), order).sortWithinPartitions(order, "doc_id", copy)
