"""Corpus pipeline: quality, near duplicates, decontamination, PII, mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``docs``.

Stages hold no state of their own: rows with NULLs, repeated rows, empty texts
and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paddock.llm.common import stored, table
from paddock.llm.decontaminate import without_contaminated
from paddock.llm.jaccard_join import one_of_each
from paddock.llm.mixing import mixed
from paddock.llm.pseudonyms import key_of, rewritten
from paddock.llm.quality import fit_quality, good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.7) go."""
    return good_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become pseudonyms, by the key of the session."""
    return rewritten(docs, key_of(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares for all sources; adds copy_no and mix_key."""
    return mixed(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

# Boosted trees, edit alignments and Feistel networks are not SQL: the tests
# compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    name, last = STAGES[-1]
    return last(spark, docs, sf_dir)
