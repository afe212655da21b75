"""The corpus pipeline: each stage works on all documents that the stage before kept."""

from emberlog.llm.common import table
from emberlog.llm.decontaminate import without_contaminated
from emberlog.llm.exact_dedup import without_copies
from emberlog.llm.mixing import mix
from emberlog.llm.near_dedup import without_near_copies
from emberlog.llm.quality import without_low_quality


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return without_low_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark, docs, sf_dir):
    """One of each group of equal texts stays."""
    return without_copies(docs)


def near(spark, docs, sf_dir):
    """One of each group of near-duplicates stays: shingles of five words, similarity 0.8 or more."""
    return without_near_copies(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that quote a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """How often the mix takes each document."""
    return mix(docs)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("decontamination", decontaminate), ("mixing", mixing)]
#: No SQL for the classifier and the confirmed links; tests/llm/test_contracts.py compares each stage with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
