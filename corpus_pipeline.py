"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing and packing, over documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import jaccard, mixing, packing, quality, substring
from loomspan.llm.common import MADE, Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_OPEN: list[Scratch] = []


def _stage(f: Stage) -> Stage:
    """A stage that first frees the scratch tables of the one before, whose result is written by then."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _OPEN:
            before = _OPEN.pop()
            if before.app == spark.sparkContext.applicationId:
                before.release()
        made = len(MADE)
        out = f(spark, docs, sf_dir)
        _OPEN.extend(MADE[made:])
        return out

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the rules reject go."""
    return quality.keep_good(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10's fingerprints link documents, five-word shingles at a similarity of 0.8 or more confirm and complete the links: of
    each near-duplicate group the document with the smallest doc_id stays."""
    return jaccard.keep_one(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: passages that an earlier document has are cut out."""
    return substring.clean_documents(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents are drawn by probabilities raked to source, language and topic targets."""
    return mixing.mix(docs).filter("sampled").select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: what is left is packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Fertility, near-dedup and packing have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared scratch folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
