"""Corpus pipeline: the STAGES in turn, each written as Parquet and read again by the next."""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from strideline.llm import decontaminate, jaccard, quality, secrets
from strideline.llm.queries import op3_columns
from strideline.sources.scratch import Scratch, begun
from strideline.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_left: ContextVar[tuple[Scratch, ...]] = ContextVar("left", default=())


def _frees(stage: Stage) -> Stage:
    """The stage, which first deletes the intermediate tables that the stage before has left.

    A stage's result is to be written before the next stage is called, so they are read
    no more; where ``docs`` still reads one, that one stays.
    """

    @functools.wraps(stage)
    def freeing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        old = [s for s in _left.get() if s.spark is spark]
        read = docs.inputFiles() if old else []
        kept = [s for s in old if any(s.name in path for path in read)]
        for scratch in old:
            if scratch not in kept:
                scratch.drop(".")
        with begun() as made:
            out = stage(spark, docs, sf_dir)
        _left.set((*kept, *made))
        return out

    return freeing


@_frees
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


@_frees
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    return jaccard.one_of_each(docs)


@_frees
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with its slots filled anew, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_frees
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    return secrets.redact_secrets(docs)


@_frees
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return op3_columns(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]

#: Too slow in SQL on whole tables (templates and their alignment); tests/llm has a plain-Python twin of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The STAGES over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    outside = _left.set(())  # the last stage's tables stay: the result reads them
    try:
        for name, stage in STAGES[:-1]:
            docs = scratch.save(stage(spark, docs, sf_dir), name)
            if before:
                scratch.drop(before)
            before = name
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _left.reset(outside)
