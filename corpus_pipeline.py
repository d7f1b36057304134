"""Corpus pipeline: toxicity, near-duplicates, benchmark items, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
all but the last return the columns of documents, whatever these are.  Decisions
concern rows: toxicity is judged row by row, and near-duplicates and benchmark items
work on rows under keys of their own, so rows with a null or a shared doc_id are
treated like any other.

Defined results: null and empty texts are judged as texts without words, stay one by
one (they are nobody's copy) and hold no benchmark item; the mix takes only what
holds words; an empty table gives empty tables.

A stage removes what it staged on its way as soon as its result does not read it, and
``run`` removes a stage's result when the next one is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindlattice.llm.common import drop_shuffles, read, recorded, release, small, stage
from bindlattice.llm.decontaminate import contained_items
from bindlattice.llm.mixing import mixed_rows
from bindlattice.llm.near_dedup import near_duplicates
from bindlattice.llm.token_files import tokens_of
from bindlattice.llm.toxicity import ordinary_rows


def _stage(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that gives back disk: shuffles of plans that are gone, and folders that its result does not read."""

    @wraps(step)
    def work(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_shuffles(spark)
        with recorded() as folders:
            result = step(spark, docs, sf_dir)
            release(spark, folders, result)
        return result

    return work


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a key of its own for each row, and the key's name, which no other column has."""
    key = "_row"
    while key in docs.columns:
        key += "_"
    return stage(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _without(keyed: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    """keyed less the rows whose keys are rejected, and less the key."""
    ids, _ = small(stage(rejected.select(F.col("doc_id").alias(key)).distinct(), "rejected"))
    return keyed.join(ids, key, "left_anti").drop(key)


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return ordinary_rows(docs, read(spark, sf_dir, "labels"))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more stays, the one with the least doc_id."""
    keyed, key = _keyed(docs)
    groups = near_duplicates(keyed, id_col=key, percent=80).select("doc_id", "component_id")
    several = groups.where("doc_id <> component_id").select("component_id").distinct()
    names = keyed.select(F.col(key).alias("doc_id"), F.col("doc_id").alias("name"))
    members = stage(groups.join(several, "component_id", "left_semi").join(names, "doc_id"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("name").isNull().alias("unnamed"), "name", "doc_id"))["doc_id"].alias("doc_id"))
    return _without(keyed, key, members.join(first.select("doc_id"), "doc_id", "left_anti"))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item to 0.8 or more go."""
    keyed, key = _keyed(docs)
    return _without(keyed, key, contained_items(keyed, read(spark, sf_dir, "benchmark"), id_col=key))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, each as often as it takes it, in shuffled shards."""
    return mixed_rows(docs)


@_stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Starts, lengths and checksums of the token files of what is left."""
    return tokens_of(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: Classifier scores and token ids are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents, each stage written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    behind: list[str] = []
    for name, step in STAGES[:-1]:
        with recorded() as folders:
            docs = stage(step(spark, docs, sf_dir), name)
            behind += folders
            folders.clear()
        release(spark, behind, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
