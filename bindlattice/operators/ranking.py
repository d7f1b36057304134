"""Top-k, argmax and orderings, always with a complete tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(frame: DataFrame, by: str, value: str, ties: str, k: int) -> DataFrame:
    """The k rows of largest value within each group, ranked from 1; groups are cut before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(value).desc(), ties))
    return frame.withColumn("rn", rank.cast("long")).where(F.col("rn") <= k)


def top(frame: DataFrame, value: str, ties: list[str], k: int) -> DataFrame:
    return frame.orderBy(F.col(value).desc(), *ties).limit(k)


def top_nodes(edges: DataFrame, node: str, weight: str, k: int) -> DataFrame:
    """Edges of the k nodes with the largest sum of weights."""
    best = edges.groupBy(node).agg(F.sum(weight).alias("_sum")).orderBy(F.col("_sum").desc(), node).limit(k)
    return edges.join(F.broadcast(best.select(node)), node, "left_semi")


def argmax(frame: DataFrame, by: str, of: str, value: str) -> DataFrame:
    """For each group the ``of`` with the largest value, the least one on ties; aggregates, so no group is sorted."""
    best = F.min_by(F.struct(of, value), F.struct(-F.col(value), F.col(of)))
    return frame.groupBy(by).agg(best.alias("_best")).select(by, F.col(f"_best.{of}").alias(of), F.col(f"_best.{value}").alias(value))


def argmin_site(candidates: DataFrame, key: list[str], energy: str, order: list[str]) -> DataFrame:
    """Per site key the candidate of least negative-side energy; the first in ``order`` on ties; energies of 0 or more go."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(energy), *order))
    return candidates.where(F.col(energy) < 0).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_writer(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """INSERT OR IGNORE as a plan: of rows with one primary key the first in ``order`` stays."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def shares(labels: DataFrame, label: str) -> DataFrame:
    """Members of each label, their share, and the label's rank by size."""
    sizes = labels.groupBy(label).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("_total"))
    ranked = sizes.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total"))
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), label)).cast("long")).drop("_total")


def ordered(rows: DataFrame, by: list[str], place: str) -> DataFrame:
    """Rows of a small table (labels of a figure) with their place, from 1, in an order."""
    return rows.withColumn(place, F.row_number().over(Window.orderBy(*by)).cast("long"))
