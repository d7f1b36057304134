"""Summaries of clusterings and of factor tables, and orderings for figures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindlattice.operators import ranking


def cluster_report(labels: DataFrame, sites: DataFrame, k: int = 5) -> DataFrame:
    """Per label: members, share, rank by size, and its k most frequent targets with their sites.

    labels: row_id, label; sites: row_id, col_id.
    """
    sizes = ranking.shares(labels, "label")
    counts = sites.join(labels, "row_id").groupBy("label", "col_id").agg(F.count("*").alias("sites"))
    best = ranking.top_per(counts, "label", "sites", "col_id", k)
    named = best.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rn", "col_id", "sites"))).alias("targets"))
    return sizes.join(named, "label", "left")


def signature_means(weights: DataFrame, profiles: DataFrame) -> DataFrame:
    """Mean profile cell by dominant label and column: (label, col_id, mean)."""
    return profiles.join(weights, "row_id").groupBy("label", "col_id").agg(F.avg("v").alias("mean"))


def selected_rank(records: DataFrame) -> DataFrame:
    """The record (k, score) of the largest score, the least k on ties."""
    return records.orderBy(F.col("score").desc(), "k").limit(1)


def leaf_order(rows: np.ndarray) -> list[int]:
    """Order of a small matrix's rows along an average-linkage tree of euclidean distances."""
    n = len(rows)
    if not n:
        return []
    d = np.sqrt(((rows[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    members = {i: [i] for i in range(n)}
    for _ in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        a, b = len(members[i]), len(members[j])
        joined = (a * d[i] + b * d[j]) / (a + b)
        d[i], d[:, i] = joined, joined
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        members[i] += members.pop(j)
    return next(iter(members.values()))
