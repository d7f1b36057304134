"""Small models that are fitted on the driver from a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindlattice.llm.common import crc_mod, quoted, stage


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> tuple[DataFrame, dict[int, int]]:
    """docs with a column label for at most ``most`` ids of each label (0 or 1), and how many ids of docs each label has.

    ``held_out`` is an expression of doc_id; held-out rows, rows without a label or an
    id never get in; of an id labelled twice the larger label counts.  Labels first
    meet the ids of docs alone, the sample is drawn from those by hash, and rows only
    meet a broadcast of at most 2 * most ids; of a doc_id on several rows the one
    with the least hash of its values is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), quoted(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(~F.coalesce(held_out, F.lit(False))).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = stage(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "known")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(17), "doc_id")
    parts = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(most) for k in (0, 1)]
    drawn = parts[0].unionByName(parts[1])
    values = [c for c in docs.columns if c != "doc_id"]
    rows = docs.join(F.broadcast(drawn), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min_by(F.struct(*values), F.xxhash64(*values)).alias("row"))
    return one.select("doc_id", "label", "row.*"), totals


class Logistic:
    """Ridge logistic regression on standardised features, with weights for sampled classes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (weight * (y - p)) - penalty * w
            curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class Mean:
    """The mean score of several models."""

    def __init__(self, models: list) -> None:
        self.models = models

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([m.predict(x) for m in self.models], axis=0)


class Constant:
    """The score where the sample has one class or none."""

    def __init__(self, value: float) -> None:
        self.value = value

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def held_out_third(column: Column) -> Column:
    return crc_mod(column, 3) == 1
