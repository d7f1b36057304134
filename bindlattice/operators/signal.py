"""Positional signals (key, pos, value): smoothing, down-sampling, runs, windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moving_average(signal: DataFrame, half: int) -> DataFrame:
    """Mean of the values from half before to half after; windows are cut at the ends."""
    around = Window.partitionBy("key").orderBy("pos").rowsBetween(-half, half)
    return signal.withColumn("smooth", F.avg("value").over(around))


def gaussian(signal: DataFrame, sigma: float) -> DataFrame:
    """Gaussian kernel of odd length 6 sigma + 1, renormalised at the ends.

    Each value is sent to the positions its kernel reaches, so one aggregation
    by position replaces a range join.
    """
    half = (int(6 * sigma + 1) | 1) // 2
    kernel = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(math.exp(-d * d / (2 * sigma * sigma))).alias("k")) for d in range(-half, half + 1)))
    sent = signal.select("key", "pos", "value", F.explode(kernel).alias("t")).select("key", (F.col("pos") + F.col("t.d")).alias("pos"), (F.col("t.k") * F.col("value")).alias("kv"), F.col("t.k").alias("k"), F.when(F.col("t.d") == 0, F.col("value")).alias("value"))
    met = sent.groupBy("key", "pos").agg(F.max("value").alias("value"), (F.sum("kv") / F.sum("k")).alias("smooth"))
    return met.where("value is not null")


def downsample(signal: DataFrame, bins: int) -> DataFrame:
    """Means of ``bins`` equal bins of each key; positions beyond the last whole bin go."""
    sizes = signal.groupBy("key").agg(F.floor(F.count("*") / bins).alias("size")).where("size > 0")
    binned = signal.join(sizes, "key").withColumn("bin", F.floor(F.col("pos") / F.col("size")))
    return binned.where(F.col("bin") < bins).groupBy("key", "bin").agg(F.avg("value").alias("mean"))


def binned_gaussian(signal: DataFrame, bins: int = 200, sigma: float = 2.0) -> DataFrame:
    """(key, bin, smooth): means of ``bins`` equal bins, then the Gaussian kernel over the bins."""
    means = downsample(signal, bins).select("key", F.col("bin").cast("long").alias("pos"), F.col("mean").alias("value"))
    return gaussian(means, sigma).select("key", F.col("pos").alias("bin"), "smooth")


def longest_run(signal: DataFrame, threshold: float) -> DataFrame:
    """Length of each key's longest run of neighbouring positions at or above the threshold."""
    island = F.col("pos") - F.row_number().over(Window.partitionBy("key").orderBy("pos"))
    runs = signal.where(F.col("value") >= threshold).withColumn("island", island).groupBy("key", "island").agg(F.count("*").alias("n"))
    return signal.select("key").distinct().join(runs.groupBy("key").agg(F.max("n").alias("n")), "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("longest"))


def tile_accessibility(tiles: DataFrame, width: int) -> DataFrame:
    """Per position the mean over all tiles (key, start, paired array) that cover it."""
    cells = tiles.select("key", "start", F.posexplode("paired").alias("at", "p")).where(F.col("at") < width)
    return cells.groupBy("key", (F.col("start") + F.col("at")).alias("pos")).agg(F.avg("p").alias("p"))


def accessibility(profile: DataFrame, spans: DataFrame) -> DataFrame:
    """1 less the least value of positions b to e of each span, whose key has an array ``p``."""
    part = F.slice("p", F.col("b") + 1, F.col("e") - F.col("b") + 1)
    return spans.join(profile, "key").withColumn("accessibility", 1 - F.array_min(part))
