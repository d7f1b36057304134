"""The guide by target matrix in long form: pair means, dense grid, residual, summaries.

Sites have row_id, col_id, dg (binding energy), kd, bridge, seed_type and position.
Columns of the matrix are few (a panel of targets), rows are many; everything that
is per column is a small table, everything that is per row stays distributed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindlattice.operators import ranking

#: A residual of zero is raised to this, as factorisation needs positive cells.
FLOOR = 1e-6
#: Columns a panel may have; per-column tables are broadcast within this bound.
MOST_COLUMNS = 10_000


def not_seedless(column: str = "seed_type") -> Column:
    """Rows of any class but seedless; rows without a class stay."""
    return ~F.col(column).eqNullSafe("seedless")


def pair_mean(sites: DataFrame, exclude_seedless: bool = True) -> DataFrame:
    """Mean absolute energy of each (row, column) pair: the core aggregate."""
    kept = sites.where(not_seedless()) if exclude_seedless else sites
    kept = kept.where("row_id is not null and col_id is not null")
    return kept.groupBy("row_id", "col_id").agg(F.avg(F.abs("dg")).alias("w"))


def panel(pairs: DataFrame) -> DataFrame:
    """The distinct columns, with a broadcast hint once they are counted to be few."""
    columns = pairs.select("col_id").distinct()
    if columns.limit(MOST_COLUMNS + 1).count() > MOST_COLUMNS:
        raise ValueError(f"a panel has at most {MOST_COLUMNS} columns")
    return F.broadcast(columns)


def dense_grid(pairs: DataFrame) -> DataFrame:
    """Every row with every column of the panel; pairs without sites weigh 0."""
    cells = pairs.select("row_id").distinct().crossJoin(panel(pairs))
    return cells.join(pairs, ["row_id", "col_id"], "left").select("row_id", "col_id", F.coalesce("w", F.lit(0.0)).alias("w"))


def column_means(pairs: DataFrame) -> DataFrame:
    """Mean of each column over all rows of the matrix, pairs without sites included."""
    rows = pairs.agg(F.countDistinct("row_id").alias("n_rows"))
    sums = pairs.groupBy("col_id").agg(F.sum("w").alias("total"))
    return sums.crossJoin(F.broadcast(rows)).select("col_id", (F.col("total") / F.col("n_rows")).alias("mean"))


def residual(pairs: DataFrame, floor: float | None = FLOOR) -> DataFrame:
    """max(0, w - column mean) on the dense grid; zeros become ``floor`` unless it is None."""
    grid = dense_grid(pairs).join(F.broadcast(column_means(pairs)), "col_id")
    above = F.greatest(F.lit(0.0), F.col("w") - F.col("mean"))
    value = above if floor is None else F.when(above == 0, F.lit(floor)).otherwise(above)
    return grid.select("row_id", "col_id", value.alias("v"))


def row_normalised(grid: DataFrame, value: str = "w") -> DataFrame:
    """Each row divided by its sum; rows that sum to zero stay zero."""
    total = F.sum(value).over(Window.partitionBy("row_id"))
    return grid.select("row_id", "col_id", F.when(total == 0, 0.0).otherwise(F.col(value) / total).alias("p"))


def pivot(pairs: DataFrame, columns: list) -> DataFrame:
    """One row a row_id, one column a panel member (given, so no extra job finds them); gaps are 0."""
    return pairs.groupBy("row_id").pivot("col_id", columns).agg(F.first("w")).na.fill(0.0)


def top_residual(pairs: DataFrame, k: int, floor: float = FLOOR, digits: int = 6) -> DataFrame:
    """The k largest residual cells of each column (ties: the smaller row_id), without the dense grid.

    Cells above the column mean are stored pairs; where a column has fewer than k, the
    first of the other rows fill it up at the floor.
    """
    above = pairs.join(F.broadcast(column_means(pairs)), "col_id").where("w > mean").select("col_id", "row_id", F.round(F.col("w") - F.col("mean"), digits).alias("v"))
    first = ranking.top_per(above, "col_id", "v", "row_id", k).drop("rn")
    short = panel(pairs).join(above.groupBy("col_id").agg(F.count("*").alias("n")), "col_id", "left").where(f"coalesce(n, 0) < {k}").select("col_id")
    rows = pairs.select("row_id").distinct().orderBy("row_id").limit(2 * k)
    filling = short.crossJoin(F.broadcast(rows)).join(above.select("col_id", "row_id"), ["col_id", "row_id"], "left_anti").select("col_id", "row_id", F.lit(floor).alias("v"))
    return ranking.top_per(first.unionByName(filling), "col_id", "v", "row_id", k)


def order_statistics(frame: DataFrame, value: str, points: list[float], bins: int = 4096, most: int = 100_000) -> list[float | None]:
    """Interpolated percentiles of non-null values, exact: ranks are narrowed down by histograms, so no task holds all values."""
    values = frame.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not n:
        return [None] * len(points)

    def at(rank: int) -> float:
        least, top, before = low, high, 0
        while True:
            inside = values.where((F.col("x") >= least) & (F.col("x") <= top))
            width = (top - least) / bins
            if width <= 0 or least + width == least:
                return least
            place = F.least(F.floor((F.col("x") - least) / width), F.lit(bins - 1))
            rows = sorted(inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect())
            for r in rows:
                if before + r["n"] > rank:
                    break
                before += r["n"]
            least, top = r["a"], r["b"]
            if r["n"] <= most:
                held = sorted(x["x"] for x in values.where((F.col("x") >= least) & (F.col("x") <= top)).collect())
                return held[rank - before]

    ranks = {int(f((n - 1) * p)) for p in points for f in (math.floor, math.ceil)}
    found = {r: at(r) for r in ranks}
    return [found[math.floor((n - 1) * p)] + ((n - 1) * p - math.floor((n - 1) * p)) * (found[math.ceil((n - 1) * p)] - found[math.floor((n - 1) * p)]) for p in points]


def matrix_stats(pairs: DataFrame) -> DataFrame:
    """Cells of the dense grid, share above zero, extremes, and the interpolated 95 and 97 % points of positive cells; zeros are counted, not made."""
    p95, p97 = order_statistics(pairs.where("w > 0"), "w", [0.95, 0.97])
    stored = pairs.agg(F.count("*").alias("stored"), F.count(F.when(F.col("w") > 0, 1)).alias("positive"), F.min("w").alias("least"), F.max("w").alias("most"), F.countDistinct("row_id").alias("rows"), F.countDistinct("col_id").alias("cols"))
    cells = F.col("rows") * F.col("cols")
    return stored.select(
        cells.alias("cells"), (F.col("positive") / cells).alias("density"), F.when(F.col("stored") < cells, F.least("least", F.lit(0.0))).otherwise(F.col("least")).alias("least"),
        F.when(F.col("stored") < cells, F.greatest("most", F.lit(0.0))).otherwise(F.col("most")).alias("most"), F.lit(p95).cast("double").alias("p95"), F.lit(p97).cast("double").alias("p97"),
    )


def stored_variance(pairs: DataFrame) -> DataFrame:
    """Population variance of each row of the dense grid from its stored pairs."""
    columns = pairs.agg(F.countDistinct("col_id").alias("n"))
    sums = pairs.groupBy("row_id").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.crossJoin(F.broadcast(columns)).select("row_id", F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)).alias("variance"))


def row_variance(grid: DataFrame, value: str = "w") -> DataFrame:
    return grid.groupBy("row_id").agg(F.var_pop(value).alias("variance"))


def edges(grid: DataFrame, threshold: float, power: float = 1.0, value: str = "w") -> DataFrame:
    """Cells of at least the threshold, which is tested before the power is taken."""
    return grid.where(F.col(value) >= threshold).select("row_id", "col_id", F.pow(F.col(value), F.lit(power)).alias("weight"))


def cotargets(pairs: DataFrame, threshold: float) -> DataFrame:
    """For columns i < j of the residual matrix how many rows exceed the threshold in both; pairs that share none count 0.

    Only stored pairs can exceed a threshold of zero or more, so no grid is made;
    each row's columns are gathered (at most a panel), and column pairs come from
    one aggregation by row instead of a join of the cells with themselves.
    """
    cells = pairs.join(F.broadcast(column_means(pairs)), "col_id").where(F.col("w") - F.col("mean") > max(threshold, 0.0))
    held = cells.groupBy("row_id").agg(F.sort_array(F.collect_set("col_id")).alias("cols"))
    others = F.expr("transform(slice(cols, i + 2, size(cols)), c -> struct(cols[i] AS a, c AS b))")
    listed = held.select(F.explode(F.sequence(F.lit(0), F.size("cols") - 1)).alias("i"), "cols").select(F.explode(others).alias("p"))
    counted = listed.groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))
    names = panel(pairs)
    every = names.select(F.col("col_id").alias("a")).join(names.select(F.col("col_id").alias("b")), F.col("a") < F.col("b"))
    return every.join(counted, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))


def min_max(frame: DataFrame, value: str, partition: str | None = None) -> DataFrame:
    """Values scaled to [0, 1]; a range of zero counts as one."""
    if partition:
        of = Window.partitionBy(partition)
        low, high = F.min(value).over(of), F.max(value).over(of)
        scaled = frame.withColumns({"_low": low, "_high": high})
    else:
        scaled = frame.crossJoin(F.broadcast(frame.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))))
    width = F.when(F.col("_high") == F.col("_low"), 1.0).otherwise(F.col("_high") - F.col("_low"))
    return scaled.withColumn("scaled", (F.col(value) - F.col("_low")) / width).drop("_low", "_high")


def standard_scale(frame: DataFrame, value: str) -> DataFrame:
    """(x - mean) / population deviation; a deviation of zero counts as one."""
    stats = frame.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    scaled = (F.col(value) - F.col("_mean")) / F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    return frame.crossJoin(F.broadcast(stats)).withColumn("scaled", scaled).drop("_mean", "_sd")


def proportions(sites: DataFrame, kind: str, top: int | None = None) -> DataFrame:
    """Share of each kind among a row's sites; with ``top``, of the most frequent kinds only."""
    rows = sites.where(F.col(kind).isNotNull())
    if top:
        frequent = rows.groupBy(kind).count().orderBy(F.col("count").desc(), kind).limit(top)
        rows = rows.join(F.broadcast(frequent.select(kind)), kind, "left_semi")
    counts = rows.groupBy("row_id", kind).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("row_id")))


def row_features(sites: DataFrame) -> DataFrame:
    """Means, sample deviations, median and count of each row's sites; undefined values are 0."""
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return sites.groupBy("row_id").agg(
        zero(F.avg("dg"), "mean_dg"), zero(F.avg(F.log1p("kd")), "mean_log_kd"), zero(F.avg("bridge"), "mean_bridge"),
        zero(F.stddev_samp("dg"), "std_dg"), zero(F.stddev_samp(F.log1p("kd")), "std_log_kd"), zero(F.percentile("dg", F.lit(0.5)), "median_dg"), F.count("dg").alias("n_sites"),
    )


def feature_table(features: DataFrame, shares: dict[str, tuple[DataFrame, str, tuple]]) -> DataFrame:
    """features with one column for each kind of each table of shares (row_id, kind, share), given as name: (table, kind, kinds); gaps are 0.

    The kinds are given, so each table is pivoted by one aggregation without a job that looks for them.
    """
    out = features
    for name, (rows, kind, kinds) in shares.items():
        wide = rows.groupBy("row_id").agg(*(F.sum(F.when(F.col(kind) == k, F.col("share"))).alias(f"{name}_{k}") for k in kinds))
        out = out.join(wide, "row_id", "left")
    return out.na.fill(0)


def category_summary(targets: DataFrame, sites: DataFrame) -> DataFrame:
    """Per category: targets, sites (a target without sites counts once), mean and least energy."""
    return (
        targets.join(sites, "col_id", "left")
        .groupBy("category")
        .agg(F.countDistinct("col_id").alias("targets"), F.count("*").alias("sites"), F.avg("dg").alias("mean_dg"), F.min("dg").alias("least_dg"))
    )


def stored_shares(pairs: DataFrame) -> DataFrame:
    """Each stored pair's share of its row's sum; absent pairs, whose share is 0, add nothing to an entropy."""
    total = pairs.groupBy("row_id").agg(F.sum("w").alias("total"))
    return pairs.join(total, "row_id").select("row_id", "col_id", F.when(F.col("total") == 0, 0.0).otherwise(F.col("w") / F.col("total")).alias("p"))


def entropy(weights: DataFrame, value: str = "p", components: int | None = None) -> DataFrame:
    """Shannon entropy of each row's normalised weights over ln(components); mixed above 0.8."""
    k = F.lit(float(components)) if components else F.count("*").cast("double")
    term = F.when(F.col(value) > 0, -F.col(value) * F.ln(value)).otherwise(0.0)
    h = F.when(k > 1, F.sum(term) / F.ln(k)).otherwise(0.0)
    return weights.groupBy("row_id").agg(F.coalesce(h, F.lit(0.0)).alias("entropy")).withColumn("mixed", F.col("entropy") > 0.8)
