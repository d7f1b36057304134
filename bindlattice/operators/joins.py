"""Joins that Catalyst has no operator for, rewritten as equi-joins on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindlattice.functions import sequence as seq


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, low: int, high: int) -> DataFrame:
    """Pairs with equal keys and low <= left_pos - right_pos <= high.

    Positions are binned by the band's width, the right side goes to the two or
    three bins its partners can be in, and the exact predicate follows; work grows
    with the matches, not with the square of a key's rows.
    """
    width = max(high - low + 1, 1)
    bins = F.sequence(F.floor((F.col(right_pos) + low) / width), F.floor((F.col(right_pos) + high) / width))
    binned = left.withColumn("_bin", F.floor(F.col(left_pos) / width))
    spread = right.withColumn("_bin", F.explode(bins))
    gap = F.col(left_pos) - F.col(right_pos)
    return binned.join(spread, [*keys, "_bin"]).where(gap.between(low, high)).drop("_bin")


def alike(rows: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Keys whose rows hold the same strings: (key, text) of each key, and (text, column, n) of each string once.

    ``text`` is the least of the keys alike and ``n`` their number.  A key of several rows
    has all their strings, as often as it holds them.  Null keys and null strings go.
    """
    held = rows.where(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(column)).alias("_strings"))
    texts = held.groupBy("_strings").agg(F.min(key).alias("text"), F.count("*").alias("n"))
    return held.join(texts.hint("merge"), "_strings").select(key, "text"), texts.select("text", F.explode("_strings").alias(column), "n")


#: Places of a string that are cut at once.
CHUNK = 512


def word_pairs(rows: DataFrame, key: str, column: str, k3: int, k5: int, low: int, high: int) -> DataFrame:
    """(key, p3, w3, p5, w5): words of k3 and k5 letters of a key with low <= p3 - p5 <= high; low must not be negative.

    Pairs of one row are cut from its string, a chunk at a time, and nothing is joined;
    keys of several rows, whose pairs may reach from one to another, go by a band join.
    """
    rows = rows.where(F.col(key).isNotNull()).select(key, column)
    several = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    reach = high + k3
    starts = F.when(F.length(column) > 0, F.sequence(F.lit(0), F.length(column) - 1, F.lit(CHUNK)))
    cut = rows.join(several, key, "left_anti").select(key, column, F.explode(starts).alias("_start"))
    cut = cut.select(key, "_start", F.substring(F.col(column), F.col("_start") + 1, F.lit(CHUNK + max(reach, k5))).alias("_letters"))
    each = cut.select(key, "_start", "_letters", F.explode(F.sequence(F.lit(0), F.least(F.length("_letters"), F.lit(CHUNK)) - 1)).alias("_i"))
    each = each.select(key, (F.col("_start") + F.col("_i")).alias("p5"), F.substring(F.col("_letters"), F.col("_i") + 1, F.lit(max(reach, k5))).alias("_seen"))
    near = each.select(key, "p5", F.substring("_seen", 1, k5).alias("w5"), "_seen", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_gap"))
    near = near.select(key, (F.col("p5") + F.col("_gap")).alias("p3"), F.substring(F.col("_seen"), F.col("_gap") + 1, F.lit(k3)).alias("w3"), "p5", "w5")
    near = near.where((F.length("w3") == k3) & (F.length("w5") == k5))
    words = lambda k, pos, word: rows.join(several, key, "left_semi").select(key, F.posexplode(seq.kmers(column, k)).alias(pos, word))
    across = band_join(words(k3, "p3", "w3"), words(k5, "p5", "w5"), [key], "p3", "p5", low, high)
    return near.unionByName(across.select(*near.columns))


def overlap_join(intervals: DataFrame, queries: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of half-open intervals (start, end) and queries (q_start, q_end) that overlap, once each.

    Both sides are dealt to bins of ``width``; a pair counts in the bin where the
    overlap begins, so no distinct is needed.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    left = intervals.where("end > start").withColumn("_bin", bins("start", "end"))
    right = queries.where("q_end > q_start").withColumn("_bin", bins("q_start", "q_end"))
    begins = F.floor(F.greatest("start", "q_start") / width)
    return left.join(right, [key, "_bin"]).where((F.col("start") < F.col("q_end")) & (F.col("q_start") < F.col("end")) & (F.col("_bin") == begins)).drop("_bin")


def overlap_mean(intervals: DataFrame, queries: DataFrame, key: str, query_id: str, value: str, width: int, missing: float = -1.0) -> DataFrame:
    """Length-weighted mean of the intervals over each query; ``missing`` where none overlaps."""
    size = F.least("end", "q_end") - F.greatest("start", "q_start")
    met = overlap_join(intervals, queries, key, width).groupBy(query_id).agg((F.sum(size * F.col(value)) / F.sum(size)).alias("mean"))
    return queries.select(query_id).join(met, query_id, "left").select(query_id, F.coalesce("mean", F.lit(missing)).alias("mean"))


def as_of(events: DataFrame, probes: DataFrame, key: str, at: str, value: str, probe_id: str, width: int = 1 << 16) -> DataFrame:
    """For each probe the value of the last event of its key at or before it.

    Keys are cut into bins (days of timestamps, ``width`` of numbers).  Rows are only
    sorted inside a bin; what a bin must know of earlier ones is their last value,
    which a window over one row a bin carries on.
    """
    timed = str(events.schema[at].dataType.typeName()).startswith("timestamp")
    bin_of = F.unix_date(F.to_date(at)).cast("long") if timed else F.floor(F.col(at) / width).cast("long")
    both = events.select(key, at, F.struct(F.col(value).alias("v")).alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias(probe_id)).unionByName(
        probes.select(key, at, F.lit(None).cast(f"struct<v: {events.schema[value].dataType.simpleString()}>").alias("_v"), F.lit(1).alias("_side"), F.col(probe_id).cast("long").alias(probe_id))
    )
    both = both.withColumn("_bin", bin_of)
    last = both.where("_side = 0 and _v.v is not null").groupBy(key, "_bin").agg(F.max_by("_v", at).alias("_last"))
    marks = both.select(key, "_bin").distinct().join(last, [key, "_bin"], "left")
    earlier = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).select(key, "_bin", "_carried")
    seen = Window.partitionBy(key, "_bin").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = F.when(F.col("_v.v").isNotNull(), F.col("_v"))
    found = both.withColumn("_found", F.last(shown, ignorenulls=True).over(seen)).where("_side = 1").join(carried, [key, "_bin"], "left")
    return found.select(probe_id, F.coalesce("_found", "_carried")["v"].alias(value))


def point_in_interval(intervals: DataFrame, probes: DataFrame, key: str, at: str, value: str, probe_id: str, missing: object) -> DataFrame:
    """For each probe the value of the last interval (start, end) of its key that starts at or before it, if it ends after it; else ``missing``."""
    last = as_of(intervals.select(key, F.col("start").alias(at), F.struct(value, "end").alias("_span")), probes.select(key, at, probe_id), key, at, "_span", probe_id)
    named = probes.select(probe_id, at).join(last, probe_id)
    return named.select(probe_id, F.coalesce(F.when(F.col(at) < F.col("_span.end"), F.col(f"_span.{value}")), F.lit(missing)).alias(value))


#: Rows up to which a narrow table may be broadcast.
BROADCAST_ROWS = 1_000_000


def small(rows: DataFrame) -> DataFrame:
    """rows with a broadcast hint if they were counted to be few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def in_all(membership: DataFrame, item: str, group: str, required: DataFrame) -> DataFrame:
    """Relational division: items that every group of ``required`` has."""
    needed = required.select(group).distinct()
    have = membership.join(small(needed), group, "left_semi").groupBy(item).agg(F.countDistinct(group).alias("_n"))
    return have.join(F.broadcast(needed.agg(F.count("*").alias("_need"))), F.col("_n") == F.col("_need")).select(item)


def in_none(items: DataFrame, membership: DataFrame, item: str, group: str, excluded: DataFrame) -> DataFrame:
    """Items that no group of ``excluded`` has."""
    barred = membership.join(small(excluded.select(group).distinct()), group, "left_semi").select(item).distinct()
    return items.join(barred, item, "left_anti")


def reconcile(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key on either side, and whether the counts agree."""
    a = new.groupBy(*keys).agg(F.count("*").alias("new_rows"))
    b = old.groupBy(*keys).agg(F.count("*").alias("old_rows"))
    joined = a.join(b, keys, "full").na.fill(0, ["new_rows", "old_rows"])
    return joined.withColumn("agrees", F.col("new_rows") == F.col("old_rows"))


def named(rows: DataFrame, names: DataFrame, key: str, name: str, fallback: Column) -> DataFrame:
    """rows with the name of their key, or a fallback made from the row."""
    return rows.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, fallback))


def lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a unique key."""
    return rows.where(F.col(key) == value).limit(1)
