"""Dot-bracket structures: pairs, loops, shapes, pair types, bulges, profiles and masks.

Structures have id and structure; pairs come from windows over the brackets' depth
(fold.pairs_of), so nothing here keeps a stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindlattice.functions import sequence as seq
from bindlattice.operators.fold import pairs_of

#: Ordinals from which a seed class or a supplementary class no longer binds.
UNBOUND_SEED, WEAKEST_SUPP = 13, 2


def loops(structures: DataFrame) -> DataFrame:
    """(id, first, last, hairpin) of each run of unpaired letters; a hairpin is closed by one pair."""
    dots = structures.select("id", F.posexplode(F.split("structure", "")).alias("pos", "c")).where("c = '.'")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    runs = dots.withColumn("island", island).groupBy("id", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    closing = pairs_of(structures).select("id", (F.col("i") + 1).alias("first"), (F.col("j") - 1).alias("last"), F.lit(True).alias("closed"))
    return runs.join(closing, ["id", "first", "last"], "left").select("id", "first", "last", F.coalesce("closed", F.lit(False)).alias("hairpin"))


def shapes(structures: DataFrame) -> DataFrame:
    """(id, shape): brackets without dots, of stacked pairs the outermost only."""
    bare = structures.select("id", F.replace("structure", F.lit(".")).alias("structure"))
    pairs = pairs_of(bare)
    outer = pairs.select("id", (F.col("i") + 1).alias("i"), (F.col("j") - 1).alias("j"))
    heads = pairs.join(outer, ["id", "i", "j"], "left_anti")
    marks = heads.select("id", F.explode(F.array(F.struct(F.col("i").alias("at"), F.lit("(").alias("c")), F.struct(F.col("j").alias("at"), F.lit(")").alias("c")))).alias("m"))
    drawn = marks.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["c"]), "").alias("shape"))
    return structures.select("id").distinct().join(drawn, "id", "left").select("id", F.coalesce("shape", F.lit("")).alias("shape"))


def pair_types(rows: DataFrame) -> DataFrame:
    """(id, i, j, type) of the pairs of (id, structure, sequence): ) Watson-Crick, } wobble, > any other."""
    both = F.concat(F.substring(F.col("sequence"), F.col("i") + 1, F.lit(1)), F.substring(F.col("sequence"), F.col("j") + 1, F.lit(1)))
    kind = F.when(both.isin("AU", "UA", "GC", "CG"), ")").when(both.isin("GU", "UG"), "}").otherwise(">")
    return pairs_of(rows).join(rows.select("id", "sequence"), "id").select("id", "i", "j", kind.alias("type"))


def interiors(structures: DataFrame) -> DataFrame:
    """(id, i, left, right) of each pair that closes the next one: unpaired letters on either side; a bulge has them on one."""
    pairs = pairs_of(structures)
    follow = Window.partitionBy("id").orderBy("i")
    near = pairs.withColumns({"i2": F.lead("i").over(follow), "j2": F.lead("j").over(follow)})
    inner = near.where("i2 is not null and j2 < j")
    # The next pair is the only one inside if no other pair lies between its end and the closing letter.
    later = pairs.select("id", F.col("i").alias("k"))
    branched = inner.join(later, "id").where("k > j2 and k < j").select("id", "i").distinct()
    plain = inner.join(branched, ["id", "i"], "left_anti")
    return plain.select("id", "i", (F.col("i2") - F.col("i") - 1).alias("left"), (F.col("j") - F.col("j2") - 1).alias("right"))


def profile(structures: DataFrame, key: str = "key") -> DataFrame:
    """Per position the structures of a key that have a letter there, and how many open, close or leave it unpaired."""
    cells = structures.select(key, F.posexplode(F.split("structure", "")).alias("pos", "c")).where("c <> ''")
    count = lambda c, name: F.count(F.when(F.col("c") == c, 1)).alias(name)
    return cells.groupBy(key, "pos").agg(F.count("*").alias("n"), count("(", "opens"), count(")", "closes"), count(".", "dots"))


def accessible(state: str | Column) -> Column:
    """At least min(length, 4) neighbouring dots."""
    s = F.col(state) if isinstance(state, str) else state
    return F.contains(s, F.repeat(F.lit("."), F.least(F.length(s), F.lit(4))))


def is_shape(text: str | Column) -> Column:
    """Only brackets and dots, balanced, never closing before opening."""
    s = F.col(text) if isinstance(text, str) else text
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.least(acc["least"], depth).alias("least"))

    end = F.aggregate(F.split(s, ""), start, step)
    return F.coalesce(s.rlike(r"^[().]*$") & (end["depth"] == 0) & (end["least"] >= 0), F.lit(False))


def mask_names(structure: str | Column, masks: dict[str, str]) -> Column:
    """Names of the masks (regular expressions of whole structures) that a structure matches, in their order."""
    s = F.col(structure) if isinstance(structure, str) else structure
    return F.array_compact(F.array(*(F.when(s.rlike(f"^(?:{mask})$"), F.lit(name)) for name, mask in masks.items())))


def binds(seed_ordinal: Column, supp_ordinal: Column) -> Column:
    return (seed_ordinal < UNBOUND_SEED) | (supp_ordinal <= WEAKEST_SUPP)


def statistics(frame: DataFrame, by: str, value: str) -> DataFrame:
    """Nine statistics of each group's values: sum, extremes and quartiles, moments, and mean deviations from mean and median."""
    v = F.col(value)
    basic = frame.groupBy(by).agg(
        F.sum(v).alias("total"), F.max(v).alias("most"), F.percentile(v, F.lit(0.25)).alias("q1"), F.percentile(v, F.lit(0.5)).alias("median"),
        F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("deviation"),
    )
    apart = frame.join(basic.select(by, "mean", "median"), by).groupBy(by).agg(F.avg(F.abs(v - F.col("mean"))).alias("mad_mean"), F.avg(F.abs(v - F.col("median"))).alias("mad_median"))
    return basic.join(apart, by)


def best_structures(solutions: DataFrame, k: int, key: str = "key") -> DataFrame:
    """The k solutions (key, energy, structure) of least energy of each key, by energy, then dot-bracket."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("energy", "structure"))
    return solutions.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def pseudoknots(rows: DataFrame, least: int = 2) -> DataFrame:
    """(id, first, second, pairs): hairpin loops of one structure with at least ``least`` places, at equal distance from the ends, that can pair.

    rows: id, structure, sequence.  The second loop is read backwards.
    """
    held = loops(rows).where("hairpin").join(rows.select("id", "sequence"), "id")
    held = held.select("id", F.col("first").alias("at"), F.substring(F.col("sequence"), F.col("first") + 1, F.col("last") - F.col("first") + 1).alias("letters"))
    other = held.select("id", F.col("at").alias("second"), F.col("letters").alias("theirs"))
    met = held.join(other, "id").where("at < second").withColumn("size", F.least(F.length("letters"), F.length("theirs")))
    a, b = F.substring(F.col("letters"), F.lit(1), F.col("size")), F.substring(F.reverse("theirs"), F.lit(1), F.col("size"))
    pairs = seq.count_pairs(a, F.reverse(b))
    return met.select("id", F.col("at").alias("first"), "second", pairs.alias("pairs")).where(F.col("pairs") >= least)
