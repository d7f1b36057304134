"""Binding sites: candidates, seed classes and affinities, filters."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindlattice.functions import sequence as seq
from bindlattice.operators.joins import band_join, small

# Dissociation constants by seed class.
CLASS_KD = {
    "A1-7mer": 4.0, "7mer": 12.0, "A1-6mer": 125.0, "6mer": 343.0, "offset-6mer": 800.0, "A1-5mer": 490.0, "5mer": 1504.0,
    "offset-5mer": 26400.0, "distant-5mer": 295837.0, "A1-4mer": 4000.0, "4mer": 12276.0, "offset-4mer": 115750.0, "distant-4mer": 8455996.0, "seedless": 1e9,
}
# Exponents of 2 by guide position, 2 to 8; the last is for any other position.
WOBBLE = (6.407, 7.040, 7.432, 6.451, 6.200, 4.094, 2.234, 6.632)
MISMATCH = (6.266, 8.323, 7.644, 7.486, 8.050, 5.660, 2.998, 7.389)
DELETION = (5.004, 6.038, 7.737, 8.202, 8.067, 4.748, 6.317)
BULGE = (4.992, 5.995, 6.998, 6.875, 4.814, 2.753, 6.170)
WINDOW, LEAST_BRIDGE, MOST_BRIDGE = 31, 1, 15


def pair_kind(guide: Column, target: Column) -> Column:
    """W for Watson-Crick, G for wobble, x for a mismatch."""
    both = F.concat(guide, target)
    return F.when(both.isin("AU", "UA", "GC", "CG"), "W").when(both.isin("GU", "UG"), "G").otherwise("x")


def seed_kinds(guide: Column, window: Column) -> Column:
    """Pair kinds of guide letters 2 to 8 with a 31-letter window whose last letter faces letter 1."""
    at = F.sequence(F.lit(2), F.lit(8))
    return F.array_join(F.transform(at, lambda g: pair_kind(F.substring(guide, g, F.lit(1)), F.substring(window, F.lit(WINDOW + 1) - g, F.lit(1)))), "")


def seed_class(kinds: Column, last: Column) -> Column:
    """Class of an unbulged seed by its kinds (letters 2 to 8) and the target letter opposite letter 1."""
    a1 = F.when(last == "A", "A1-").otherwise("")
    bound = lambda i: F.substring(kinds, i, 1) != "x"
    deepest = F.when(bound(7), "7mer").when(bound(6), "6mer").when(bound(5), "5mer").otherwise("4mer")
    offset = F.when(bound(7), "offset-6mer").when(bound(6), "offset-5mer").otherwise("offset-4mer")
    distant = F.when(bound(7), "distant-5mer").otherwise("distant-4mer")
    return (
        F.when(kinds.startswith("WWWW"), F.concat(a1, deepest))
        .when(F.substring(kinds, 2, 4) == "WWWW", offset)
        .when(F.substring(kinds, 3, 4) == "WWWW", distant)
        .when(F.length(F.regexp_replace(kinds, "[^W]", "")) >= 6, F.concat(a1, F.lit("7mer")))
        .otherwise("seedless")
    )


def class_kd(label: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CLASS_KD.items()))
    return F.try_element_at(table, label)


def kd(label: Column, kinds: Column) -> Column:
    """Class constant times 2 to the sum of the exponents of wobbles and mismatches inside the seed's span."""
    wobble, mismatch = (F.array(*map(F.lit, t)) for t in (WOBBLE, MISMATCH))
    first = F.when(label.startswith("offset"), 2).when(label.startswith("distant"), 3).otherwise(1)
    size = F.regexp_extract(label, r"(\d)mer", 1)
    last = first + F.when(size == "", 0).otherwise(size.try_cast("int")) - 1
    at = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    def exponent(i: Column) -> Column:
        kind = F.substring(kinds, i, F.lit(1))
        return F.when(kind == "G", F.element_at(wobble, i)).when(kind == "x", F.element_at(mismatch, i)).otherwise(0.0)

    total = F.aggregate(at, F.lit(0.0), lambda acc, i: acc + exponent(i))
    return class_kd(label) * F.pow(F.lit(2.0), total)


def seedless_kd(seed_energy: Column, supp_energy: Column) -> Column:
    return F.lit(1e9) / (0.25 * -seed_energy + 0.75 * -supp_energy)


def candidate_sites(guides: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Seed sites (guide letters 2-5) with supplementary sites (13-16, wobbles allowed), bridged by 1 to 15 letters.

    guides: guide_id, sequence; transcripts: transcript_id, sequence.  Target
    words of four letters are indexed once and both kinds of site are found by
    equi-joins on the word; a band join pairs them.  Each row has the 31-letter
    window, the bridge, and the position of the letter opposite guide letter 2.
    """
    words = transcripts.select("transcript_id", F.posexplode(seq.kmers("sequence", 4)).alias("pos", "word"))
    seeds = guides.select("guide_id", seq.reverse_complement(seq.region("sequence", 2, 5)).alias("word"))
    supps = guides.select("guide_id", F.explode(seq.complements_with_wobbles(seq.region("sequence", 13, 16))).alias("word"))
    seed_sites = words.join(small(seeds), "word").select("guide_id", "transcript_id", (F.col("pos") + 3).alias("g2"))
    supp_sites = words.join(small(supps), "word").select("guide_id", "transcript_id", (F.col("pos") + 3).alias("g13")).distinct()
    # Bridge: g8 - g13 - 1 with g8 = g2 - 6.
    pairs = band_join(seed_sites, supp_sites, ["guide_id", "transcript_id"], "g2", "g13", LEAST_BRIDGE + 7, MOST_BRIDGE + 7)
    placed = pairs.join(transcripts, "transcript_id").where("g2 - 29 >= 0 and g2 + 1 < length(sequence)")
    return placed.select(
        "guide_id", "transcript_id", (F.col("g2") - 29).alias("position_start"), (F.col("g2") + 1).alias("position_end"),
        (F.col("g2") - F.col("g13") - 7).alias("bridge"), F.substring(F.col("sequence"), F.col("g2") - 28, F.lit(WINDOW)).alias("window"),
    )


def keeps_interaction(max_kd: float = 1500.0, min_seed: str = "6mer", utr5: bool = False, cds: bool = True, utr3: bool = True, seed_access: float = 0.15, supp_access: float = 0.0, supp_paired: bool = False, conserved: int = 0) -> Column:
    """The conjunctive site filter over kd, seed_class, region, seed_acc, supp_acc, supp_type and conservation.

    Seed classes compare as text by their four-letter core; accessibilities get
    0.005 of grace; a conservation of -1 (no score) passes.
    """
    core = F.regexp_extract("seed_class", r"(\dmer)", 1)
    seed = F.lit(True) if min_seed == "seedless" else (F.col("seed_class") != "seedless") & (core >= min_seed)
    places = [F.col("region").contains(name) for name, on in (("5UTR", utr5), ("CDS", cds), ("3UTR", utr3)) if on]
    place = F.lit(False)
    for p in places:
        place = place | p
    access = (F.col("seed_acc") + 0.005 >= seed_access) & (F.col("supp_acc") + 0.005 >= supp_access)
    supp = F.lit(True) if not supp_paired else F.col("supp_type") != "suppless"
    kept = (F.lit(conserved) <= F.col("conservation")) | (F.col("conservation") == -1)
    return (F.col("kd") <= max_kd) & seed & place & access & supp & kept


def older_seed_type(matches: Column, a1: Column) -> Column:
    """Site type by the older names: eight places, 1 where the target pairs with the guide, and whether A faces letter 1."""
    core = F.substring(matches, 2, 6) == "111111"
    return (
        F.when(matches == "11111111", "8-mer")
        .when(F.substring(matches, 1, 7) == "1111111", "7-mer-m8")
        .when(core & a1, "7-mer-A1")
        .when(core, "6-mer")
        .when(F.substring(matches, 1, 6) == "111111", "offset-6-mer")
        .when(F.length(F.replace(matches, F.lit("0"))) >= 6, "1-bulge")
        .otherwise("seedless")
    )


def boltzmann(states: DataFrame, rt: float = 310.15 * 0.0019872) -> DataFrame:
    """Probability of each state (key, energy) at 37 degrees; shifted by the least energy of its key."""
    least = states.groupBy("key").agg(F.min("energy").alias("_least"))
    weighed = states.join(least, "key").withColumn("_b", F.exp(-(F.col("energy") - F.col("_least")) / rt))
    total = weighed.groupBy("key").agg(F.sum("_b").alias("_z"))
    return weighed.join(total, "key").withColumn("probability", F.col("_b") / F.col("_z")).drop("_least", "_b", "_z")


def parse_blocks(texts: DataFrame, column: str) -> DataFrame:
    """Site blocks of a binding-landscape text, one row each, in order.

    Positions, region and class are read from a block's first line, bridge, scores and
    energies from its second; blocks of fewer lines, and those without a position or
    an energy, go.  The block itself is kept as interaction_string.
    """
    bare = lambda c: F.trim(F.col(c), F.lit(" \t\r\n"))
    blocks = texts.select("*", F.posexplode(F.split(bare(column), "(?=5'-)")).alias("block_pos", "block")).where(bare("block") != "")
    lines = blocks.withColumn("_lines", F.split(bare("block"), "\n")).where(F.size("_lines") >= 2).withColumns({"_one": F.get("_lines", F.lit(0)), "_two": F.get("_lines", F.lit(1))})
    first = lambda pattern: F.nullif(F.regexp_extract("_one", pattern, 1), F.lit(""))
    second = lambda pattern: F.nullif(F.regexp_extract("_two", pattern, 1), F.lit(""))
    number = lambda pattern: F.regexp_replace(second(pattern), ",", "").try_cast("double")
    out = lines.select(
        *texts.columns, "block_pos", first(r"\[(\d+)\.\.\d+\]").try_cast("long").alias("position_start"), first(r"\[\d+\.\.(\d+)\]").try_cast("long").alias("position_end"),
        first(r"\((\w+)\)").alias("region"), first(r"target site:\s*(\S+)").alias("seed_type"), second(r"bridge:\s*(\d+)").try_cast("int").alias("bridge"),
        number(r"phastcons:\s*(-?[\d.]+)").alias("phastcons"), number(r"dG:\s*(-?[\d.]+)").alias("dg"), number(r"Kd:\s*([\d,]+)").alias("kd"),
        F.contains(F.col("block"), F.lit("TarBase")).alias("validated"), bare("block").alias("interaction_string"),
    )
    return out.where("dg is not null and position_start is not null")
