"""Guide design: grips, generated antisense strings, seeds that fit a word, exhaustive requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindlattice.functions import sequence as seq
from bindlattice.operators.joins import in_all, word_pairs


def grips(transcripts: DataFrame, k3: int, k5: int, most: int, least: int = 3) -> DataFrame:
    """(grip, transcript_id, pos3p, pos5p, bridge) of word pairs at a distance of least to most.

    distance = (pos3p - (7 - k3)) - (pos5p + k5) - 1.
    """
    shift = 7 - k3 + k5 + 1
    pairs = word_pairs(transcripts, "transcript_id", "sequence", k3, k5, least + shift, most + shift)
    return pairs.select(F.concat("w3", F.lit("/"), "w5").alias("grip"), "transcript_id", F.col("p3").alias("pos3p"), F.col("p5").alias("pos5p"), (F.col("p3") - F.col("p5") - shift).alias("bridge"))


def required_grips(found: DataFrame, required: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Grips that every required transcript has and, if given, not all excluded ones share."""
    kept = in_all(found, "grip", "transcript_id", required)
    return kept if excluded is None else kept.join(in_all(found.join(kept, "grip", "left_semi"), "grip", "transcript_id", excluded), "grip", "left_anti")


def couplings(found: DataFrame) -> DataFrame:
    """For each pair of transcripts how many grips they share; a grip's transcripts are gathered once."""
    held = found.groupBy("grip").agg(F.sort_array(F.collect_set("transcript_id")).alias("t"))
    listed = held.select(F.explode(F.sequence(F.lit(0), F.size("t") - 1)).alias("i"), "t").select(F.explode(F.expr("transform(slice(t, i + 2, size(t)), x -> struct(t[i] AS a, x AS b))")).alias("p"))
    return listed.groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


def cross_hybrids(found: DataFrame) -> DataFrame:
    """Pairs of different places with one grip, in one transcript or two."""
    place = F.struct("transcript_id", "pos3p")
    a = found.select("grip", place.alias("here"))
    return a.join(found.select("grip", place.alias("there")), "grip").where("here < there").distinct()


def all_kmers(spark: SparkSession, k: int, excluded: list[str] | None = None) -> DataFrame:
    """The 4**k strings of length k less those that hold an excluded part."""
    rows = spark.range(4**k).select(seq.from_base4("id", k).alias("kmer"))
    for part in excluded or []:
        rows = rows.where(F.instr("kmer", part) == 0)
    return rows


def kmer_positions(strings: DataFrame, key: str, column: str, least_k: int, most_k: int, strands: int) -> DataFrame:
    """(kmer, key, positions) for k from least_k to most_k of the k-mers that at least ``strands`` strings hold."""
    each = F.concat(*(F.transform(seq.kmers(column, k), lambda w, i: F.struct(w.alias("kmer"), i.alias("pos"))) for k in range(least_k, most_k + 1)))
    found = strings.select(key, F.explode(each).alias("w")).groupBy("w.kmer", key).agg(F.sort_array(F.collect_list("w.pos")).alias("positions"))
    common = found.groupBy("kmer").agg(F.count("*").alias("_n")).where(F.col("_n") >= strands).select("kmer")
    return found.join(common, "kmer")


def antisense_candidates(grip_words: DataFrame, excluded: list[str], least_gc: float = 0.3, most_gc: float = 0.7) -> DataFrame:
    """1024 strings for each (grip, seed4, supp3): C seed4 NNN UUAA supp3 NN AAUU, filtered.

    Five free letters are the base-4 digits of 0 to 1023.
    """
    letters = all_kmers(grip_words.sparkSession, 5).withColumnRenamed("kmer", "f")
    free = grip_words.crossJoin(F.broadcast(letters))
    text = F.concat(F.lit("C"), "seed4", F.substring("f", 1, 3), F.lit("UUAA"), "supp3", F.substring("f", 4, 2), F.lit("AAUU"))
    made = free.select("grip", text.alias("antisense"))
    return made.where(seq.gc_fraction("antisense").between(least_gc, most_gc)).where(" and ".join(f"instr(antisense, '{x}') = 0" for x in excluded) or "true")


def covers_every_target(sites: DataFrame, required: DataFrame, max_kd: float, key: str = "antisense") -> DataFrame:
    """Strings with at least one site of kd <= max_kd in every required transcript."""
    return in_all(sites.where(F.col("kd") <= max_kd), key, "transcript_id", required)


def mutated(rows: DataFrame, column: str, position: int, k: int) -> DataFrame:
    """Each string with each of the 4**k words written over it at a position counted from 1."""
    return rows.crossJoin(F.broadcast(all_kmers(rows.sparkSession, k))).withColumn(column, F.overlay(column, "kmer", F.lit(position))).drop("kmer")


def fitting_seeds(words: DataFrame, k: int = 7, deviations: int = 1) -> DataFrame:
    """Seeds of k letters for each 8-letter word: four contiguous Watson-Crick pairs, or k - 1 pairs with few deviations."""
    seeds = all_kmers(words.sparkSession, k).withColumnRenamed("kmer", "seed")
    kinds = F.zip_with(F.split("seed", ""), F.split(F.reverse(F.substring("word", 2, k)), ""), lambda a, b: F.when(F.concat(a, b).isin("AU", "UA", "GC", "CG"), "W").when(F.concat(a, b).isin("GU", "UG"), "G").otherwise("x"))
    tried = words.crossJoin(F.broadcast(seeds)).withColumn("kinds", F.array_join(kinds, ""))
    bad = F.length(F.regexp_replace("kinds", "[WG]", ""))
    good = F.length(F.regexp_replace("kinds", "[^W]", ""))
    return tried.where((bad <= deviations) & (F.contains("kinds", F.lit("WWWW")) | (good >= k - 1)))


def disturbance(words: DataFrame, table: DataFrame) -> DataFrame:
    """(d7 + d6 / 10 + d5 / 100) / 3 from counts (kmer, n) of each word's prefixes of 7, 6 and 5 letters."""
    out = words
    for k in (7, 6, 5):
        out = out.join(table.select(F.col("kmer").alias(f"_k{k}"), F.col("n").alias(f"d{k}")), F.substring("word", 1, k) == F.col(f"_k{k}"), "left").drop(f"_k{k}")
    zero = lambda k: F.coalesce(F.col(f"d{k}"), F.lit(0))
    return out.withColumn("disturbance", (zero(7) + zero(6) / 10 + zero(5) / 100) / 3)
