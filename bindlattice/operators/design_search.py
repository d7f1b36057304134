"""The search for guides that bind every required transcript and no excluded one.

A guide stays if each required transcript has a site of it, so transcripts are taken in
rounds, one, then two, four and so on, and only guides that passed go on; most fail on the
first.  Sites come from the whole scan.  Transcripts are (transcript_id, sequence), guides
(guide_id, sequence); how many transcripts are required is a matter of the question, their
letters and the guides may be any number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindlattice.functions import sequence as seq
from bindlattice.operators import design, site_scan
from bindlattice.operators.graph import checkpointed


def covering(guides: DataFrame, required: DataFrame, max_kd: float) -> DataFrame:
    """Guides with at least one site of kd <= max_kd in every required transcript; all of them where none is required."""
    # One row a transcript: its place among the required ones, short ones first, which are scanned soonest.
    rank = F.row_number().over(Window.orderBy(F.length("sequence"), "transcript_id"))
    ranked = checkpointed(required.dropDuplicates(["transcript_id"]).withColumn("rank", rank))
    n = ranked.count()
    left, done, width = checkpointed(guides.select("guide_id", "sequence")), 0, 1
    while done < n and not left.isEmpty():
        part = ranked.where((F.col("rank") > done) & (F.col("rank") <= done + width))
        found = site_scan.scan_sites(left, part.select("transcript_id", "sequence"), max_kd).select("guide_id", "transcript_id").distinct()
        passed = found.groupBy("guide_id").agg(F.count("*").alias("n")).where(F.col("n") == min(width, n - done)).select("guide_id")
        left = checkpointed(left.join(passed, "guide_id", "left_semi"))
        done, width = done + width, 2 * width
    return left


def binds_any(guides: DataFrame, excluded: DataFrame, max_kd: float) -> DataFrame:
    """Guides with a seed and a supplement that bind some excluded transcript at one site of kd <= max_kd."""
    sites = site_scan.scan_sites(guides, excluded, max_kd).where(F.col("kind").endswith("+supp") & (F.col("seed_class") != "seedless") & (F.col("supp_class") != "suppless"))
    return guides.join(sites.select("guide_id").distinct(), "guide_id", "left_semi")


def candidates(required: DataFrame, excluded_parts: list[str], most: int = 15) -> DataFrame:
    """(guide_id, grip, sequence): the strings made for every grip, of four letters behind and three before, that all required transcripts have."""
    found = design.grips(required, 4, 3, most)
    shared = design.required_grips(found.select("grip", "transcript_id"), required)
    words = shared.select("grip", seq.reverse_complement(F.substring_index("grip", "/", 1)).alias("seed4"), seq.reverse_complement(F.substring_index("grip", "/", -1)).alias("supp3"))
    made = design.antisense_candidates(words, excluded_parts)
    return made.select(F.concat("grip", F.lit(" "), "antisense").alias("guide_id"), "grip", F.col("antisense").alias("sequence"))


def search(required: DataFrame, excluded: DataFrame, max_kd: float, excluded_kd: float, excluded_parts: list[str] | None = None, most: int = 15) -> DataFrame:
    """(grip, sequence) of the strings that bind every required transcript and, at excluded_kd, no excluded one."""
    required = checkpointed(required.select("transcript_id", "sequence"))
    made = checkpointed(candidates(required, excluded_parts or [], most))
    passed = covering(made, required, max_kd)
    kept = passed.join(binds_any(passed, excluded, excluded_kd), "guide_id", "left_anti")
    return made.join(kept.select("guide_id"), "guide_id", "left_semi").select("grip", "sequence")
