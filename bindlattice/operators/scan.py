"""The scan of guides against transcripts for seeds with supplements alone; site_scan has all classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindlattice.functions import sequence as seq
from bindlattice.operators import sites as site
from bindlattice.operators.joins import band_join, small

#: Guide letters (from, to) of the seed lists and of the supplementary lists, by offset.
SEED_SLICES = ((2, 5), (3, 6), (4, 7))
SUPP_SLICES = ((13, 16), (14, 17))


def _hits(words: DataFrame, guides: DataFrame, variants: Column, offset: int) -> DataFrame:
    """(guide_id, transcript_id, pos, offset) where a transcript holds one of the guide's words."""
    wanted = guides.select("guide_id", F.explode(variants).alias("word"))
    return words.join(small(wanted), "word").select("guide_id", "transcript_id", "pos", F.lit(offset).alias("offset")).distinct()


def seed_sites(words: DataFrame, guides: DataFrame) -> DataFrame:
    """Seed hits: plain ones, offset ones no plain hit covers one letter on, distant ones that none of them covers one or two on."""
    lists = [_hits(words, guides, F.array(seq.reverse_complement(seq.region("sequence", *s))), k) for k, s in enumerate(SEED_SLICES)]
    key = ["guide_id", "transcript_id", "pos"]

    def uncovered(sites: DataFrame, by: DataFrame, shift: int) -> DataFrame:
        return sites.join(by.select("guide_id", "transcript_id", (F.col("pos") - shift).alias("pos")), key, "left_anti")

    bag = lists[0].unionByName(uncovered(lists[1], lists[0], 1))
    return bag.unionByName(uncovered(uncovered(lists[2], bag, 1), bag, 2))


def supp_sites(words: DataFrame, guides: DataFrame) -> DataFrame:
    lists = [_hits(words, guides, seq.complements_with_wobbles(seq.region("sequence", *s)), k) for k, s in enumerate(SUPP_SLICES)]
    return lists[0].unionByName(lists[1])


def supp_class(kinds: Column) -> Column:
    """Class of the supplementary part by the pair kinds of guide letters 13 to 17: W, G or x."""
    bound = F.translate(kinds, "WG", "++")
    return F.when(bound == "+++++", "5mer").when(bound.startswith("++++"), "4mer").when(F.substring(bound, 2, 4) == "++++", "offset-4mer").otherwise("suppless")


def scan(guides: DataFrame, transcripts: DataFrame, least_bridge: int = site.LEAST_BRIDGE, most_bridge: int = site.MOST_BRIDGE, max_kd: float | None = None) -> DataFrame:
    """Sites of every guide (guide_id, sequence) in every transcript (transcript_id, sequence).

    Seed and supplementary hits are found by equi-joins on four-letter words and
    paired by a band join on the bridge between them; the 31-letter window must lie
    in the transcript.  Each row has both hits, bridge, window, pair kinds, seed and
    supplementary class and kd; of the sites of one seed hit the one with the
    shortest bridge stays (ties: the plain supplementary list).
    """
    words = transcripts.select("transcript_id", F.posexplode(seq.kmers("sequence", 4)).alias("pos", "word"))
    seeds = seed_sites(words, guides).select("guide_id", "transcript_id", (F.col("pos") + 3 + F.col("offset")).alias("g2"), F.col("offset").alias("seed_offset"))
    supps = supp_sites(words, guides).select("guide_id", "transcript_id", (F.col("pos") + 3 + F.col("offset")).alias("g13"), F.col("offset").alias("supp_offset"))
    pairs = band_join(seeds, supps, ["guide_id", "transcript_id"], "g2", "g13", least_bridge + 7, most_bridge + 7)
    pairs = pairs.withColumn("bridge", F.col("g2") - F.col("g13") - 7)
    best = pairs.groupBy("guide_id", "transcript_id", "g2", "seed_offset").agg(F.min(F.struct("bridge", "supp_offset")).alias("s"))
    placed = best.select("guide_id", "transcript_id", "g2", "seed_offset", "s.bridge", "s.supp_offset")
    placed = placed.join(transcripts.select("transcript_id", F.col("sequence").alias("_t")), "transcript_id").join(guides.select("guide_id", F.col("sequence").alias("_g")), "guide_id")
    placed = placed.where(f"g2 - {site.WINDOW - 2} >= 0 and g2 + 1 < length(_t)")
    window = F.substring(F.col("_t"), F.col("g2") - (site.WINDOW - 3), F.lit(site.WINDOW))
    supp_kind = lambda g: site.pair_kind(F.substring("_g", g, 1), F.substring(F.col("_t"), F.col("g2") - F.col("bridge") - 6 - (g - 13), F.lit(1)))
    placed = placed.withColumn("window", window).withColumn("kinds", site.seed_kinds(F.col("_g"), F.col("window")))
    placed = placed.withColumn("supp_class", supp_class(F.concat(*map(supp_kind, range(13, 18))))).withColumn("seed_class", site.seed_class(F.col("kinds"), F.substring("window", site.WINDOW, 1)))
    done = placed.withColumn("kd", site.kd(F.col("seed_class"), F.col("kinds"))).drop("_t", "_g")
    return done if max_kd is None else done.where(F.col("kd") <= max_kd)


#: Bounds of the older scan on the letters between those opposite guide letters 9 and 12.
OLDER_LEAST, OLDER_MOST = 3, 15


def older_scan(guides: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(guide_id, transcript_id, seed, supp, bridge) of the older scan, one row a seed hit.

    Seeds are exact hits of letters 2-5, supplements exact hits of 13-16 without wobbles, and
    the bridge runs from letter 9 to letter 12.  A seed takes the first supplement in reach
    (supp is its place), or stands alone (supp is null) with a bridge of 3; the 31-letter
    window must lie in the transcript.
    """
    words = transcripts.select("transcript_id", F.length("sequence").alias("size"), F.posexplode(seq.kmers("sequence", 4)).alias("pos", "word"))
    place = ["guide_id", "transcript_id"]

    def hits(first: int, name: str) -> DataFrame:
        wanted = guides.select("guide_id", seq.reverse_complement(seq.region("sequence", first, first + 3)).alias("word")).where("length(word) = 4")
        return words.join(small(wanted), "word").select(*place, "size", F.col("pos").alias(name))

    seeds = hits(2, "seed").where(f"seed + 3 - {site.WINDOW - 2} >= 0 and seed + 4 < size").drop("size")
    pairs = band_join(seeds, hits(13, "supp").drop("size"), place, "seed", "supp", OLDER_LEAST + 8, OLDER_MOST + 8)
    first = pairs.groupBy(*place, "seed").agg(F.min("supp").alias("supp"))
    bridge = F.coalesce(F.col("seed") - F.col("supp") - 8, F.lit(OLDER_LEAST))
    return seeds.join(first, [*place, "seed"], "left").select(*place, "seed", "supp", bridge.alias("bridge"))
