"""Seeds that bind nine-letter targets with one bulge at most, by an equi-join on patterns.

A seed of seven letters lies on a target of nine in 47 ways: on seven letters in a row
(3), on six with one seed letter bulged out (28), on seven of eight with one target
letter bulged out (16).  It binds if, in one of them, four neighbouring letters of the
first six pair by Watson-Crick, or if at least six pairs are Watson-Crick and one
mismatch or bulge is all that is wrong.  Either condition fixes some letters of the seed
and leaves the others open, so each target has a few dozen patterns such as ``..ACGU.``,
each seed has eleven strings that a pattern can have, and targets meet seeds where these
are equal; nothing goes through all seeds times all targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindlattice.functions import sequence as seq
from bindlattice.operators.joins import small

#: Letters of a seed and of a target, and those of a core within the first six.
SEED, TARGET, CORE, WITHIN = 7, 9, 4, 6
_NONE = "-"


def alignments() -> list[tuple[str, bool]]:
    """For each alignment the target's index opposite each seed letter, a dash opposite one bulged out, and whether a target letter is."""
    out = [("".join(str(start + i) for i in range(SEED)), False) for start in range(TARGET - SEED + 1)]
    for start in range(TARGET - SEED + 2):
        for bulge in range(SEED):
            faced = [str(start + i - (i > bulge)) for i in range(SEED)]
            out.append(("".join(faced[:bulge] + [_NONE] + faced[bulge + 1 :]), False))
    for start in range(TARGET - SEED):
        for bulge in range(SEED + 1):
            out.append(("".join(str(start + i + (i >= bulge)) for i in range(SEED)), True))
    return out


def _shown(letters: Column, places: list[int]) -> Column:
    """The letters at some places, full stops at all others."""
    return F.concat(*(F.substring(letters, i + 1, 1) if i in places else F.lit(".") for i in range(SEED)))


def _cores() -> list[list[int]]:
    return [list(range(start, start + CORE)) for start in range(WITHIN - CORE + 1)]


def target_patterns(targets: DataFrame) -> DataFrame:
    """(word, pattern) of each distinct nine-letter target in ``word``; words of other lengths or letters have none."""
    words = targets.select("word").distinct().where(F.col("word").rlike(f"^[ACGU]{{{TARGET}}}$"))
    ways = F.array(*(F.struct(F.lit(at).alias("at"), F.lit(bulged).alias("bulged")) for at, bulged in alignments()))
    each = words.select("word", F.explode(ways).alias("way"))

    def partner(i: int) -> Column:
        at = F.substring("way.at", i + 1, 1)
        return F.when(at == _NONE, _NONE).otherwise(seq.complement(F.substring(F.col("word"), at.try_cast("int") + 1, F.lit(1))))

    faced = each.select("word", "way.bulged", F.concat(*map(partner, range(SEED))).alias("p"))
    p, whole = F.col("p"), ~F.contains(F.col("p"), F.lit(_NONE))
    cores = [F.when(~F.contains(F.substring(p, core[0] + 1, CORE), F.lit(_NONE)), _shown(p, core)) for core in _cores()]
    # One mismatch; a right letter there makes a seed without any, which has a core anyway.
    but_one = [F.when(whole & ~F.col("bulged"), _shown(p, [j for j in range(SEED) if j != i])) for i in range(SEED)]
    bulges = [F.when(~whole, F.translate(p, _NONE, ".")), F.when(F.col("bulged"), p)]
    patterns = F.array_compact(F.array(*cores, *but_one, *bulges))
    return faced.select("word", F.explode(patterns).alias("pattern")).distinct()


def seed_patterns(seeds: DataFrame) -> DataFrame:
    """(seed, pattern): the eleven patterns that each distinct seed in ``seed`` fits."""
    masks = [*_cores(), *([j for j in range(SEED) if j != i] for i in range(SEED)), list(range(SEED))]
    words = seeds.select("seed").distinct().where(F.col("seed").rlike(f"^[ACGU]{{{SEED}}}$"))
    return words.select("seed", F.explode(F.array(*(_shown(F.col("seed"), m) for m in masks))).alias("pattern"))


def all_seeds(spark: SparkSession) -> DataFrame:
    return spark.range(4**SEED).select(seq.from_base4(F.col("id"), SEED).alias("seed"))


def compatible(targets: DataFrame, seeds: DataFrame) -> DataFrame:
    """(word, seed) of every target in ``word`` and seed in ``seed`` that binds it, once each."""
    return target_patterns(targets).join(small(seed_patterns(seeds)), "pattern").select("word", "seed").distinct()


def seed_sites(guides: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(guide_id, transcript_id, pos) of each place of a transcript (transcript_id, sequence) whose nine letters the seed, letters 2 to 8, of a guide (guide_id, sequence) binds when read backwards.

    A seed pairs with the target in the opposite direction, so targets are read from their end.
    """
    named = guides.select("guide_id", seq.region("sequence", 2, 8).alias("seed"))
    places = transcripts.select("transcript_id", F.posexplode(seq.kmers("sequence", TARGET)).alias("pos", "read"))
    places = places.select("transcript_id", "pos", F.reverse("read").alias("word"))
    bound = compatible(places, named).join(small(named), "seed").select("word", "guide_id")
    return places.join(small(bound), "word").select("guide_id", "transcript_id", "pos")
