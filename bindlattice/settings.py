"""Settings from the environment, parameters of a scan as the command line and the web call give them, and error codes."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace
from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindlattice.functions import sequence as seq
from bindlattice.operators import joins
from bindlattice.operators import site_scan as scanning
from bindlattice.operators import sites as site

# Names of environment variables.
VARIABLES = ("DB_PATH", "GENCODE_FASTA", "MIRNAS_FA", "DATA_PATH", "HG_FASTA", "HG_LOCATIONS", "HG_BUFFER", "WORKING_DIR", "GUIDES_PATH")


class ScanError(IntEnum):
    """Why a scan cannot run."""

    OK = 0
    NO_TRANSCRIPT = 1
    NO_GUIDE = 2
    BAD_SEED = 3
    BAD_LIMIT = 4
    NO_REGION = 5


@dataclass(frozen=True)
class Filters:
    """Conditions on the sites that a scan keeps; the defaults are those of the command line."""

    min_seed: str = "seedless"
    max_kd: float = 1500.0
    utr5: bool = True
    cds: bool = True
    utr3: bool = True
    seed_access: float = 0.15
    supp_access: float = 0.0
    supp_paired: bool = False
    conserved: int = 0

    @staticmethod
    def of_request(request: Mapping[str, object]) -> Filters:
        """Filters of a web call: no seed means 6mer, a limit of 0 or none means 1500."""
        given = {
            "min_seed": request.get("minSeed") or "6mer", "max_kd": float(request.get("maxKd") or 1500.0), "utr5": bool(request.get("UTR5", False)), "cds": bool(request.get("CDS", True)),
            "utr3": bool(request.get("UTR3", True)), "seed_access": float(request.get("seedAccessible") or 0.0), "supp_access": float(request.get("supplementaryAccessible") or 0.0),
            "supp_paired": bool(request.get("supplementaryPaired", False)), "conserved": int(request.get("conserved") or 0),
        }
        return Filters(**given)

    def check(self) -> ScanError:
        if self.min_seed != "seedless" and self.min_seed not in ("4mer", "5mer", "6mer", "7mer"):
            return ScanError.BAD_SEED
        if not self.max_kd > 0:
            return ScanError.BAD_LIMIT
        return ScanError.OK if self.utr5 or self.cds or self.utr3 else ScanError.NO_REGION

    def condition(self) -> object:
        return site.keeps_interaction(self.max_kd, self.min_seed, self.utr5, self.cds, self.utr3, self.seed_access, self.supp_access, self.supp_paired, self.conserved)

    def but(self, **changes: object) -> Filters:
        return replace(self, **changes)


def environment() -> dict[str, str]:
    """The settings that are given, by name."""
    return {name: os.environ[name] for name in VARIABLES if os.environ.get(name)}


def annotated(sites: DataFrame, coding: DataFrame | None = None, unpaired: DataFrame | None = None, conserved: DataFrame | None = None) -> DataFrame:
    """Sites of a scan with region, seed_acc, supp_acc and conservation.

    coding: transcript_id, cds_start, cds_end (places, both counted); unpaired: transcript_id
    and an array ``p``, for each place how likely it pairs; conserved: transcript_id, start,
    end, value, half-open.  Conservation is 31 times the mean over the window, rounded, and
    the mean is -1 where no value lies in it.  What is not given lets every site pass: all
    regions, accessibility 1, conservation -1 (no score).  Transcripts without a row in a
    given table have no region, no accessibility and no conserved place.  The given tables
    have a row a transcript or more, so none is broadcast, however small its files are.
    """
    start, end, g13 = F.col("g2") - (site.WINDOW - 2), F.col("g2") + 1, F.col("g2") - 7 - F.col("bridge")
    out = sites.withColumn("supp_type", F.col("supp_class"))
    if coding is None:
        out = out.withColumn("region", F.lit("5UTR and CDS and 3UTR"))
    else:
        bounds = coding.select("transcript_id", "cds_start", "cds_end")
        label = F.when(F.col("cds_start").isNull(), "").otherwise(seq.region_label(start, end, F.col("cds_start"), F.col("cds_end")))
        out = out.join(bounds.hint("merge"), "transcript_id", "left").withColumn("region", label).drop("cds_start", "cds_end")
    if unpaired is None:
        out = out.withColumns({"seed_acc": F.lit(1.0), "supp_acc": F.lit(1.0)})
    else:
        least = lambda b: F.coalesce(1 - F.array_min(F.slice("p", b + 1, F.lit(4))), F.lit(0.0))
        out = out.join(unpaired.select("transcript_id", "p").hint("merge"), "transcript_id", "left").withColumns({"seed_acc": least(F.col("g2") - 3), "supp_acc": least(g13 - 3)}).drop("p")
    if conserved is None:
        return out.withColumn("conservation", F.lit(-1))
    # A window is asked once, however many sites share it.
    asked = out.select("transcript_id", "g2").distinct().withColumns({"q_start": start.cast("long"), "q_end": (end + 1).cast("long"), "probe": F.struct("transcript_id", "g2")})
    mean = joins.overlap_mean(conserved.hint("merge"), asked, "transcript_id", "probe", "value", 4 * site.WINDOW)
    score = mean.select("probe.transcript_id", "probe.g2", F.round(site.WINDOW * F.col("mean")).cast("int").alias("conservation"))
    return out.join(score, ["transcript_id", "g2"])


def scan(guides: DataFrame, transcripts: DataFrame, filters: Filters = Filters(), coding: DataFrame | None = None, unpaired: DataFrame | None = None, conserved: DataFrame | None = None) -> DataFrame:
    """Sites of guides in transcripts that pass every filter; an error code where the filters contradict themselves.

    See ``annotated`` for the tables that region, accessibility and conservation are read from.
    """
    error = filters.check()
    if error:
        raise ValueError(f"{int(error)}: {error.name}")
    found = scanning.scan_sites(guides, transcripts, max_kd=filters.max_kd)
    return annotated(found, coding, unpaired, conserved).where(filters.condition()).drop("supp_type")
