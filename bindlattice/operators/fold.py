"""Secondary structure and alignment of short strings, one string a row.

The dynamic programmes are quadratic to cubic in a string's length, so the unit of
parallelism is the row; Arrow batches carry strings to numpy and back.  Energies
are a parameter: a table of stacking energies by neighbouring pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Published stacking energies at 37 degrees, kcal/mol, by 5'-pair and next pair.
STACK = {
    "AU": {"AU": -0.93, "CG": -2.24, "GC": -2.08, "UA": -1.10, "GU": -0.55, "UG": -1.36},
    "CG": {"AU": -2.11, "CG": -3.26, "GC": -2.36, "UA": -2.08, "GU": -1.41, "UG": -2.11},
    "GC": {"AU": -2.35, "CG": -3.42, "GC": -3.26, "UA": -2.24, "GU": -1.53, "UG": -2.51},
    "UA": {"AU": -1.33, "CG": -2.35, "GC": -2.11, "UA": -0.93, "GU": -1.00, "UG": -1.27},
    "GU": {"AU": -1.27, "CG": -2.51, "GC": -2.11, "UA": -1.36, "GU": 0.47, "UG": 1.29},
    "UG": {"AU": -1.00, "CG": -1.53, "GC": -1.41, "UA": -0.55, "GU": 0.30, "UG": 0.47},
}
HAIRPIN, LEAST_HAIRPIN, INTERIOR, MOST_INTERIOR, BRANCH = 4.5, 3, 1.7, 10, 3.4


def fold_one(s: str) -> tuple[float, str]:
    """Least energy and structure of one string: hairpins, stacks, interior loops, branches."""
    n = len(s)
    pair = [[a + b if a + b in STACK else "" for b in s] for a in s]
    v, w = np.full((n + 1, n + 1), np.inf), np.zeros((n + 2, n + 2))
    back_v: dict[tuple[int, int], tuple] = {}
    back_w: dict[tuple[int, int], tuple] = {}
    for d in range(LEAST_HAIRPIN + 1, n):
        for i in range(n - d):
            j = i + d
            if pair[i][j]:
                best, how = HAIRPIN + 0.1 * (d - 4), ("h",)
                for p in range(i + 1, min(i + MOST_INTERIOR + 2, j - LEAST_HAIRPIN - 1)):
                    for q in range(j - 1, max(p + LEAST_HAIRPIN, j - MOST_INTERIOR - 2 + (p - i - 1)), -1):
                        if v[p, q] < np.inf:
                            loop = p - i - 1 + j - q - 1
                            e = v[p, q] + (STACK[pair[i][j]][pair[p][q]] if not loop else INTERIOR + 0.2 * loop)
                            if e < best:
                                best, how = e, ("i", p, q)
                for k in range(i + LEAST_HAIRPIN + 2, j - LEAST_HAIRPIN - 2):
                    e = w[i + 1, k] + w[k + 1, j - 1] + BRANCH
                    if w[i + 1, k] < 0 and w[k + 1, j - 1] < 0 and e < best:
                        best, how = e, ("m", k)
                v[i, j], back_v[i, j] = best, how
            best, how = w[i + 1, j], ("l",)
            if w[i, j - 1] < best:
                best, how = w[i, j - 1], ("r",)
            if v[i, j] < best:
                best, how = v[i, j], ("p",)
            for k in range(i + LEAST_HAIRPIN + 1, j - LEAST_HAIRPIN):
                if w[i, k] + w[k + 1, j] < best:
                    best, how = w[i, k] + w[k + 1, j], ("s", k)
            w[i, j], back_w[i, j] = best, how
    out, todo = ["."] * n, [("w", 0, n - 1)]
    while todo:
        kind, i, j = todo.pop()
        how = (back_w if kind == "w" else back_v).get((i, j))
        if how is None or (kind == "w" and w[i, j] >= 0):
            continue
        if kind == "w":
            todo += {"l": [("w", i + 1, j)], "r": [("w", i, j - 1)], "p": [("v", i, j)]}.get(how[0]) or [("w", i, how[1]), ("w", how[1] + 1, j)]
        else:
            out[i], out[j] = "(", ")"
            todo += {"h": [], "i": [("v", *how[1:])]}.get(how[0], [("w", i + 1, how[-1]), ("w", how[-1] + 1, j - 1)] if how[0] == "m" else [])
    return (float(min(w[0, n - 1], 0.0)) if n else 0.0), "".join(out)


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        done = [fold_one(s or "") for s in f["sequence"]]
        yield pd.DataFrame({"id": f["id"], "energy": [e for e, _ in done], "structure": [x for _, x in done]})


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt over the cores by id: a small file, which is one task, can hold hours of work."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "id")


def fold(rows: DataFrame) -> DataFrame:
    """id, energy and structure of each (id, sequence)."""
    return dealt(rows.select("id", "sequence")).mapInPandas(_fold, "id long, energy double, structure string")


def duplex(rows: DataFrame, linker: str = "AAAAGGAAACAAAA") -> DataFrame:
    """Fold of target and guide joined by a linker: id, energy, structure; rows are (id, target, guide)."""
    return fold(rows.select("id", F.concat("target", F.lit(linker), "guide").alias("sequence")))


def pairs_of(structures: DataFrame) -> DataFrame:
    """(id, i, j) of each base pair of a dot-bracket structure.

    Depth is a running sum; an opening bracket pairs with the next closing one of
    its depth, so pairs come from one window instead of a stack.
    """
    from pyspark.sql import Window

    at = structures.select("id", F.posexplode(F.split("structure", "")).alias("pos", "c")).where("c in ('(', ')')")
    step = F.when(F.col("c") == "(", 1).otherwise(-1)
    depth = F.sum(step).over(Window.partitionBy("id").orderBy("pos")) + F.when(F.col("c") == ")", 1).otherwise(0)
    near = at.withColumn("depth", depth)
    follow = F.lead("pos").over(Window.partitionBy("id", "depth").orderBy("pos"))
    return near.withColumn("j", follow).where("c = '('").select("id", F.col("pos").alias("i"), "j")


def contact_map(structures: DataFrame) -> DataFrame:
    """Weighted frequency of each pair over structures (id, key, weight, structure)."""
    weights = structures.select("id", "key", "weight")
    total = weights.groupBy("key").agg(F.sum("weight").alias("all"))
    met = pairs_of(structures).join(weights, "id").groupBy("key", "i", "j").agg(F.sum("weight").alias("w"))
    return met.join(total, "key").select("key", "i", "j", (F.col("w") / F.col("all")).alias("frequency"))


def align_one(a: str, b: str, match: float, mismatch: float, opening: float, extend: float) -> float:
    """Best global score with affine gaps; a gap of length g costs opening + (g - 1) * extend."""
    m = np.full(len(b) + 1, -np.inf)
    m[0] = 0.0
    left = np.where(np.arange(len(b) + 1) > 0, opening + extend * (np.arange(len(b) + 1) - 1), -np.inf)
    best = np.maximum(m, left)
    up = np.full(len(b) + 1, -np.inf)
    letters = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    for i, x in enumerate(a):
        up = np.maximum(best + opening, up + extend)
        score = np.where(letters == ord(x), match, mismatch)
        now = np.concatenate(([-np.inf], best[:-1] + score))
        best = np.maximum(now, up)
        gap = -np.inf
        for j in range(1, len(b) + 1):
            gap = max(best[j - 1] + opening, gap + extend)
            best[j] = max(best[j], gap)
        del i
    return float(best[-1])


def _align(frames: Iterator[pd.DataFrame], costs: tuple[float, ...]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"id": f["id"], "score": [align_one(a or "", b or "", *costs) for a, b in zip(f["a"], f["b"], strict=True)]})


def align(rows: DataFrame, match: float = 2.0, mismatch: float = -3.0, opening: float = -5.0, extend: float = -1.0) -> DataFrame:
    """Global affine-gap alignment score of each (id, a, b)."""
    return dealt(rows.select("id", "a", "b")).mapInPandas(partial(_align, costs=(match, mismatch, opening, extend)), "id long, score double")


def structure_graph(structures: DataFrame, most: int = 3) -> DataFrame:
    """Pairs of structures (key, id) of one key whose dot-brackets differ in at most ``most`` places.

    Equal-length strings within ``most`` places agree on one of ``most`` + 1 pieces,
    so only structures that share a piece meet, and they meet at the first one they share.
    Equal structures of a key are held against others once; their ids come in at the end.
    """
    rows = structures.where("structure is not null").select("key", "id", "structure").distinct()
    every = rows.select("key", "structure").distinct()
    width = F.ceil(F.length("structure") / (most + 1))
    piece = lambda c, i: F.substring(c, (i * width + 1).cast("int"), width.cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(i.alias("at"), piece(F.col("structure"), i).alias("piece")))
    cut = every.select("key", "structure", F.length("structure").alias("n"), F.explode(pieces).alias("p")).select("key", "n", "structure", "p.at", "p.piece")
    other = cut.select("key", "n", "at", "piece", F.col("structure").alias("theirs"))
    earlier = F.exists(F.sequence(F.lit(0), F.lit(most)), lambda i: (i < F.col("at")) & (piece(F.col("structure"), i) == piece(F.col("theirs"), i)))
    apart = F.size(F.filter(F.zip_with(F.split("structure", ""), F.split("theirs", ""), lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    met = cut.join(other, ["key", "n", "at", "piece"]).where("structure < theirs").withColumn("apart", apart).where(F.col("apart") <= most).where(~earlier)
    ours, theirs = rows.select("key", "structure", F.col("id").alias("a")), rows.select("key", F.col("structure").alias("theirs"), F.col("id").alias("b"))
    near = met.select("key", "structure", "theirs", "apart").join(ours, ["key", "structure"]).join(theirs, ["key", "theirs"]).where("a <> b")
    same = ours.join(theirs.withColumnRenamed("theirs", "structure"), ["key", "structure"]).where("a < b")
    return near.select("key", F.least("a", "b").alias("id"), F.greatest("a", "b").alias("other"), "apart").unionByName(same.select("key", F.col("a").alias("id"), F.col("b").alias("other"), F.lit(0).alias("apart")))
