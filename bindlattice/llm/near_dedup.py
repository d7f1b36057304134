"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact verification.

Plan
----
1. One pass over the texts gives each document the size of its shingle set, a
   128-bit fingerprint of the set, band keys and a signature.
2. Documents with equal sets form a class (aggregation by fingerprint, so copies
   never meet as pairs); its least doc_id stands for it.
3. Representatives that share a band key form a bucket.  For each of them the
   shingles are counted that no other bucketed document has.  They bound the
   intersection with any partner; a member that even this bound keeps below the
   threshold leaves the bucket.  Heavily edited copies of a large group go here,
   without meeting the group.
4. Round one sends each member to one bucket leader only, the leader whose
   signature agrees best.  Leaders have the fewest shingles of their own, so they
   are the texts that the others were copied from.
5. Pairs pass the sequential test: signatures are compared in batches, and a pair
   goes as soon as the posterior probability that its similarity reaches the
   threshold is under ``miss``.  What stays is verified on the full sets.
6. Round two takes what round one left open: members outside their bucket's largest
   component meet members of other components with which they share one of their
   rarest shingles.  A pair is left out only when both ends are connected already
   or the prefix rules a link out, so no link between components is lost, and
   large groups never emit all their pairs.
7. Components come from star contraction over the verified links.

Defined results
---------------
* null or wordless text: n_shingles 0, linked with nothing, its own component;
* fewer than five words: the whole sequence is the one shingle;
* rows that share a doc_id are one node; a link to either text links the node;
* null doc_id: n_shingles is given, component_id is null and kept is false;
* an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindlattice.llm import textkit
from bindlattice.llm.common import arrow_map, batch, quoted, read, small, stage
from bindlattice.llm.components import components

BANDS, ROWS = 28, 5
#: Chosen probability that the sequential test drops a true link at one step.
MISS = 1e-6
#: Leaves that one task verifies against a copy of their centre.
LEAVES = 256

_RANDOM = np.random.default_rng(20240607)
_XOR = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(sets: np.ndarray) -> np.ndarray:
    """MinHash values of a nonempty set of 64-bit hashes."""
    low = sets.astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        part = (low[None, i : i + 2048] ^ _XOR[:, None]) * _ODD[:, None]
        part ^= part >> np.uint32(15)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _document_sets(column: pa.Array) -> Iterator[np.ndarray]:
    raw, offsets = textkit.buffers(column)
    for i, j in textkit.slices(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, before = textkit.words(part, at)
        hashes = textkit.word_hashes(part, start, end)
        for k in range(j - i):
            yield textkit.shingles(hashes[before[k] : before[k + 1]])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, prints, signs, keys = [], [], [], []
        for s in _document_sets(b.column(1)):
            n.append(len(s))
            if not len(s):
                prints.append(None), signs.append(None), keys.append(None)
                continue
            sig = signature(s)
            prints.append(xxhash.xxh3_128_digest(s.tobytes()))
            signs.append((sig >> np.uint32(16)).astype(np.uint16).tobytes())
            banded = np.zeros(BANDS, np.uint64)
            for r in range(ROWS):
                banded = textkit.mix(banded * np.uint64(31) + sig.reshape(BANDS, ROWS)[:, r].astype(np.uint64) + np.uint64(1))
            keys.append(banded.view(np.int64))
        yield batch(doc_id=b.column(0), n_shingles=pa.array(n, pa.int64()), print=pa.array(prints, pa.binary()), sig=pa.array(signs, pa.binary()), bands=pa.array(keys, pa.list_(pa.int64())))


def least_matches(threshold: float, miss: float, steps: list[int]) -> list[int]:
    """For n compared values, the fewest matches at which P(similarity >= threshold) is still ``miss`` or more.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1);
    its upper tail at t is the chance of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in steps:
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                out.append(m)
                break
        else:
            out.append(n)
    return out


def _prune(batches: Iterator[pa.RecordBatch], bounds: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    width = BANDS * ROWS
    for b in batches:
        if not b.num_rows:
            continue
        pair = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, width) for i in (2, 3)]
        live, seen = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
        at = 0
        for n, fewest in bounds:
            seen[live] += (pair[0][live, at:n] == pair[1][live, at:n]).sum(axis=1)
            live, at = live[seen[live] >= fewest], n
        yield batch(leaf=b.column(0).take(pa.array(live)), centre=b.column(1).take(pa.array(live)), agree=pa.array(seen[live]))


def _pruned(pairs: DataFrame, signs: DataFrame, threshold: float, miss: float) -> DataFrame:
    steps = list(range(BANDS, BANDS * ROWS + 1, BANDS))
    bounds = list(zip(steps, least_matches(threshold, miss, steps), strict=True))
    sides = pairs.join(signs.select(F.col("rep").alias("leaf"), F.col("sig").alias("a")), "leaf")
    sides = sides.join(signs.select(F.col("rep").alias("centre"), F.col("sig").alias("b")), "centre")
    return arrow_map(sides.select("leaf", "centre", "a", "b"), partial(_prune, bounds=bounds), "leaf long, centre long, agree long")


def _send_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [s.tobytes() for s in _document_sets(b.column(4))]
        yield batch(id=b.column(0), centre=b.column(1), salt=b.column(2), leads=b.column(3), shingles=pa.array(raw, pa.binary()))


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come by (centre, salt), the centre's own sets first."""
    at, own = None, []
    for b in batches:
        leaf, centre = [], []
        for i, c, s, leads, raw in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if (c, s) != at:
                at, own = (c, s), []
            mine = np.frombuffer(raw, np.uint64)
            if leads:
                own.append(mine)
                continue
            for other in own:
                if not len(mine) or not len(other):
                    continue
                if 100 * min(len(mine), len(other)) < percent * max(len(mine), len(other)):
                    continue
                spot = np.searchsorted(other, mine)
                spot[spot == len(other)] = 0
                common = int((other[spot] == mine).sum())
                if 100 * common >= percent * (len(mine) + len(other) - common):
                    leaf.append(i), centre.append(c)
                    break
        yield batch(leaf=pa.array(leaf, pa.int64()), centre=pa.array(centre, pa.int64()))


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, name: str) -> DataFrame:
    """The (leaf, centre) pairs whose full sets are similar enough.

    Each leaf's set goes to its centre; the centre's set is copied once for
    every LEAVES leaves, so a large group is split over many tasks.
    """
    salts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / LEAVES).cast("int").alias("salts"))
    sends = pairs.join(salts, "centre").select(
        F.col("leaf").alias("doc_id"), "centre", F.pmod(F.xxhash64("leaf"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("leads")
    )
    own = salts.select(
        F.col("centre").alias("doc_id"), "centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("leads")
    )
    sends, _ = small(stage(sends.unionByName(own), f"{name}-sends"))
    sets = arrow_map(
        docs.join(sends, "doc_id").select("doc_id", "centre", "salt", "leads", "text"), _send_sets, "id long, centre long, salt int, leads boolean, shingles binary"
    )
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = sets.repartition(tasks, "centre", "salt").sortWithinPartitions("centre", "salt", F.col("leads").desc())
    return stage(arrow_map(dealt, partial(_verify, percent=percent), "leaf long, centre long"), f"{name}-links")


def _list_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [s.view(np.int64) for s in _document_sets(b.column(1))]
        yield batch(rep=b.column(0), shingles=pa.array(sets, pa.list_(pa.int64())))


def _sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, shingles) of the texts of these ids."""
    wanted, _ = small(reps.select(F.col("rep").alias("doc_id")))
    wanted = docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text")
    return stage(arrow_map(wanted, _list_sets, "rep long, shingles array<long>"), "sets")


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(rep, own): shingles of each that no other of them has; 0 for ids with several texts."""
    holders = sets.select("rep", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    alone = holders.where("rep = other").groupBy("rep").agg(F.count("*").alias("alone"))
    texts = sets.groupBy("rep").agg(F.count("*").alias("texts"))
    return texts.join(alone, "rep", "left").select("rep", F.when(F.col("texts") > 1, 0).otherwise(F.coalesce("alone", F.lit(0))).alias("own"))


def _prefix_pairs(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members in different components, one of them outside, that may be similar.

    Shingles are ranked in each set from the rarest among the members to the
    commonest.  Two sets of n1 and n2 with an intersection of at least
    o = percent * (n1 + n2) / (100 + percent) share one of their first n - o + 1
    shingles each, so joining on those loses no link, and what a large group has in
    common does not come up.
    """
    chosen, _ = small(members)
    n = F.size("shingles").cast("long")
    held = sets.join(chosen, "rep").select("rep", "component", "outside", n.alias("n"), F.xxhash64("shingles").alias("set"), F.explode("shingles").alias("s"))
    held = stage(held, "member-shingles")
    counted = held.join(held.groupBy("s").agg(F.count("*").alias("df")), "s")
    rank = F.row_number().over(Window.partitionBy("rep", "set").orderBy("df", "s"))
    first = counted.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(percent * F.col("n") / 100) + 1).drop("df", "set")
    first = stage(first, "prefixes")
    left = first.where("outside").select("s", F.col("rep").alias("leaf"), F.col("n").alias("n1"), F.col("r").alias("r1"), F.col("component").alias("one"))
    right = first.select(F.col("s").alias("s2"), F.col("rep").alias("centre"), F.col("n").alias("n2"), F.col("r").alias("r2"), F.col("component").alias("two"))
    least = f"ceil({percent} * (n1 + n2) / {100 + percent})"
    may_link = f"s = s2 and one <> two and r1 <= n1 - {least} + 1 and r2 <= n2 - {least} + 1"
    return left.join(right, F.expr(may_link)).select(F.greatest("leaf", "centre").alias("leaf"), F.least("leaf", "centre").alias("centre")).distinct()


def _possible(rows: DataFrame, percent: int) -> DataFrame:
    """Members (key, rep, n, common) that can have a partner in their bucket.

    A partner has at least percent / 100 of the n shingles and no fewer than the
    bucket's smallest member; the intersection is at most ``common``, and a link
    needs (100 + percent) * intersection >= percent * (n + the partner's n).
    """
    least = rows.groupBy("key").agg(F.min("n").alias("least"), F.count("*").alias("members")).where("members > 1").drop("members")
    partner = F.greatest("least", F.ceil(percent * F.col("n") / 100))
    return rows.join(least, "key").where((100 + percent) * F.col("common") >= percent * (F.col("n") + partner)).drop("least")


def _same_id(described: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes that one doc_id with several texts belongs to."""
    of = described.where("doc_id is not null").join(classes, "print").select("doc_id", "rep")
    least = of.groupBy("doc_id").agg(F.min("rep").alias("centre"), F.max("rep").alias("most")).where("centre < most")
    return of.join(least, "doc_id").where("rep <> centre").select(F.col("rep").alias("leaf"), "centre").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links have similarity of percent / 100 or more."""
    docs = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    described = stage(
        arrow_map(docs, _describe, "doc_id long, n_shingles long, print binary, sig binary, bands array<long>"), "described"
    )
    classes = described.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"))
    classes = stage(classes, "classes")
    led = described.join(classes, "print").where("doc_id = rep").select("rep", "n_shingles", "sig", "bands").dropDuplicates(["rep", "sig"])
    led = stage(led, "representatives")
    signs = led.select("rep", "sig")
    banded = led.select("rep", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "value")).select("rep", "n", F.xxhash64("band", "value").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    bucketed = stage(banded.join(shared, "key"), "buckets")
    sets = _sets(docs, bucketed.select("rep").distinct())
    own = _own_shingles(sets)
    rows = bucketed.join(own, "rep").groupBy("key", "rep").agg(F.max("n").alias("n"), F.max(F.col("n") - F.col("own")).alias("common"))
    rows = _possible(stage(rows, "rows"), percent)

    leaders = rows.groupBy("key").agg(F.min(F.struct(1 - F.col("common") / F.col("n"), "rep"))["rep"].alias("leader"))
    rows = stage(rows.join(leaders, "key"), "members")
    first = rows.where("rep <> leader").select(F.col("rep").alias("leaf"), F.col("leader").alias("centre")).distinct()
    best = (
        _pruned(first, signs, percent / 100, miss)
        .groupBy("leaf")
        .agg(F.max_by("centre", F.struct("agree", -F.col("centre"))).alias("centre"))
    )
    links = _verified(stage(best, "first"), docs, percent, "first").unionByName(_same_id(described, classes))
    found = components(links, "leaf", "centre")

    labelled = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("members"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("members", "component")).alias("largest")).where("parts > 1")
    members = labelled.join(mixed, "key").groupBy("rep", "component").agg(F.max(F.col("component") != F.col("largest")).alias("outside"))
    second = _prefix_pairs(sets, stage(members, "open"), percent)
    second = stage(_pruned(second, signs, percent / 100, miss).select("leaf", "centre").distinct(), "second")
    more = _verified(second, docs, percent, "second")
    found = components(links.unionByName(more), "leaf", "centre")

    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    out = described.select("doc_id", "n_shingles", "print").join(named, "print", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id")).alias("component_id"),
        (F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id")) & F.col("doc_id").isNotNull()).alias("kept"),
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)
