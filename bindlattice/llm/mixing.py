"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

All of it is DataFrame work on (doc_id, source, size) rows.

* Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and
  share 150 % of all words; a target stops at twice its source's words, and the
  excess is shared again by weight.  The fixed point is min(cap, level * weight)
  for one level, found from running sums over the table of sources.
* A hash of the document id orders each source at random.  Its leading bits deal
  the source into blocks of about BLOCK documents, so blocks in their order are a
  random permutation.  A source is taken whole as often as its target allows; the
  rest comes from the front of the permutation, up to a cut found from block sums,
  then inside one block.  No step gathers a source in one task.
* The drawn (source, epoch, block) slots are split among the output shards by a
  binary tree: a node's left half gets exactly half of the node's slots, a
  uniformly random subset, so the blocks it gets of each source follow the
  multivariate hypergeometric law and the quotas stay exact.  The subset is the
  slots of the smallest hashes, found by a histogram and one bucket's ranks.
* Inside a shard rows are ordered by one more hash.

Defined results: a null text has size 0; a source without words has target 0;
rows that share a doc_id and a source are taken together; null ids hash like any
value; no document is taken more than twice; an empty table gives no rows.  Equal
input gives equal output: all draws are hashes of ids and the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindlattice.llm.common import WORD, quoted, read, small, stage

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
#: Documents a block holds, about; shards of the output, a power of two; buckets of a node's histogram.
BLOCK, SHARDS, BUCKETS = 256, 16, 1024
MOST_SHARDS = 1024
COARSE = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, n, words, target of each source; the table has one row a source."""
    sources = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    ranked = sources.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("at") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", CAP * F.col("words"))
    everything = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    onward = everything.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (SHARE * F.sum("words").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levelled = weighed.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "at", "level"))).over(whole)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(final * F.col("weight"))
    return levelled.select("source", "n", "words", target.alias("target"))


def _order_key(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 1)


def _block() -> Column:
    """The leading ``bits`` bits of the 63 of u."""
    return F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(u, 63 - bits)"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; right's keys go."""
    renamed = right.select(*(F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(renamed, on).drop(*(f"_{k}" for k in keys))


def split_blocks(slots: DataFrame, shards: int, seed: int) -> DataFrame:
    """slots (source, epoch, block) with the output shard of each: the splitting tree."""
    if shards & (shards - 1) or not 0 < shards <= MOST_SHARDS:
        raise ValueError(f"shards must be a power of two up to {MOST_SHARDS}")
    now = slots.withColumn("shard", F.lit(0).cast("long"))
    for level in range(shards.bit_length() - 1):
        key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), "source", "epoch", "block"), 1)
        keyed = now.withColumn("key", key).withColumn("bucket", F.expr(f"shiftrightunsigned(key, {63 - BUCKETS.bit_length() + 1})"))
        counts = keyed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        node = Window.partitionBy("shard")
        upto = node.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        coin = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "shard"), F.lit(2))
        counts = counts.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("half", F.floor((F.sum("n").over(node) + coin) / 2))
        # At most MOST_SHARDS * BUCKETS rows, whatever the corpus.
        dealt = keyed.join(F.broadcast(counts), ["shard", "bucket"])
        edge = (F.col("before") < F.col("half")) & (F.col("before") + F.col("n") > F.col("half"))
        rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "source", "epoch", "block"))
        sure = dealt.where(~edge).withColumn("left", F.col("before") < F.col("half"))
        ranked = dealt.where(edge).withColumn("left", F.col("before") + rank <= F.col("half"))
        now = stage(
            sure.unionByName(ranked).select("source", "epoch", "block", (2 * F.col("shard") + F.when(F.col("left"), 0).otherwise(1)).alias("shard")), f"split{level}"
        )
    return now


def plan_mix(sizes: DataFrame, shards: int = SHARDS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """What to take of ``sizes`` (doc_id, source, size).

    First table: source, words, target, bits, epochs (whole passes), cut (the
    last order key of the partial pass, -1 for none).  Second: source, block and
    its placements, an array of (epoch, shard).
    """
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BLOCK)).cast("int"))
    passes = F.when(F.col("words") > 0, F.least(F.floor(F.col("target") / F.col("words")), F.lit(2))).otherwise(F.lit(0))
    goals = source_targets(sizes).withColumn("bits", bits).withColumn("epochs", passes.cast("int"))
    goals = stage(goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("words")), "goals")
    goals_, _ = small(goals)
    keyed = _null_safe(sizes.select("source", "size", _order_key(seed).alias("u")), goals_.select("source", "bits"), ["source"]).withColumn("block", _block())
    blocks = stage(keyed.groupBy("source", "block").agg(F.sum("size").alias("sum")).withColumn("coarse", F.floor(F.col("block") / COARSE)), "blocks")
    coarse = blocks.groupBy("source", "coarse").agg(F.sum("sum").alias("coarse_sum"))
    ahead = Window.partitionBy("source").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("coarse_before", F.coalesce(F.sum("coarse_sum").over(ahead), F.lit(0))).drop("coarse_sum")
    inner = Window.partitionBy("source", "coarse").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = _null_safe(blocks, coarse, ["source", "coarse"]).withColumn("before", F.col("coarse_before") + F.coalesce(F.sum("sum").over(inner), F.lit(0)))
    placed = stage(_null_safe(summed, goals_.select("source", "bits", "epochs", "rest"), ["source"]), "summed")

    edge = placed.where("before < rest and before + sum > rest").select("source", "block", "before", "rest", "bits")
    edge_, _ = small(edge)
    members = _null_safe(keyed.select("source", "block", "u", "size"), edge_, ["source", "block"])
    run = Window.partitionBy("source", "block").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    inside = members.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)) + F.col("size") / 2)
    first = F.expr("CASE WHEN bits = 0 THEN 0L ELSE shiftleft(block, 63 - bits) END")
    cuts = inside.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("at") <= F.col("rest"), F.col("u"))), F.min(first) - 1).alias("cut"))
    whole = placed.where("before + sum <= rest and rest > 0").groupBy("source").agg(F.max(F.expr("CASE WHEN bits = 0 THEN 9223372036854775807L ELSE shiftleft(block + 1, 63 - bits) - 1 END")).alias("cut"))
    cuts = cuts.unionByName(whole).groupBy("source").agg(F.max("cut").alias("cut"))
    cuts = cuts.select(F.col("source").alias("_source"), "cut")
    goals = goals.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("cut", F.coalesce("cut", F.lit(-1).cast("long")))
    goals = stage(goals, "cuts")

    epochs = F.filter(F.sequence(F.lit(0), F.col("epochs")), lambda e: (e < F.col("epochs")) | (F.col("before") < F.col("rest")))
    slots = stage(placed.select("source", "block", F.explode(epochs).alias("epoch")), "slots")
    tree = split_blocks(slots, shards, seed)
    return goals, stage(tree.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("placements")), "placements")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 0, keep: bool = False) -> DataFrame:
    """Each row's doc_id, source, size, source_size, target and copies.

    copies is an array of (epoch, shard): one entry for each time the mix takes
    the row.  With ``keep``, a struct column row holds the row itself.
    """
    columns = [quoted(id_col).alias("doc_id"), quoted(source_col).alias("source")]
    sizes = stage(docs.select(*columns, word_count(quoted(text_col)).alias("size")), "sizes")
    goals, placements = plan_mix(sizes, shards, seed)
    rows = docs.select(*columns, word_count(quoted(text_col)).alias("size"), F.struct(*map(quoted, docs.columns)).alias("row")) if keep else sizes
    goals_, _ = small(goals)
    placements_, _ = small(placements)
    rows = _null_safe(rows.withColumn("u", _order_key(seed)), goals_.select("source", F.col("words").alias("source_size"), "target", "bits", "epochs", "cut"), ["source"])
    rows = rows.withColumn("block", _block())
    dealt = placements_.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "placements")
    rows = rows.join(dealt, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    taken = F.filter("placements", lambda p: (p["epoch"] < F.col("epochs")) | (F.col("u") <= F.col("cut")))
    copies = F.coalesce(taken, F.expr("cast(array() as array<struct<epoch: int, shard: bigint>>)"))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *(["row"] if keep else []))


def mixed_rows(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs as the mix takes them, repeats included, shard by shard and shuffled inside each."""
    seed = int(options.get("seed", 0))
    taken = mix(docs, keep=True, **options).select("row", "doc_id", F.explode("copies").alias("copy"))
    shuffled = taken.withColumn("at", F.xxhash64(F.lit(seed), F.lit("order"), "copy.epoch", "doc_id"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shuffled.repartitionByRange(tasks, "copy.shard", "at").sortWithinPartitions("copy.shard", "at")
    return dealt.select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken"))
