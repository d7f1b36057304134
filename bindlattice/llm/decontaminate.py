"""Benchmark items inside documents: size-partitioned MinHash containment search.

All of it is DataFrame work.  An item has the distinct shingles of SHINGLE words
(all its words, if fewer).  Items are partitioned by the size of their sets in
powers of two; with at most u shingles in a partition, an item that is contained
to ``percent`` misses at most u - ceil(percent * u / 100) of its shingles in the
document, so one of any k = that + 1 of them must be there.  The sketch of an item
is its k smallest shingle hashes (bottom-k MinHash), those of shingles that many
items hold only after all others: a document that holds none of them cannot contain
the item, and every other document is a candidate.  No text similar enough is lost,
however long the document.  Candidates are verified by exact containment of the
shingles as text.

A first pass over the texts finds the ids of candidates; only their rows are read
again, and each gets a key of its own.  Hashes are broadcast only after they were
counted; beyond the bound the join is a shuffled one.  Groups of documents never
meet each other.

Defined results: one row for each document row and item row with a containment of
percent / 100 or more, under their ids; rows that share an id, or have none, count
each for itself, and so do items; null or wordless documents and items match
nothing; words are runs of other than ASCII white space, A-Z lower-cased; other
columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindlattice.llm.common import quoted, read, small, stage

SHINGLE, PERCENT = 5, 80
#: Items that may hold a shingle before sketches take others first; this order has no effect on results.
COMMON = 8
#: Distinct sketch hashes up to which they are broadcast.
SKETCH_ROWS = 4_000_000

_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r"
_TO = "abcdefghijklmnopqrstuvwxyz     "


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _FROM, _TO), " ", -1), "")


def _windows(words: str, width: int) -> Column:
    """Positions of the first words of all shingles of ``width`` words; none for shorter texts."""
    last = F.size(words) - (width - 1)
    return F.when(last >= 1, F.sequence(F.lit(0), last - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _hashes(hashed: str, width: int) -> Column:
    return F.transform(_windows(hashed, width), lambda i: F.xxhash64(*(F.get(F.col(hashed), i + j) for j in range(width))))


def _texts(words: str, width: int) -> Column:
    return F.transform(_windows(words, width), lambda i: F.array_join(F.slice(F.col(words), i + 1, width), " "))


def _each_width(words: str, widths: list[int], of: object) -> Column:
    return F.concat(*(of(words, w) for w in widths))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles, shared and containment of each match of a document row and an item row."""
    rows = docs.select(quoted(id_col).alias("doc_id"), word_array(quoted(text_col)).alias("words"))
    known = items.select(quoted(item_col).alias("item_id"), word_array(quoted(item_text_col)).alias("words")).where(F.size("words") > 0)
    known = stage(known.withColumn("width", F.least(F.lit(SHINGLE), F.size("words"))).withColumn("item", F.monotonically_increasing_id()), "benchmark")
    widths = sorted(r["width"] for r in known.select("width").distinct().collect()) or [SHINGLE]
    by_width = F.coalesce(*(F.when(F.col("width") == w, _texts("words", w)) for w in widths))
    shingled = known.select("item", F.explode(F.array_distinct(by_width)).alias("shingle"))
    size = F.count("*").over(Window.partitionBy("item"))
    shingled = stage(shingled.withColumn("n", size), "items")

    # The hash of a shingle's text word by word, as documents get it.
    hashed = shingled.withColumn("parts", F.transform(F.split("shingle", " "), lambda w: F.xxhash64(w)))
    hashed = hashed.withColumn("hash", F.coalesce(*(F.when(F.size("parts") == w, F.xxhash64(*(F.get("parts", F.lit(j)) for j in range(w)))) for w in widths)))
    common = hashed.groupBy("hash").agg(F.count("*").alias("items")).where(F.col("items") > COMMON).select("hash", F.lit(True).alias("common"))
    top = F.expr("cast(power(2, length(bin(n))) as bigint) - 1")
    sketch_size = top - F.floor((percent * top + 99) / 100) + 1
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("common", F.lit(False)), F.xxhash64("hash"), "shingle"))
    sketches = stage(hashed.join(common, "hash", "left").withColumn("rank", rank).where(F.col("rank") <= sketch_size).select("item", "hash").distinct(), "sketches")

    # Ids of documents with any candidate; then their rows, each under a key of its own.
    hashes, _ = small(stage(sketches.select("hash").distinct(), "hashes"), SKETCH_ROWS)
    numbers = rows.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    ids = numbers.select("doc_id", F.explode(_each_width("hashed", widths, _hashes)).alias("hash")).join(hashes, "hash", "left_semi")
    wanted, _ = small(stage(ids.select(F.col("doc_id").alias("_id")).distinct(), "candidate-ids"))
    met = stage(rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").withColumn("row", F.monotonically_increasing_id()), "candidates")

    sketches_, _ = small(sketches)
    numbers = met.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    pairs = numbers.select("row", F.explode(_each_width("hashed", widths, _hashes)).alias("hash")).join(sketches_, "hash").select("row", "item").distinct()
    asked = stage(pairs, "pairs").join(shingled, "item")
    kept, _ = small(shingled.select("shingle").distinct())
    held = met.select("row", F.explode(F.array_distinct(_each_width("words", widths, _texts))).alias("shingle")).join(kept, "shingle", "left_semi")
    shared = asked.join(held, ["row", "shingle"]).groupBy("row", "item").agg(F.max("n").alias("n_shingles"), F.count("*").alias("shared"))
    shared = shared.where(100 * F.col("shared") >= percent * F.col("n_shingles"))
    named = shared.join(met.select("row", "doc_id"), "row").join(known.select("item", "item_id"), "item")
    return named.select("doc_id", "item_id", "n_shingles", "shared", (F.col("shared") / F.col("n_shingles")).alias("containment"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT item_id, list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS w
  FROM benchmark
), s AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda p: array_to_string(w[p:p + least(5, len(w)) - 1], ' '))) AS shingle
  FROM i WHERE len(w) > 0
), n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS shingle
  FROM d, (SELECT DISTINCT k FROM s) WHERE len(w) >= k
), m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN s USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, shared, CAST(shared AS DOUBLE) / n_shingles AS containment
FROM m JOIN n USING (item_id) WHERE 100 * shared >= 80 * n_shingles
"""
