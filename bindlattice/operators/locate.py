"""Where short strings lie in a genome: a word index over chunks, checked letter by letter.

A genome is a table of chunks (chromosome, number, letters), numbered from 0 without gaps
in each chromosome; chunks may differ in length.  A string is looked up by its first WORD
letters (all of them, if it has fewer): every place of the genome whose word is one that
is looked for is kept, with the letters behind it, and strings are compared there.  Only
the end of a chunk's successor is joined to it, so a chromosome of any length is spread
over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindlattice.operators.joins import small

#: Letters of the word that a string is looked up by.
WORD = 12


def _words(pieces: DataFrame) -> DataFrame:
    return pieces.where(F.length("letters") > 0).select("piece", "letters", F.substring("letters", 1, WORD).alias("word"))


def starts(chunks: DataFrame) -> DataFrame:
    """(chromosome, number, start, place): where each chunk that holds letters starts, and its number among these; windows over one narrow row a chunk."""
    sizes = chunks.select("chromosome", "number", F.length("letters").cast("long").alias("size")).where("size > 0")
    order = Window.partitionBy("chromosome").orderBy("number")
    start = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return sizes.select("chromosome", "number", start.alias("start"), F.row_number().over(order).alias("place"))


def places(pieces: DataFrame, chunks: DataFrame) -> DataFrame:
    """(piece, chromosome, pos) of every place of (piece, letters) in the chunks, overlapping ones, too; a piece may reach over several chunks.

    pos counts from 0 in the chromosome.  Empty pieces and null letters have no place.
    """
    words = _words(pieces)
    sizes = words.agg(F.max(F.length("letters"))).first()[0]
    if sizes is None:
        return pieces.select("piece").join(chunks.select("chromosome"), F.lit(False)).withColumn("pos", F.lit(0).cast("long"))
    reach = sizes - 1
    chunks = chunks.select("chromosome", "number", "letters")
    placed = chunks.join(starts(chunks), ["chromosome", "number"]).withColumn("end", F.col("start") + F.length("letters"))
    # What a place near a chunk's end must see of the chunks after it: each chunk sends its head to those before it.
    ahead = 1 if chunks.where(F.length("letters") < reach).isEmpty() else reach
    held = placed.select("chromosome", "place", "start", "end", "letters")
    heads = placed.select("chromosome", "place", F.col("start").alias("_start"), F.substring("letters", 1, max(reach, 1)).alias("_head"), F.explode(F.sequence(F.lit(1), F.lit(max(ahead, 1)))).alias("_back"))
    heads = heads.withColumn("place", F.col("place") - F.col("_back")).drop("_back")
    near = held.select("chromosome", "place", "end").join(heads, ["chromosome", "place"]).where(F.col("_start") - F.col("end") < reach)
    tails = near.groupBy("chromosome", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", "_head"))), lambda h: h["_head"]), "").alias("tail"))
    whole = held.join(tails, ["chromosome", "place"], "left")
    text = F.concat("letters", F.substring(F.coalesce("tail", F.lit("")), 1, max(reach, 1)))
    # Places are listed a chunk at a time; only those with a word that is looked for go on.
    lengths = [r["n"] for r in words.select(F.length("word").alias("n")).distinct().collect()]  # at most WORD numbers
    cut = whole.select("chromosome", "start", F.length("letters").alias("own"), text.alias("text"))
    each = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda i: F.struct(i.alias("i"), F.substring(F.col("text"), i + 1, F.lit(sizes)).alias("seen")))
    seen = cut.select("chromosome", "start", F.explode(each).alias("p")).select("chromosome", (F.col("start") + F.col("p.i")).alias("pos"), "p.seen")
    keys = F.array_compact(F.array(*(F.when(F.length("seen") >= n, F.substring("seen", 1, n)) for n in lengths)))
    met = seen.withColumn("word", F.explode(keys)).join(small(words), "word")
    return met.where(F.col("seen").startswith(F.col("letters"))).select("piece", "chromosome", "pos")


def first_places(pieces: DataFrame, chunks: DataFrame) -> DataFrame:
    """(piece, chromosome, pos): the first place of each piece in each chromosome that holds it."""
    # Equal pieces are looked up once.
    each = pieces.select(F.col("letters").alias("piece"), "letters").distinct()
    first = places(each, chunks).groupBy("piece", "chromosome").agg(F.min("pos").alias("pos"))
    met = pieces.join(first.withColumnRenamed("piece", "letters"), "letters").select("piece", "chromosome", "pos")
    return met.groupBy("piece", "chromosome").agg(F.min("pos").alias("pos"))


def shifted(found: DataFrame, genes: DataFrame) -> DataFrame:
    """found with gene_start: how far places in a chromosome's coordinates (chromosome, offset) lie from its own first letter."""
    return found.join(small(genes.select("chromosome", "offset")), "chromosome").withColumn("genome_pos", F.col("pos") + F.col("offset"))
