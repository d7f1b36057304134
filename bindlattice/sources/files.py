"""Readers and writers of sequence, interval, annotation and site files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindlattice.functions import sequence as seq
from bindlattice.operators import ranking

# Interaction records have short keys as stored; unknown keys are ignored.
INTERACTION = T.StructType(
    [T.StructField(k, T.StringType()) for k in "gna gseq alt alp alg rgn ity sty sut tid gid trn tseq".split()]
    + [T.StructField(k, T.IntegerType()) for k in "brl pst pen isc".split()]
    + [T.StructField(k, T.DoubleType()) for k in "pcs sac suc sen sue kdv den".split()]
    + [T.StructField("itb", T.BooleanType())]
)
# Columns of the stored results.
RESULTS = T.StructType(
    [T.StructField("transcript_id", T.StringType(), False), T.StructField("mirna_id", T.StringType(), False)]
    + [T.StructField(c, T.FloatType()) for c in ("binding_dG", "Kd")]
    + [T.StructField("position_start", T.LongType(), False), T.StructField("position_end", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("region", "seed_type")]
    + [T.StructField("phastcons", T.FloatType()), T.StructField("bridge", T.IntegerType()), T.StructField("validated", T.BooleanType()), T.StructField("interaction_string", T.StringType())]
)
RESULTS_KEY = ["transcript_id", "mirna_id", "position_start"]


def fasta(spark: SparkSession, path: str, first_line_only: bool = False) -> DataFrame:
    """header and sequence of each record; gzip files are read, too. Lines are joined unless only the first counts."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.transform(F.split("value", "\n"), lambda x: F.trim(F.replace(x, F.lit("\r"))))
    body = F.get("lines", F.lit(1)) if first_line_only else F.array_join(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), "")
    return records.select(lines.alias("lines")).select(F.get("lines", F.lit(0)).alias("header"), F.coalesce(body, F.lit("")).alias("sequence"))


def guides(spark: SparkSession, path: str, least: int = 18, most: int = 26) -> DataFrame:
    """mirna_id, name and sequence (U for T) of guides of allowed length; of an id given twice the greatest name counts."""
    pattern = r"^(\S+)\s+miRNA\s+\(([^)]+)\)"
    rows = fasta(spark, path, first_line_only=True).select(F.regexp_extract("header", pattern, 1).alias("mirna_id"), F.regexp_extract("header", pattern, 2).alias("name"), seq.rna("sequence").alias("sequence"))
    rows = rows.where((F.col("mirna_id") != "") & F.length("sequence").between(least, most))
    return ranking.first_writer(rows, ["mirna_id"], [F.col("name").desc(), "sequence"])


def transcripts(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """transcript_id (without version), gene, region bounds (0-based, null where absent) and sequence.

    ``wanted`` has transcript_id; the file is read once for all of them.
    """
    bound = lambda name, i: F.regexp_extract("header", rf"{name}:(\d+)-(\d+)", i).try_cast("int") - 1
    field = lambda i: F.get(F.split("header", r"\|"), F.lit(i))
    rows = fasta(spark, path).select(
        seq.without_version(field(0)).alias("transcript_id"), field(5).alias("gene"), seq.rna("sequence").alias("sequence"),
        *(bound(n, i).alias(f"{n.lower()}_{e}") for n in ("UTR5", "CDS", "UTR3") for i, e in ((1, "start"), (2, "end"))),
    )
    return rows if wanted is None else rows.join(wanted.select("transcript_id").distinct(), "transcript_id", "left_semi")


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end (half-open, 0-based) and value; malformed lines go."""
    schema = "chrom string, start int, end int, value float"
    return spark.read.schema(schema).option("sep", "\t").option("mode", "DROPMALFORMED").option("comment", "#").csv(path).where("start is not null and end is not null and value is not null")


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns, with transcript_id and gene_name taken from the attributes."""
    schema = "seqname string, source string, feature string, start int, end int, score string, strand string, frame string, attribute string"
    rows = spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    attribute = lambda k: F.nullif(F.regexp_extract("attribute", rf'{k} "([^"]*)"', 1), F.lit(""))
    return rows.withColumns({"transcript_id": seq.without_version(attribute("transcript_id")), "gene_name": attribute("gene_name")})


def interactions(spark: SparkSession, path: str, max_kd: float | None = None) -> DataFrame:
    rows = spark.read.schema(INTERACTION).json(path)
    return rows if max_kd is None else rows.where(F.col("kdv") <= max_kd)


def validated_positions(spark: SparkSession, path: str) -> DataFrame:
    """transcript, guide sequence and position of a nested JSON object of validated sites."""
    whole = spark.read.option("wholetext", True).text(path)
    parsed = whole.select(F.explode(F.from_json("value", "map<string, map<string, array<int>>>")).alias("transcript", "guides"))
    return parsed.select("transcript", F.explode("guides").alias("guide", "positions")).select("transcript", "guide", F.explode("positions").alias("position"))


def mark_validated(sites: DataFrame, known: DataFrame) -> DataFrame:
    """sites (trn, gseq, pst, itb) with itb set where a validated position says so."""
    marks = known.select(F.col("transcript").alias("trn"), F.col("guide").alias("gseq"), F.col("position").alias("pst"), F.lit(True).alias("_known")).distinct()
    joined = sites.join(marks, ["trn", "gseq", "pst"], "left")
    return joined.withColumn("itb", F.coalesce("itb", F.lit(False)) | F.coalesce("_known", F.lit(False))).drop("_known")


def accessibility(spark: SparkSession, path: str) -> DataFrame:
    """One array of doubles a line."""
    return spark.read.text(path).select(F.transform(F.split("value", "\t"), lambda x: x.try_cast("double")).alias("p"))


def reads(spark: SparkSession, path: str) -> DataFrame:
    """Of each FASTQ record the longest run without N, the first on ties; records split at '\\n@'."""
    records = spark.read.option("lineSep", "\n@").text(path).where(F.trim("value") != "")
    parts = F.split(F.get(F.split("value", "\n"), F.lit(1)), "N")
    longest = F.aggregate(parts, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return records.select(F.regexp_replace(F.get(F.split("value", "\n"), F.lit(0)), "^@", "").alias("name"), longest.alias("sequence"))


def write_results(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Sites as Parquet by transcript; of rows with one key the first writer (least Kd) stays, and rows already stored win."""
    spark = rows.sparkSession
    new = ranking.first_writer(rows, RESULTS_KEY, order or ["Kd", "binding_dG"])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        new = new.join(spark.read.parquet(path).select(*RESULTS_KEY), RESULTS_KEY, "left_anti")
    new.write.mode("append").partitionBy("transcript_id").parquet(path)


def write_interactions(rows: DataFrame, path: str) -> None:
    """JSON lines with doubles rounded to two places, accessibilities (sac, suc) to four, one folder a transcript and seed."""
    digits = {"sac": 4, "suc": 4}
    rounded = rows.select(*(F.round(c, digits.get(c, 2)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))
    rounded.withColumn("seed", F.substring("gseq", 2, 7)).write.mode("overwrite").partitionBy("trn", "seed").json(path)


def missing_outputs(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items without a result: what a resumed run has left to do."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table, in one plan."""
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()))


# The stored relations besides results.
TRANSCRIPTS = T.StructType([T.StructField("transcript_id", T.StringType(), False)] + [T.StructField(c, T.StringType()) for c in ("gene_name", "category", "enst_id")])
MIRNAS = T.StructType([T.StructField("mirna_id", T.StringType(), False), T.StructField("name", T.StringType())])


def conformed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows with the schema's columns and types, in its order; a row without a required value is an error, other columns go."""
    checked = []
    for f in schema.fields:
        value = F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        if not f.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"{f.name} is required")).cast(f.dataType))
        checked.append(value.alias(f.name))
    return rows.select(*checked)


def clean_start(rows: DataFrame, path: str) -> None:
    """Write rows as the only content of a path."""
    rows.write.mode("overwrite").parquet(path)


def write_by_category(rows: DataFrame, path: str, category: str) -> None:
    """Sequences of a panel as Parquet, one folder a category."""
    rows.repartition(category).write.mode("overwrite").partitionBy(category).parquet(path)


def write_by_prefix(rows: DataFrame, path: str, name: str = "name", letters: int = 2) -> None:
    """FASTA records as text lines, one folder for each first ``letters`` letters of their name."""
    record = F.concat(F.lit(">"), F.col(name), F.lit("\n"), seq.fasta_wrapped("sequence"))
    rows.select(record.alias("value"), F.upper(F.substring(name, 1, letters)).alias("prefix")).write.mode("overwrite").partitionBy("prefix").text(path)


def write_guides(rows: DataFrame, path: str) -> None:
    """Guides (guide_id, sequence) as JSON lines by first letter and seed."""
    rows.withColumns({"g1": F.substring("sequence", 1, 1), "seed": seq.region("sequence", 2, 8)}).write.mode("overwrite").partitionBy("g1", "seed").json(path)


def guides_with_seed(spark: SparkSession, path: str, seed: str) -> DataFrame:
    """The stored guides of one seed: partition pruning reads their folders alone."""
    return spark.read.json(path).where(F.col("seed") == seed)


def stored_interactions(spark: SparkSession, path: str, transcript: str, seed: str, max_kd: float | None = None, region_mask: int | None = None) -> DataFrame:
    """The interactions of one transcript and seed, read from their folder alone, filtered by affinity and region."""
    rows = spark.read.schema(T.StructType([*INTERACTION.fields, T.StructField("seed", T.StringType())])).json(path)
    rows = rows.where((F.col("trn") == transcript) & (F.col("seed") == seed))
    rows = rows if max_kd is None else rows.where(F.col("kdv") <= max_kd)
    return rows if region_mask is None else rows.where(seq.in_region("rgn", F.lit(region_mask)))


def stale(spark: SparkSession, path: str, before: str) -> DataFrame:
    """Files of a path last written before a time: what an update would delete."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("written"), "length")
    return files.where(F.col("written") < F.lit(before).cast("timestamp"))


def reporters(spark: SparkSession, path: str) -> DataFrame:
    """Reporter records: the five fields of their header, and the sequence."""
    rows = fasta(spark, path)
    field = lambda i: F.get(F.split("header", r"\|"), F.lit(i))
    return rows.select(field(0).alias("name"), field(1).alias("gene"), field(2).alias("guide"), field(3).alias("site"), field(4).alias("value"), seq.rna("sequence").alias("sequence"))


def kmer_counts(spark: SparkSession, path: str) -> DataFrame:
    """k-mers with the count in their header; records without a number go."""
    rows = fasta(spark, path, first_line_only=True).select(seq.rna("sequence").alias("kmer"), F.trim("header").try_cast("long").alias("n"))
    return rows.where(F.col("n").isNotNull() & (F.col("kmer") != ""))


def primary_transcripts(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """Records whose header fields are split at a given pattern: id, name, and the remaining fields."""
    parts = F.split("header", separator)
    return fasta(spark, path).select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("name"), F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))).alias("fields"), seq.rna("sequence").alias("sequence"))


def mean_length(reads_: DataFrame) -> DataFrame:
    return reads_.agg(F.count("*").alias("n"), F.avg(F.length("sequence")).alias("mean_length"))


def genomic_slice(chromosomes: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (id, chrom, start, end; 1-based, both counted) with their letters from chromosomes (chrom, sequence)."""
    return ranges.join(chromosomes, "chrom").select("id", "chrom", "start", "end", F.substring(F.col("sequence"), F.col("start"), F.col("end") - F.col("start") + 1).alias("letters"))


def design_file(spark: SparkSession, path: str) -> DataFrame:
    """(key, values) of lines such as ``key: a, b``; blank lines and comments go, a key given twice keeps its last line."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.trim("value").rlike(r"^[^#\s][^:=]*[:=]"))
    parts = lines.select("line", F.trim(F.regexp_extract("value", r"^([^:=]+)[:=]", 1)).alias("key"), F.regexp_extract("value", r"^[^:=]+[:=](.*)$", 1).alias("rest"))
    values = F.filter(F.transform(F.split("rest", "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return parts.groupBy("key").agg(F.max_by(values, "line").alias("values"))


def sequence_index(guides_: DataFrame) -> DataFrame:
    """(sequence, names): every name of each sequence, as several guides may share one."""
    return guides_.groupBy("sequence").agg(F.sort_array(F.collect_set("name")).alias("names"))


def factor_table(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A stored factor; with ``rows``, an error where it has another number of rows."""
    found = spark.read.parquet(path)
    if rows is not None and found.count() != rows:
        raise ValueError(f"{path} should have {rows} rows")
    return found


def fetched(requests: DataFrame, fetch: Callable[[dict], dict | None]) -> DataFrame:
    """Answers of a remote service as (request, answer, error) JSON rows, one session a partition.

    ``fetch`` makes one request; what it raises becomes the row's error, so one failed
    request loses nothing else.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for request in frame["request"]:
                try:
                    answer = fetch(json.loads(request))
                    out.append((request, None if answer is None else json.dumps(answer), None))
                except Exception as error:
                    out.append((request, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["request", "answer", "error"])

    return requests.select(F.to_json(F.struct(*requests.columns)).alias("request")).mapInPandas(each, "request string, answer string, error string")
