"""Queries over sequences, sites, joins, signals and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindlattice.functions import sequence as seq
from bindlattice.operators import graph, joins, signal
from bindlattice.operators import sites as site
from bindlattice.plans.surrogate import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# Part names as pseudo-RNA: letters and digits become bases.
_FROM, _TO = "abcdefghijklmnopqrstuvwxyz0123456789 #_-", "ACGUACGUACGUACGUACGUACGUACACGUACGUACGUAC"


def _strands(spark, d) -> DataFrame:
    """key, s: an RNA string of each part."""
    text = F.lower(F.concat("p_name", F.lit("xyz"), "p_type", "p_brand"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.translate(text, _FROM, _TO).alias("s"))


STRANDS = f"strands AS (SELECT p_partkey AS key, translate(lower(p_name || 'xyz' || p_type || p_brand), '{_FROM}', '{_TO}') AS s FROM part)"
SIGNAL = "signal AS (SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, value / 0.997 AS value FROM events)"


def _signal(spark, d) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").select(F.col("user_id").alias("key"), pos.cast("long").alias("pos"), (F.col("value") / 0.997).alias("value"))


@query(f"WITH {STRANDS} SELECT key, reverse(translate(s, 'ACGU', 'UGCA')) AS rc, CAST(length(regexp_replace(s, '[^GC]', '', 'g')) AS DOUBLE) / length(s) AS gc, s[2:8] AS seed, regexp_full_match(s, '[ACGU]*') AS sound FROM strands")
def revcomp_gc(spark, d):
    return _strands(spark, d).select("key", seq.reverse_complement("s").alias("rc"), seq.gc_fraction("s").alias("gc"), seq.region("s", 2, 8).alias("seed"), seq.is_rna("s").alias("sound"))


@query(f"WITH {STRANDS}, p AS (SELECT key, s, unnest(range(0, length(s) - 1)) AS pos FROM strands) SELECT key, pos FROM p WHERE s[pos + 1:pos + 2] = 'UA'")
def overlapping_sites(spark, d):
    return _strands(spark, d).select("key", F.explode(seq.occurrences("s", "UA")).alias("pos")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {STRANDS}, d AS (SELECT key, unnest(range(1, 9)) AS i, translate(s[1:8], 'ACGU', '0123') AS t FROM strands) SELECT key, CAST(sum(CAST(t[i] AS BIGINT) * CAST(pow(4, 8 - i) AS BIGINT)) AS BIGINT) AS code FROM d GROUP BY key")
def base4_encode(spark, d):
    return _strands(spark, d).select("key", seq.base4(F.substring("s", 1, 8)).alias("code"))


@query(f"WITH {STRANDS} SELECT key FROM strands WHERE s NOT LIKE '%AAAA%' AND s NOT LIKE '%GUGU%' AND length(regexp_replace(s, '[^GC]', '', 'g')) / length(s) BETWEEN 0.3 AND 0.6 AND right(s, 1) <> 'U'")
def design_filter(spark, d):
    return _strands(spark, d).where(seq.passes_design("s", ["AAAA", "GUGU"], 0.3, 0.6)).select("key")


@query(f"WITH {STRANDS}, p AS (SELECT key, s, unnest(range(0, length(s) - 5)) AS pos FROM strands) SELECT s[pos + 1:pos + 6] AS kmer, count(*) AS n, count(DISTINCT key) AS strands FROM p GROUP BY 1 HAVING count(DISTINCT key) >= 2")
def kmer_index(spark, d):
    words = _strands(spark, d).select("key", F.explode(seq.kmers("s", 6)).alias("kmer"))
    return words.groupBy("kmer").agg(F.count("*").alias("n"), F.countDistinct("key").alias("strands")).where("strands >= 2")


def _kmers_by_size(spark, d) -> DataFrame:
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("grp"))
    return _strands(spark, d).join(sizes, "key").select("grp", F.explode(seq.kmers("s", 4)).alias("kmer")).distinct()


BY_SIZE = STRANDS + ", p AS (SELECT p_size AS grp, s, unnest(range(0, length(s) - 3)) AS pos FROM strands JOIN part ON key = p_partkey), m AS (SELECT DISTINCT grp, s[pos + 1:pos + 4] AS kmer FROM p)"


@query(f"WITH {BY_SIZE} SELECT kmer FROM m WHERE grp <= 10 GROUP BY kmer HAVING count(DISTINCT grp) = (SELECT count(DISTINCT grp) FROM m WHERE grp <= 10)")
def kmer_division(spark, d):
    words = _kmers_by_size(spark, d)
    return joins.in_all(words, "kmer", "grp", words.where("grp <= 10"))


@query(f"WITH {BY_SIZE} SELECT DISTINCT kmer FROM m WHERE grp <= 20 AND kmer NOT IN (SELECT kmer FROM m WHERE grp > 45)")
def kmer_exclusive(spark, d):
    words = _kmers_by_size(spark, d)
    return joins.in_none(words.where("grp <= 20").select("kmer").distinct(), words, "kmer", "grp", words.where("grp > 45"))


GRIP = STRANDS + ", k AS (SELECT key, pos, s[pos + 1:pos + 4] AS w FROM (SELECT key, s, unnest(range(0, length(s) - 3)) AS pos FROM strands))"


@query(f"WITH {GRIP} SELECT a.w || '/' || b.w AS grip, count(*) AS n, count(DISTINCT a.key) AS strands FROM k a JOIN k b ON a.key = b.key AND a.pos - b.pos BETWEEN 7 AND 12 GROUP BY 1 HAVING count(DISTINCT a.key) >= 3")
def grip_map(spark, d):
    # Equal strings are cut once and count for all their keys.
    texts = joins.alike(_strands(spark, d), "key", "s")[1]
    pairs = joins.word_pairs(texts.select(F.struct("text", "n").alias("t"), "s"), "t", "s", 4, 4, 7, 12)
    held = pairs.groupBy("t", F.concat("w3", F.lit("/"), "w5").alias("grip")).agg(F.count("*").alias("times"))
    return held.groupBy("grip").agg(F.sum(F.col("times") * F.col("t.n")).alias("n"), F.sum("t.n").alias("strands")).where("strands >= 3")


@query(f"WITH {SIGNAL} SELECT a.key, a.pos AS p, b.pos AS q FROM signal a JOIN signal b ON a.key = b.key AND a.pos - b.pos BETWEEN 1 AND 15 WHERE a.value > 50 AND b.value < 20")
def band_join_bridge(spark, d):
    rows = _signal(spark, d)
    high, low = rows.where("value > 50").select("key", F.col("pos").alias("p")), rows.where("value < 20").select("key", F.col("pos").alias("q"))
    return joins.band_join(high, low, ["key"], "p", "q", 1, 15).select("key", "p", "q")


@query("""WITH i AS (SELECT user_id % 5 AS chrom, event_id * 3 AS start, event_id * 3 + 2 + event_id % 7 AS "end", value / 0.997 AS value FROM events),
q AS (SELECT o_orderkey AS id, o_orderkey % 5 AS chrom, o_orderkey * 2 AS q_start, o_orderkey * 2 + 31 AS q_end FROM orders),
m AS (SELECT id, sum((least("end", q_end) - greatest(start, q_start)) * value) / sum(least("end", q_end) - greatest(start, q_start)) AS mean FROM i JOIN q ON i.chrom = q.chrom AND start < q_end AND q_start < "end" GROUP BY id)
SELECT q.id, round(coalesce(mean, -1.0), 5) AS mean FROM q LEFT JOIN m ON q.id = m.id""")
def overlap_weighted_mean(spark, d):
    spans = table(spark, d, "events").selectExpr("user_id % 5 AS chrom", "event_id * 3 AS start", "event_id * 3 + 2 + event_id % 7 AS end", "value / double(0.997) AS value")
    queries = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 5 AS chrom", "o_orderkey * 2 AS q_start", "o_orderkey * 2 + 31 AS q_end")
    return joins.overlap_mean(spans, queries, "chrom", "id", "value", 32).select("id", F.round("mean", 5).alias("mean"))


@query("WITH e AS (SELECT user_id % 50 AS k, ts, arg_max(event_id, event_id) AS event_id FROM events GROUP BY ALL), p AS (SELECT o_orderkey AS probe, o_custkey % 50 AS k, o_orderdate AS ts FROM orders) SELECT p.probe, e.event_id FROM p ASOF LEFT JOIN e ON p.k = e.k AND p.ts >= e.ts")
def asof_lookup(spark, d):
    events = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("k"), "ts").agg(F.max("event_id").alias("event_id"))
    probes = table(spark, d, "orders").select(F.col("o_orderkey").alias("probe"), (F.col("o_custkey") % 50).alias("k"), F.col("o_orderdate").alias("ts"))
    return joins.as_of(events, probes, "k", "ts", "event_id", "probe")


@query(f"WITH {SIGNAL} SELECT key, pos, round(avg(value) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) AS smooth FROM signal")
def moving_average(spark, d):
    return signal.moving_average(_signal(spark, d), 2).select("key", "pos", F.round("smooth", 5).alias("smooth"))


@query(f"WITH {SIGNAL} SELECT a.key, a.pos, round(sum(exp(-pow(a.pos - b.pos, 2) / 8.0) * b.value) / sum(exp(-pow(a.pos - b.pos, 2) / 8.0)), 5) AS smooth FROM signal a JOIN signal b ON a.key = b.key AND abs(a.pos - b.pos) <= 6 GROUP BY a.key, a.pos")
def gaussian_smooth(spark, d):
    return signal.gaussian(_signal(spark, d), 2.0).select("key", "pos", F.round("smooth", 5).alias("smooth"))


@query(f"WITH {SIGNAL}, z AS (SELECT key, count(*) // 4 AS size FROM signal GROUP BY key) SELECT key, pos // size AS bin, round(avg(value), 5) AS mean FROM signal JOIN z USING (key) WHERE size > 0 AND pos // size < 4 GROUP BY ALL")
def downsample_bins(spark, d):
    return signal.downsample(_signal(spark, d), 4).select("key", F.col("bin").cast("long").alias("bin"), F.round("mean", 5).alias("mean"))


@query(f"WITH {SIGNAL}, i AS (SELECT key, pos - row_number() OVER (PARTITION BY key ORDER BY pos) AS island FROM signal WHERE value >= 30), r AS (SELECT key, count(*) AS n FROM i GROUP BY key, island), m AS (SELECT key, max(n) AS n FROM r GROUP BY key) SELECT k.key, coalesce(n, 0) AS longest FROM (SELECT DISTINCT key FROM signal) k LEFT JOIN m ON k.key = m.key")
def longest_run(spark, d):
    return signal.longest_run(_signal(spark, d), 30)


_BLOCK = "'5''-AC-3'' P' || p_partkey || ' [' || p_size * 10 || '..' || p_size * 10 + 30 || '] (CDS) target site: ' || p_brand || ' x' || chr(10) || '7mer bridge: ' || p_size % 15 || ' phastcons: -1.00 dG: -' || p_size || '.50 Kd: 1,' || 100 + p_size || chr(10) || '3''-GG-5'' g'"


@query("SELECT p_partkey AS key, CAST(i AS INTEGER) AS block_pos, CAST(p_size * 10 AS BIGINT) AS position_start, CAST(p_size * 10 + 30 AS BIGINT) AS position_end, 'CDS' AS region, regexp_extract('target site: ' || p_brand, 'target site:\\s*(\\S+)', 1) AS seed_type, CAST(p_size % 15 AS INTEGER) AS bridge, -1.0::DOUBLE AS phastcons, -(p_size + 0.5)::DOUBLE AS dg, (1100 + p_size)::DOUBLE AS kd, false AS validated FROM part, range(2) t(i)")
def block_parse(spark, d):
    texts = table(spark, d, "part").selectExpr("p_partkey AS key", f"concat({_BLOCK.replace('||', ',').replace(chr(39) * 2, chr(92) + chr(39))}, chr(10)) AS one").selectExpr("key", "concat(one, one) AS text")
    return site.parse_blocks(texts, "text").drop("text", "interaction_string")


@query("""WITH g AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity * 40 AS kd, CASE WHEN l_returnflag = 'R' THEN 'seedless' WHEN l_returnflag = 'A' THEN 'offset-6mer' ELSE '7mer' END AS seed_class, CASE WHEN l_linestatus = 'O' THEN 'CDS and 3UTR' ELSE '5UTR' END AS region, l_tax * 10 AS seed_acc, l_discount AS supp_acc, CAST(l_linenumber - 2 AS INTEGER) AS conservation FROM lineitem)
SELECT k, i, kd FROM g WHERE kd <= 1500 AND seed_class <> 'seedless' AND regexp_extract(seed_class, '(\\dmer)', 1) >= '6mer' AND region LIKE '%CDS%' AND seed_acc + 0.005 >= 0.15 AND supp_acc + 0.005 >= 0 AND (0 <= conservation OR conservation = -1)""")
def interaction_filter(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS i", "l_quantity * 40 AS kd", "CASE WHEN l_returnflag = 'R' THEN 'seedless' WHEN l_returnflag = 'A' THEN 'offset-6mer' ELSE '7mer' END AS seed_class", "CASE WHEN l_linestatus = 'O' THEN 'CDS and 3UTR' ELSE '5UTR' END AS region", "l_tax * 10 AS seed_acc", "l_discount AS supp_acc", "l_linenumber - 2 AS conservation", "'x' AS supp_type")
    return rows.where(site.keeps_interaction(utr3=False)).select("k", "i", "kd")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY 20 - l_quantity, l_linenumber, l_orderkey) AS k FROM lineitem WHERE 20 - l_quantity < 0) SELECT l_partkey, l_suppkey, 20 - l_quantity AS energy, l_orderkey FROM r WHERE k = 1")
def argmin_site(spark, d):
    from bindlattice.operators import ranking

    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (20 - F.col("l_quantity")).alias("energy"), "l_linenumber", "l_orderkey")
    return ranking.argmin_site(rows, ["l_partkey", "l_suppkey"], "energy", ["l_linenumber", "l_orderkey"]).select("l_partkey", "l_suppkey", "energy", "l_orderkey")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 90 < 20 THEN '5UTR' ELSE '' END || CASE WHEN o_orderkey % 90 < 20 AND o_orderkey % 90 + 30 >= 20 THEN ' and ' ELSE '' END || CASE WHEN o_orderkey % 90 <= 60 AND o_orderkey % 90 + 30 >= 20 THEN 'CDS' ELSE '' END || CASE WHEN o_orderkey % 90 + 30 > 60 AND o_orderkey % 90 <= 60 THEN ' and 3UTR' WHEN o_orderkey % 90 + 30 > 60 THEN '3UTR' ELSE '' END AS region FROM orders")
def region_class(spark, d):
    start = F.col("o_orderkey") % 90
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), seq.region_label(start, start + 30, F.lit(20), F.lit(60)).alias("region"))


@query("WITH s AS (SELECT l_partkey AS key, l_quantity / 7 - 6 AS energy FROM lineitem), z AS (SELECT *, exp(-(energy - min(energy) OVER (PARTITION BY key)) / (310.15 * 0.0019872)) AS b FROM s) SELECT key, round(max(b / t), 6) AS best FROM (SELECT *, sum(b) OVER (PARTITION BY key) AS t FROM z) GROUP BY key")
def boltzmann_weights(spark, d):
    states = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_quantity") / 7 - 6).alias("energy"))
    return site.boltzmann(states).groupBy("key").agg(F.round(F.max("probability"), 6).alias("best"))


@query("WITH n AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS c FROM n a JOIN n b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS rn FROM p) SELECT id, other, round(c, 6) AS cosine, rn FROM r WHERE rn <= 5")
def knn_cosine(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return graph.knn(vectors, 5).select("id", "other", F.round("cosine", 6).alias("cosine"), "rn")


def _whole_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customers, and an edge of every order from its customer to one that its key leads to."""
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    size = nodes.agg(F.min("id").alias("least"), F.count("*").alias("n"))
    edges = table(spark, d, "orders").crossJoin(F.broadcast(size)).select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") * 7 % F.col("n") + F.col("least")).alias("b"), (F.col("o_orderkey") % 9 + 1).cast("double").alias("w"))
    return nodes, graph.undirected(edges, "a", "b", "w")


EDGES = "size AS (SELECT count(*) AS n, min(c_custkey) AS least FROM customer), edges AS (SELECT src, dst, max(w) AS weight FROM (SELECT least(o_custkey, o_orderkey * 7 % n + size.least) AS src, greatest(o_custkey, o_orderkey * 7 % n + size.least) AS dst, CAST(o_orderkey % 9 + 1 AS DOUBLE) AS w FROM orders, size) WHERE src <> dst GROUP BY src, dst)"


@query(f"WITH {EDGES}, n AS (SELECT src AS node, * FROM edges UNION ALL SELECT dst, * FROM edges), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, src, dst) AS rn FROM n) SELECT DISTINCT src, dst, weight FROM r WHERE rn <= 2")
def sparsify_topk(spark, d):
    return graph.sparsified(_whole_graph(spark, d)[1], 2)


@query(f"WITH RECURSIVE {EDGES}, b AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), r(id, c) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.id WHERE r.c < b.dst) SELECT id, min(c) AS component FROM r WHERE id IN (SELECT c_custkey FROM customer) GROUP BY id")
def connected_components(spark, d):
    return graph.connected_components(*_whole_graph(spark, d))


@query(f"WITH {EDGES}, l AS (SELECT c_custkey AS id, c_nationkey AS label FROM customer), e AS (SELECT weight, a.label AS la, b.label AS lb FROM edges JOIN l a ON a.id = src JOIN l b ON b.id = dst), s AS (SELECT la AS label, weight AS deg, CASE WHEN la = lb THEN weight ELSE 0 END AS inn FROM e UNION ALL SELECT lb, weight, 0 FROM e), c AS (SELECT label, sum(deg) AS deg, sum(inn) AS inn FROM s GROUP BY label), m AS (SELECT sum(deg) / 2 AS m FROM c) SELECT round(sum(inn / m - pow(deg / (2 * m), 2)), 6) AS modularity FROM c, m")
def modularity(spark, d):
    labels = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("label"))
    return graph.modularity(_whole_graph(spark, d)[1], labels).select(F.round("modularity", 6).alias("modularity"))


@query("WITH n AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.id, a.label AS own, b.label AS other, avg(list_distance(a.v, b.v)) AS g FROM n a JOIN n b ON a.id <> b.id GROUP BY ALL), s AS (SELECT id, max(CASE WHEN own = other THEN g END) AS a, min(CASE WHEN own <> other THEN g END) AS b FROM p GROUP BY id) SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s")
def silhouette_labels(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return graph.silhouette(points).select(F.round("silhouette", 6).alias("silhouette"))


@query("WITH c AS (SELECT c_nationkey AS a, c_mktsegment AS b, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2) AS bt, sum(n) AS n FROM c), l AS (SELECT sum(n * (n - 1) / 2) AS l FROM (SELECT sum(n) AS n FROM c GROUP BY a)), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((bt - l * r / (n * (n - 1) / 2)) / ((l + r) / 2 - l * r / (n * (n - 1) / 2)), 8) AS ari FROM t, l, r")
def ari_labels(spark, d):
    return graph.adjusted_rand(table(spark, d, "customer"), "c_nationkey", "c_mktsegment").select(F.round("ari", 8).alias("ari"))
