"""Queries over the matrix and its rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindlattice.operators import graph, matrix, ranking
from bindlattice.plans.surrogate import GRID, PAIRS, RESIDUAL, SITES, sites, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NATIONS = 25


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return matrix.pair_mean(sites(spark, d))


def _staged(spark: SparkSession, d: str) -> DataFrame:
    """The pairs, written once for plans that read them more than once."""
    return graph.checkpointed(_pairs(spark, d))


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


@query(f"WITH {RESIDUAL}, rk AS (SELECT *, row_number() OVER (PARTITION BY col_id ORDER BY round(v, 6) DESC, row_id) AS rn FROM residual) SELECT col_id, row_id, round(v, 4) AS v, CAST(rn AS BIGINT) AS rn FROM rk WHERE rn <= 5")
def residual_top5(spark, d):
    return matrix.top_residual(_staged(spark, d), 5).select("col_id", "row_id", _r("v", 4), "rn")


@query(f"WITH {PAIRS} SELECT row_id, col_id, round(w, 6) AS w FROM pairs")
def pair_mean_abs(spark, d):
    return _pairs(spark, d).select("row_id", "col_id", _r("w"))


@query(f"WITH {PAIRS}, p AS (SELECT row_id, n_nationkey, w FROM pairs JOIN nation ON col_id = n_name) SELECT row_id, " + ", ".join(f"round(coalesce(max(CASE WHEN n_nationkey = {i} THEN w END), 0.0), 6) AS c{i}" for i in range(NATIONS)) + " FROM p GROUP BY row_id")
def pair_pivot_25(spark, d):
    keyed = _pairs(spark, d).join(F.broadcast(table(spark, d, "nation")), F.col("col_id") == F.col("n_name")).select("row_id", F.col("n_nationkey").alias("col_id"), "w")
    wide = matrix.pivot(keyed, list(range(NATIONS)))
    return wide.select("row_id", *(F.round(F.col(f"`{i}`"), 6).alias(f"c{i}") for i in range(NATIONS)))


@query(f"WITH {RESIDUAL} SELECT row_id, col_id, round(v, 6) AS v FROM residual")
def residual_grid(spark, d):
    return matrix.residual(_staged(spark, d)).select("row_id", "col_id", _r("v"))


@query(f"WITH {RESIDUAL} SELECT row_id, col_id, round(a, 6) AS v FROM above")
def residual_nofloor(spark, d):
    return matrix.residual(_staged(spark, d), None).select("row_id", "col_id", _r("v"))


@query(f"WITH {GRID} SELECT row_id, col_id, round(CASE WHEN sum(w) OVER (PARTITION BY row_id) = 0 THEN 0 ELSE w / sum(w) OVER (PARTITION BY row_id) END, 6) AS p FROM grid")
def row_l1_normalize(spark, d):
    return matrix.row_normalised(matrix.dense_grid(_staged(spark, d))).select("row_id", "col_id", _r("p"))


@query(f"WITH {GRID} SELECT count(*) AS cells, round(avg(CASE WHEN w > 0 THEN 1.0 ELSE 0.0 END), 6) AS density, round(min(w), 6) AS least, round(max(w), 6) AS most, round(quantile_cont(CASE WHEN w > 0 THEN w END, 0.95), 6) AS p95, round(quantile_cont(CASE WHEN w > 0 THEN w END, 0.97), 6) AS p97 FROM grid")
def matrix_stats(spark, d):
    return matrix.matrix_stats(_staged(spark, d)).select("cells", *map(_r, ("density", "least", "most", "p95", "p97")))


@query(f"WITH {GRID} SELECT row_id, round(var_pop(w), 4) AS variance FROM grid GROUP BY row_id")
def row_variance(spark, d):
    return matrix.stored_variance(_staged(spark, d)).select("row_id", _r("variance", 4))


@query(f"WITH {PAIRS} SELECT row_id, col_id, round(pow(w, 2), 4) AS weight FROM pairs WHERE w >= 30")
def power_weight_edges(spark, d):
    return matrix.edges(_pairs(spark, d), 30, 2.0).select("row_id", "col_id", _r("weight", 4))


def _targets(spark, d):
    nations, regions = table(spark, d, "nation"), table(spark, d, "region")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("col_id"), F.col("r_name").alias("category"))


@query(f"WITH {SITES}, t AS (SELECT n_name AS col_id, r_name AS category FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT category, count(DISTINCT t.col_id) AS targets, count(*) AS sites, round(avg(dg), 6) AS mean_dg, round(min(dg), 6) AS least_dg FROM t LEFT JOIN sites s ON s.col_id = t.col_id GROUP BY category")
def category_summary(spark, d):
    return matrix.category_summary(_targets(spark, d), sites(spark, d)).select("category", "targets", "sites", _r("mean_dg"), _r("least_dg"))


@query(f"WITH {SITES} SELECT row_id, round(coalesce(avg(dg), 0), 5) AS mean_dg, round(coalesce(avg(ln(1 + kd)), 0), 5) AS mean_log_kd, round(coalesce(avg(bridge), 0), 5) AS mean_bridge, round(coalesce(stddev_samp(dg), 0), 5) AS std_dg, round(coalesce(stddev_samp(ln(1 + kd)), 0), 5) AS std_log_kd, round(coalesce(quantile_cont(dg, 0.5), 0), 5) AS median_dg, count(dg) AS n_sites FROM sites GROUP BY row_id")
def entity_features(spark, d):
    names = ("mean_dg", "mean_log_kd", "mean_bridge", "std_dg", "std_log_kd", "median_dg")
    return matrix.row_features(sites(spark, d)).select("row_id", *(_r(c, 5) for c in names), "n_sites")


@query(f"WITH {SITES}, f AS (SELECT seed_type FROM sites WHERE seed_type IS NOT NULL GROUP BY seed_type ORDER BY count(*) DESC, seed_type LIMIT 2), c AS (SELECT row_id, seed_type, count(*) AS n FROM sites WHERE seed_type IN (SELECT seed_type FROM f) GROUP BY ALL) SELECT row_id, seed_type, n, round(n / sum(n) OVER (PARTITION BY row_id), 6) AS share FROM c")
def type_proportions(spark, d):
    return matrix.proportions(sites(spark, d), "seed_type", 2).select("row_id", "seed_type", "n", _r("share"))


@query(f"WITH {SITES}, c AS (SELECT row_id, col_id, count(*) AS n FROM sites GROUP BY ALL) SELECT row_id, col_id, n, round(n / sum(n) OVER (PARTITION BY row_id), 6) AS share FROM c")
def target_proportions(spark, d):
    return matrix.proportions(sites(spark, d), "col_id").select("row_id", "col_id", "n", _r("share"))


@query(f"WITH {SITES} SELECT bridge, count(*) AS n FROM sites GROUP BY bridge ORDER BY n DESC, bridge LIMIT 5")
def top_modes(spark, d):
    return ranking.top(sites(spark, d).groupBy("bridge").agg(F.count("*").alias("n")), "n", ["bridge"], 5)


@query(f"WITH {SITES}, r AS (SELECT *, row_number() OVER (PARTITION BY row_id, col_id, bridge ORDER BY kd, dg, position) AS k FROM sites) SELECT row_id, col_id, bridge, kd, round(dg, 6) AS dg, position FROM r WHERE k = 1")
def pk_first_writer_dedup(spark, d):
    return ranking.first_writer(sites(spark, d), ["row_id", "col_id", "bridge"], ["kd", "dg", "position"]).select("row_id", "col_id", "bridge", "kd", _r("dg"), "position")


@query("SELECT s_suppkey AS guide, n_nationkey AS target, CAST(s_suppkey % 7 + n_nationkey AS BIGINT) AS code FROM nation CROSS JOIN supplier")
def cross_workitems(spark, d):
    guides, targets = table(spark, d, "supplier").select(F.col("s_suppkey").alias("guide")), table(spark, d, "nation").select(F.col("n_nationkey").alias("target"))
    return guides.crossJoin(F.broadcast(targets)).select("guide", "target", (F.col("guide") % 7 + F.col("target")).cast("long").alias("code"))


@query(f"WITH {PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(w, 6) DESC, col_id) AS rn FROM pairs) SELECT row_id, col_id, round(w, 6) AS w, CAST(rn AS BIGINT) AS rn FROM k WHERE rn <= 3 AND w >= 30")
def topk_cols_per_row(spark, d):
    return ranking.top_per(_pairs(spark, d).withColumn("w", F.round("w", 6)), "row_id", "w", "col_id", 3).where("w >= 30")


@query(f"WITH {PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY col_id ORDER BY round(w, 6) DESC, row_id) AS rn FROM pairs) SELECT DISTINCT row_id FROM k WHERE rn <= 5")
def topn_rows_union(spark, d):
    return ranking.top_per(_pairs(spark, d).withColumn("w", F.round("w", 6)), "col_id", "w", "row_id", 5).select("row_id").distinct()


@query(f"WITH {PAIRS}, a AS (SELECT row_id, arg_max(col_id, w) AS sig, sum(w) AS total FROM pairs GROUP BY row_id), k AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY round(total, 6) DESC, row_id) AS rn FROM a) SELECT sig, row_id, round(total, 4) AS total, CAST(rn AS BIGINT) AS rn FROM k WHERE rn <= 4")
def topm_within_signature(spark, d):
    pairs = _pairs(spark, d)
    totals = pairs.groupBy("row_id").agg(F.max_by("col_id", "w").alias("sig"), F.round(F.sum("w"), 6).alias("total"))
    return ranking.top_per(totals, "sig", "total", "row_id", 4).select("sig", "row_id", _r("total", 4), "rn")


@query(f"WITH {PAIRS} SELECT row_id, col_id, round(w, 6) AS w FROM pairs ORDER BY round(w, 6) DESC, row_id, col_id LIMIT 50")
def top_edges(spark, d):
    return ranking.top(_pairs(spark, d).withColumn("w", F.round("w", 6)), "w", ["row_id", "col_id"], 50)


@query(f"WITH {PAIRS}, t AS (SELECT row_id FROM pairs GROUP BY row_id ORDER BY round(sum(w), 6) DESC, row_id LIMIT 20) SELECT row_id, col_id, round(w, 6) AS w FROM pairs WHERE row_id IN (SELECT row_id FROM t)")
def top_nodes_semi(spark, d):
    return ranking.top_nodes(_pairs(spark, d), "row_id", "w", 20).select("row_id", "col_id", _r("w"))


@query(f"WITH {PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY w DESC, col_id) AS rn FROM pairs) SELECT row_id, col_id, round(w, 6) AS w FROM k WHERE rn = 1")
def dominant_argmax(spark, d):
    return ranking.argmax(_pairs(spark, d), "row_id", "col_id", "w").select("row_id", "col_id", _r("w"))


@query(f"WITH {PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY w DESC, col_id) AS rn FROM pairs), m AS (SELECT * FROM k WHERE rn = 1) SELECT row_id, col_id, CAST(row_number() OVER (PARTITION BY col_id ORDER BY round(w, 6) DESC, row_id) AS BIGINT) AS place FROM m")
def lexsort_rows(spark, d):
    best = ranking.argmax(_pairs(spark, d), "row_id", "col_id", "w")
    place = F.row_number().over(Window.partitionBy("col_id").orderBy(F.round("w", 6).desc(), "row_id"))
    return best.select("row_id", "col_id", place.cast("long").alias("place"))


@query(f"WITH {RESIDUAL}, h AS (SELECT row_id, col_id FROM residual WHERE v > 5), n AS (SELECT DISTINCT col_id FROM residual), c AS (SELECT x.col_id AS a, y.col_id AS b, count(*) AS shared FROM h x JOIN h y ON x.row_id = y.row_id AND x.col_id < y.col_id GROUP BY ALL) SELECT p.col_id AS a, q.col_id AS b, coalesce(shared, 0) AS shared FROM n p JOIN n q ON p.col_id < q.col_id LEFT JOIN c ON c.a = p.col_id AND c.b = q.col_id")
def cotarget_pairs(spark, d):
    return matrix.cotargets(_staged(spark, d), 5.0)


@query(f"WITH {RESIDUAL}, h AS (SELECT row_id, col_id FROM residual WHERE v > 5) SELECT x.col_id AS a, y.col_id AS b, count(*) AS shared FROM h x JOIN h y ON x.row_id = y.row_id AND x.col_id < y.col_id GROUP BY ALL HAVING count(*) > 100 ORDER BY shared DESC, a, b LIMIT 10")
def cotarget_arcs(spark, d):
    return ranking.top(matrix.cotargets(_staged(spark, d), 5.0).where("shared > 100"), "shared", ["a", "b"], 10)


@query(f"WITH {PAIRS} SELECT col_id, CASE WHEN col_id IN ('FRANCE', 'GERMANY', 'RUSSIA') THEN 'first' WHEN col_id IN ('CHINA', 'JAPAN') THEN 'second' ELSE 'Other' END AS pathway, count(*) AS n, round(max(w), 6) AS most, round(avg(w), 6) AS mean FROM pairs GROUP BY ALL")
def pathway_gene_stats(spark, d):
    groups = spark.sql("SELECT * FROM VALUES ('FRANCE', 'first'), ('GERMANY', 'first'), ('RUSSIA', 'first'), ('CHINA', 'second'), ('JAPAN', 'second') AS t(col_id, pathway)")
    named = _pairs(spark, d).join(F.broadcast(groups), "col_id", "left").withColumn("pathway", F.coalesce("pathway", F.lit("Other")))
    return named.groupBy("col_id", "pathway").agg(F.count("*").alias("n"), F.round(F.max("w"), 6).alias("most"), F.round(F.avg("w"), 6).alias("mean"))


@query(f"WITH {PAIRS}, e AS (SELECT * FROM pairs WHERE w >= 40), g AS (SELECT row_id, count(DISTINCT col_id) AS k FROM e GROUP BY row_id) SELECT round(avg(k), 6) AS mean_degree, max(k) AS most, count(*) AS nodes, round(sum(k) / (count(*) * (SELECT count(DISTINCT col_id) FROM e)), 6) AS density FROM g")
def degree_density(spark, d):
    edges = matrix.edges(_pairs(spark, d), 40)
    degrees = edges.groupBy("row_id").agg(F.countDistinct("col_id").alias("k"))
    columns = edges.agg(F.countDistinct("col_id").alias("c"))
    return degrees.agg(F.avg("k").alias("mean_degree"), F.max("k").alias("most"), F.count("*").alias("nodes"), F.sum("k").alias("e")).crossJoin(columns).select(_r("mean_degree"), "most", "nodes", F.round(F.col("e") / (F.col("nodes") * F.col("c")), 6).alias("density"))


def _fix_sql() -> str:
    parts, name = [PAIRS + ", e0 AS (SELECT row_id, col_id FROM pairs WHERE w >= 55)"], "e0"
    for i in range(1, 6):
        parts.append(f"e{i} AS (SELECT row_id, col_id FROM (SELECT *, count(*) OVER (PARTITION BY row_id) AS r, count(*) OVER (PARTITION BY col_id) AS c FROM {name}) WHERE r >= 3 AND c >= 3)")
        name = f"e{i}"
    return "WITH " + ", ".join(parts) + f" SELECT row_id, col_id FROM {name}"


@query(_fix_sql())
def min_degree_fixpoint(spark, d):
    return graph.min_degree(matrix.edges(_pairs(spark, d), 55).select("row_id", "col_id"), 3)


@query(f"WITH {PAIRS} SELECT row_id, col_id, round((w - min(w) OVER ()) / CASE WHEN max(w) OVER () = min(w) OVER () THEN 1.0 ELSE max(w) OVER () - min(w) OVER () END, 6) AS scaled FROM pairs")
def minmax_norm(spark, d):
    return matrix.min_max(_pairs(spark, d), "w").select("row_id", "col_id", _r("scaled"))


@query(f"WITH {PAIRS}, t AS (SELECT row_id, sum(w) AS total FROM pairs GROUP BY row_id) SELECT row_id, round((total - (SELECT avg(total) FROM t)) / (SELECT stddev_pop(total) FROM t), 5) AS scaled FROM t")
def standard_scaler(spark, d):
    totals = _pairs(spark, d).groupBy("row_id").agg(F.sum("w").alias("total"))
    return matrix.standard_scale(totals, "total").select("row_id", _r("scaled", 5))


@query(f"WITH {GRID}, p AS (SELECT row_id, w / sum(w) OVER (PARTITION BY row_id) AS p FROM grid) SELECT row_id, round(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(25), 5) AS entropy, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(25) > 0.8 AS mixed FROM p GROUP BY row_id")
def entropy_mixed(spark, d):
    return matrix.entropy(matrix.stored_shares(_staged(spark, d)), "p", 25).select("row_id", _r("entropy", 5), "mixed")


@query(f"WITH {PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY w DESC, col_id) AS rn FROM pairs), s AS (SELECT col_id, count(*) AS n FROM k WHERE rn = 1 GROUP BY col_id) SELECT col_id, n, round(n / (SELECT sum(n) FROM s), 6) AS share, CAST(row_number() OVER (ORDER BY n DESC, col_id) AS BIGINT) AS rank FROM s")
def signature_sizes(spark, d):
    best = ranking.argmax(_pairs(spark, d), "row_id", "col_id", "w")
    return ranking.shares(best.select("row_id", "col_id"), "col_id").select("col_id", "n", _r("share"), "rank")


@query("SELECT l_partkey AS row_id, count(*) AS n, round(avg(abs(l_extendedprice / 7.31 - m)), 3) AS mean_dev, round(sum(abs(l_extendedprice / 7.31 - q)) / count(*), 3) AS median_dev FROM (SELECT *, avg(l_extendedprice / 7.31) OVER (PARTITION BY l_partkey) AS m, quantile_cont(l_extendedprice / 7.31, 0.5) OVER (PARTITION BY l_partkey) AS q FROM lineitem) GROUP BY l_partkey")
def stats_mad(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("row_id"), (F.col("l_extendedprice") / 7.31).alias("x"))
    middle = rows.groupBy("row_id").agg(F.avg("x").alias("m"), F.percentile("x", F.lit(0.5)).alias("q"))
    return rows.join(middle, "row_id").groupBy("row_id").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("x") - F.col("m"))), 3).alias("mean_dev"), F.round(F.avg(F.abs(F.col("x") - F.col("q"))), 3).alias("median_dev"))
