"""Queries over features, grips, labels, orderings, lookups, updates and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindlattice.functions import sequence as seq
from bindlattice.operators import design, fold, joins, matrix, ranking, signal, structure
from bindlattice.operators import sites as site
from bindlattice.plans.site_queries import SIGNAL, STRANDS, _signal, _strands
from bindlattice.plans.surrogate import PAIRS, SITES, sites, table
from bindlattice.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_KINDS, _TARGETS = ("A", "N", "seedless"), tuple(f"NATION_{i}" for i in range(25))


@query(
    f"WITH {SITES}, f AS (SELECT row_id, count(*) AS n_sites, avg(kd) AS mean_kd FROM sites GROUP BY row_id), "
    f"k AS (SELECT row_id, {', '.join(f'count(*) FILTER (WHERE seed_type = {chr(39)}{k}{chr(39)}) / count(*)::DOUBLE AS seed_{k}' for k in _KINDS)} FROM sites WHERE seed_type IS NOT NULL GROUP BY row_id), "
    f"t AS (SELECT row_id, {', '.join(f'count(*) FILTER (WHERE col_id = {chr(39)}{t}{chr(39)}) / count(*)::DOUBLE AS target_{t}' for t in _TARGETS)} FROM sites GROUP BY row_id) "
    f"SELECT f.row_id, n_sites, round(mean_kd, 9) AS mean_kd, {', '.join(f'round(coalesce(seed_{k}, 0), 9) AS seed_{k}' for k in _KINDS)}, {', '.join(f'round(coalesce(target_{t}, 0), 9) AS target_{t}' for t in _TARGETS)} FROM f LEFT JOIN k ON k.row_id = f.row_id LEFT JOIN t ON t.row_id = f.row_id"
)
def feature_table(spark, d):
    """Features of each row, joined with its seed and target shares; gaps are 0."""
    rows = sites(spark, d)
    basic = rows.groupBy("row_id").agg(F.count("*").alias("n_sites"), F.avg("kd").alias("mean_kd"))
    wide = matrix.feature_table(basic, {"seed": (matrix.proportions(rows, "seed_type"), "seed_type", _KINDS), "target": (matrix.proportions(rows, "col_id"), "col_id", _TARGETS)})
    return wide.select("row_id", "n_sites", *(F.round(c, 9).alias(c) for c in wide.columns if c not in ("row_id", "n_sites")))


GRIPS = f"{STRANDS}, k AS (SELECT key, pos, s[pos + 1:pos + 4] AS w FROM (SELECT key, s, unnest(range(0, length(s) - 3)) AS pos FROM strands)), grips AS (SELECT DISTINCT a.w || '/' || b.w AS grip, p_size AS grp, a.key FROM k a JOIN k b ON a.key = b.key AND a.pos - b.pos BETWEEN 11 AND 18 JOIN part ON p_partkey = a.key)"


def _grips(spark, d) -> DataFrame:
    """(grip, transcript_id): grips of the parts of each size, which stands for a transcript."""
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("transcript_id"), F.col("p_size").alias("grp"))
    # Grips of equal strings are cut once and meet each size of their parts once.
    members, texts = joins.alike(_strands(spark, d), "key", "s")
    groups = members.join(sizes.hint("merge"), F.col("key") == F.col("transcript_id")).select(F.col("text").alias("transcript_id"), "grp").distinct()
    found = design.grips(texts.select(F.col("text").alias("transcript_id"), F.col("s").alias("sequence")), 4, 4, 10)
    return found.select("grip", "transcript_id").distinct().join(groups, "transcript_id").select("grip", F.col("grp").alias("transcript_id")).distinct()


@query(f"WITH {GRIPS}, q AS (SELECT DISTINCT grip, grp FROM grips), r AS (SELECT grip FROM q WHERE grp <= 4 GROUP BY grip HAVING count(*) = (SELECT count(DISTINCT grp) FROM q WHERE grp <= 4)), x AS (SELECT grip FROM q WHERE grp > 30 AND grip IN (SELECT grip FROM r) GROUP BY grip HAVING count(*) = (SELECT count(DISTINCT grp) FROM q WHERE grp > 30)) SELECT grip FROM r WHERE grip NOT IN (SELECT grip FROM x)")
def required_grips(spark, d):
    found = _grips(spark, d)
    sizes = table(spark, d, "part").select(F.col("p_size").alias("transcript_id")).distinct()
    return design.required_grips(found, sizes.where("transcript_id <= 4"), sizes.where("transcript_id > 30"))


@query(f"WITH {GRIPS}, q AS (SELECT DISTINCT grip, grp FROM grips) SELECT count(*) AS grips, round(avg(n), 9) AS guides_per_grip FROM (SELECT grip, count(*) AS n FROM q GROUP BY grip)")
def guides_per_grip(spark, d):
    counts = _grips(spark, d).groupBy("grip").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("grips"), F.round(F.avg("n"), 9).alias("guides_per_grip"))


@query("SELECT l_suppkey AS antisense FROM lineitem WHERE l_quantity <= 25 AND l_linenumber <= 7 GROUP BY l_suppkey HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_linenumber <= 7)")
def complete_sequences(spark, d):
    """Strings with a site of small kd in every required transcript; incomplete ones go."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("antisense"), F.col("l_linenumber").alias("transcript_id"), F.col("l_quantity").alias("kd"))
    return design.covers_every_target(rows.where("transcript_id <= 7"), rows.where("transcript_id <= 7"), 25.0)


@query("SELECT DISTINCT p_partkey AS antisense FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber > 4 AND l_quantity < 10)")
def binds_excluded(spark, d):
    """Strings with a site that folds in an excluded transcript."""
    folds = table(spark, d, "lineitem").where("l_linenumber > 4 and l_quantity < 10").select(F.col("l_partkey").alias("antisense"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("antisense")).join(folds, "antisense", "left_semi")


@query("WITH p AS (SELECT c_nationkey || '/' || c_mktsegment || '/' || CAST(floor(c_acctbal / 500) AS BIGINT) AS grip, c_custkey AS t FROM customer) SELECT a.grip, a.t AS here_t, b.t AS there_t FROM p a JOIN p b ON a.grip = b.grip AND a.t < b.t")
def cross_hybrids(spark, d):
    grip = F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment", F.floor(F.col("c_acctbal") / 500).cast("string"))
    rows = table(spark, d, "customer").select(grip.alias("grip"), F.col("c_custkey").alias("transcript_id"), F.lit(0).alias("pos3p"))
    return design.cross_hybrids(rows).select("grip", F.col("here.transcript_id").alias("here_t"), F.col("there.transcript_id").alias("there_t"))


@query(f"WITH {STRANDS}, c AS (SELECT s[pos + 1:pos + k] AS kmer, count(*) AS n FROM (SELECT s, k, unnest(range(0, length(s) - k + 1)) AS pos FROM strands, range(5, 8) r(k)) GROUP BY 1) SELECT key, round((coalesce(a.n, 0) + coalesce(b.n, 0) / 10.0 + coalesce(c.n, 0) / 100.0) / 3, 9) AS disturbance FROM strands LEFT JOIN c a ON a.kmer = s[1:7] LEFT JOIN c b ON b.kmer = s[1:6] LEFT JOIN c c ON c.kmer = s[1:5]")
def seed_disturbance(spark, d):
    rows = _strands(spark, d)
    each = F.concat(*(seq.kmers("s", k) for k in (5, 6, 7)))
    counts = rows.select(F.explode(each).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    return design.disturbance(rows.select("key", F.col("s").alias("word")), counts).select("key", F.round("disturbance", 9).alias("disturbance"))


@query(f"WITH {STRANDS} SELECT key, kmer || s[3:8] AS extended FROM strands, (SELECT a || b AS kmer FROM (VALUES ('A'), ('C'), ('G'), ('U')) p(a), (VALUES ('A'), ('C'), ('G'), ('U')) q(b)) WHERE length(s) >= 8")
def extended_seeds(spark, d):
    """Every seed with each pair of letters written over its first two."""
    rows = _strands(spark, d).where(F.length("s") >= 8).select("key", F.substring("s", 1, 8).alias("extended"))
    return design.mutated(rows, "extended", 1, 2)


_WC = "('AU', 'UA', 'GC', 'CG')"
_SEED_KINDS = "array_to_string(list_transform(range(1, 5), lambda i: CASE WHEN seed[i:i] || rev[i:i] IN ('AU', 'UA', 'GC', 'CG') THEN 'W' WHEN seed[i:i] || rev[i:i] IN ('GU', 'UG') THEN 'G' ELSE 'x' END), '')"


@query(f"WITH {STRANDS}, w AS (SELECT DISTINCT s[1:5] AS word FROM strands), k AS (SELECT a || b || c || d AS seed FROM (VALUES ('A'), ('C'), ('G'), ('U')) p(a), (VALUES ('A'), ('C'), ('G'), ('U')) q(b), (VALUES ('A'), ('C'), ('G'), ('U')) r(c), (VALUES ('A'), ('C'), ('G'), ('U')) t(d)), z AS (SELECT word, seed, {_SEED_KINDS} AS kinds FROM (SELECT word, seed, reverse(word[2:5]) AS rev FROM w, k)) SELECT word, seed, kinds FROM z WHERE length(replace(replace(kinds, 'W', ''), 'G', '')) <= 1 AND (kinds = 'WWWW' OR length(regexp_replace(kinds, '[^W]', '', 'g')) >= 3)")
def fitting_seeds(spark, d):
    words = _strands(spark, d).select(F.substring("s", 1, 5).alias("word")).distinct()
    return design.fitting_seeds(words, 4).select("word", "seed", "kinds")


@query(f"WITH {STRANDS}, c AS (SELECT key, 'C' || s[1:4] || x || 'UUAA' || s[5:7] || y || 'AAUU' AS antisense FROM strands, (SELECT p.a || q.a || r.a AS x FROM (VALUES ('A'), ('C'), ('G'), ('U')) p(a), (VALUES ('A'), ('C'), ('G'), ('U')) q(a), (VALUES ('A'), ('C'), ('G'), ('U')) r(a)), (SELECT p.a || q.a AS y FROM (VALUES ('A'), ('C'), ('G'), ('U')) p(a), (VALUES ('A'), ('C'), ('G'), ('U')) q(a))) SELECT key, count(*) AS n, min(antisense) AS first FROM c WHERE antisense NOT LIKE '%GGG%' AND antisense NOT LIKE '%CCC%' AND length(regexp_replace(antisense, '[^GC]', '', 'g'))::DOUBLE / length(antisense) BETWEEN 0.3 AND 0.7 GROUP BY key")
def antisense_strings(spark, d):
    # The strings depend on seven letters alone, so they are made once for all parts that share these.
    words = _strands(spark, d).select("key", F.substring("s", 1, 4).alias("seed4"), F.substring("s", 5, 3).alias("supp3"))
    each = words.select(F.struct("seed4", "supp3").alias("grip"), "seed4", "supp3").distinct()
    made = design.antisense_candidates(each, ["GGG", "CCC"]).groupBy("grip").agg(F.count("*").alias("n"), F.min("antisense").alias("first"))
    met = words.join(made.select("grip.*", "n", "first"), ["seed4", "supp3"])
    return met.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


@query("SELECT o_orderkey AS k, o_orderkey % 15 < 13 OR o_custkey % 5 <= 2 AS binds, o_orderkey % 4 > 0 AND o_custkey % 20 <= 15 AND (o_orderkey % 15 < 13 OR o_custkey % 5 <= 2) AS passes FROM orders")
def bind_condition(spark, d):
    bound = structure.binds(F.col("o_orderkey") % 15, F.col("o_custkey") % 5)
    folded, near = F.col("o_orderkey") % 4 > 0, F.col("o_custkey") % 20 <= 15
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), bound.alias("binds"), (folded & near & bound).alias("passes"))


@query("SELECT event_id, try_cast(v AS DOUBLE) IS NOT NULL AS is_double, try_cast(v AS INTEGER) IS NOT NULL AND v NOT LIKE '%.%' AS is_int, regexp_full_match(v, '[0-9.x-]*') AS allowed FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN user_id || '.5' WHEN 2 THEN user_id || 'x' ELSE '-' || user_id END AS v FROM events)")
def validators(spark, d):
    v = F.expr("CASE event_id % 4 WHEN 0 THEN CAST(user_id AS string) WHEN 1 THEN concat(user_id, '.5') WHEN 2 THEN concat(user_id, 'x') ELSE concat('-', user_id) END")
    return table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", seq.is_double("v").alias("is_double"), seq.is_int("v").alias("is_int"), seq.only_letters("v", "0-9.x-").alias("allowed"))


@query("SELECT o_orderkey AS k, coalesce(c_name, 'guide-' || o_custkey * 2) AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2")
def name_lookup(spark, d):
    """Names by key, with a name made from the key where there is none."""
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("guide"), F.col("c_name").alias("name"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") * 2).alias("guide"))
    return joins.named(asked, names, "guide", "name", F.concat(F.lit("guide-"), F.col("guide").cast("string"))).select("k", "name")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name = 'Customer#000000042' LIMIT 1")
def key_lookup(spark, d):
    return joins.lookup(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_name", "Customer#000000042")


@query("SELECT DISTINCT label FROM (SELECT c_nationkey - 1 AS label FROM customer) WHERE label <> -1")
def labels_without_noise(spark, d):
    return table(spark, d, "customer").select((F.col("c_nationkey") - 1).alias("label")).where("label <> -1").distinct()


@query("WITH g AS (SELECT s_suppkey AS id, list(DISTINCT s_nationkey % 4 ORDER BY s_nationkey % 4) || [9] AS items FROM supplier GROUP BY s_suppkey), m AS (SELECT id, items, unnest(range(0, CAST(pow(2, len(items)) AS BIGINT))) AS mask FROM g) SELECT id, mask, CAST(len(list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1)) AS INTEGER) AS size, list_contains(list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1), 9) AS has_nine FROM m")
def power_sets(spark, d):
    items = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_nationkey") % 4, F.lit(9)).alias("items"))
    sets = items.select("id", F.posexplode(seq.power_set("items")).alias("mask", "members"))
    return sets.select("id", F.col("mask").cast("long").alias("mask"), F.size("members").alias("size"), seq.contains_all("members", F.array(F.lit(9))).alias("has_nine"))


@query("SELECT n_name AS gene, r_name AS pathway, row_number() OVER (ORDER BY r_name, n_name) AS place FROM nation JOIN region ON r_regionkey = n_regionkey")
def pathway_order(spark, d):
    regions = table(spark, d, "region")
    rows = table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("gene"), F.col("r_name").alias("pathway"))
    return ranking.ordered(rows, ["pathway", "gene"], "place")


@query(f"WITH {PAIRS}, b AS (SELECT col_id, arg_max(row_id, {{'w': w, 'r': -row_id}}) AS best, max(w) AS loading, sum(w) AS total FROM pairs GROUP BY col_id) SELECT col_id, row_number() OVER (ORDER BY best, -loading, col_id) AS by_best, row_number() OVER (ORDER BY -round(total, 4), col_id) AS by_weight FROM b")
def column_orders(spark, d):
    """Places of the columns by their best row and falling loading, and by falling weight."""
    pairs = matrix.pair_mean(sites(spark, d))
    best = ranking.argmax(pairs, "col_id", "row_id", "w").withColumnsRenamed({"row_id": "best", "w": "loading"})
    totals = pairs.groupBy("col_id").agg(F.round(F.sum("w"), 4).alias("total"))
    placed = ranking.ordered(best.join(totals, "col_id").withColumns({"down": -F.col("loading"), "light": -F.col("total")}), ["best", "down", "col_id"], "by_best")
    return ranking.ordered(placed, ["light", "col_id"], "by_weight").select("col_id", "by_best", "by_weight")


@query(f"WITH {SIGNAL}, k AS (SELECT key % 5 AS key, pos, value, row_number() OVER (PARTITION BY key % 5 ORDER BY key, pos) - 1 AS p FROM signal), z AS (SELECT key, count(*) // 40 AS size FROM k GROUP BY key), b AS (SELECT k.key, p // size AS bin, avg(value) AS m FROM k JOIN z USING (key) WHERE size > 0 AND p // size < 40 GROUP BY ALL) SELECT a.key, a.bin, round(sum(exp(-pow(a.bin - b.bin, 2) / 8.0) * b.m) / sum(exp(-pow(a.bin - b.bin, 2) / 8.0)), 5) AS smooth FROM b a JOIN b ON a.key = b.key AND abs(a.bin - b.bin) <= 6 GROUP BY a.key, a.bin")
def binned_and_smoothed(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy((F.col("key") % 5)).orderBy("key", "pos")) - 1
    rows = _signal(spark, d).withColumn("p", place).select((F.col("key") % 5).alias("key"), F.col("p").alias("pos"), "value")
    return signal.binned_gaussian(rows, 40, 2.0).select("key", "bin", F.round("smooth", 5).alias("smooth"))


@query("SELECT k, count(*) AS n, min(v) AS least, max(v) AS most FROM (SELECT unnest(json_keys(props)) AS k, CAST(json_extract(props, '$.' || unnest(json_keys(props))) AS BIGINT) AS v FROM events) GROUP BY k")
def json_props(spark, d):
    """Every key of the objects, with how often it occurs and its extremes."""
    pairs = table(spark, d, "events").select(F.explode(F.from_json("props", "map<string, bigint>")).alias("k", "v"))
    return pairs.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


@query("WITH a AS (SELECT o_custkey % 100 AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_partkey % 120 AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS new_rows, coalesce(b.n, 0) AS old_rows, coalesce(a.n, 0) = coalesce(b.n, 0) AS agrees FROM a FULL JOIN b ON a.k = b.k")
def reconcile_counts(spark, d):
    new = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("k"))
    old = table(spark, d, "lineitem").where("l_linenumber = 1").select((F.col("l_partkey") % 120).alias("k"))
    return joins.reconcile(new, old, ["k"])


@query("SELECT l_orderkey AS trn, l_partkey AS gseq, l_linenumber AS pst, l_returnflag = 'R' OR k.a IS NOT NULL AS itb, count(*) AS n FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey AS a FROM orders WHERE o_orderstatus = 'F') k ON k.a = l_orderkey AND l_linenumber = 1 GROUP BY ALL")
def validated_update(spark, d):
    """Flags of validated sites are set, others stay."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trn"), F.col("l_partkey").alias("gseq"), F.col("l_linenumber").alias("pst"), (F.col("l_returnflag") == "R").alias("itb"))
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("transcript"))
    known = rows.where("pst = 1").select("trn", "gseq").distinct().join(done, F.col("trn") == F.col("transcript")).select("transcript", F.col("gseq").alias("guide"), F.lit(1).alias("position"))
    return files.mark_validated(rows, known).groupBy("trn", "gseq", "pst", "itb").agg(F.count("*").alias("n"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'urgent', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def table_counts(spark, d):
    named = {n: table(spark, d, n) for n in ("orders", "customer", "lineitem")}
    return files.counts(named | {"urgent": named["orders"].where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")})


@query("SELECT o_orderkey % 11 AS a, o_orderkey % 7 AS w, round(1e9 / (0.25 * (1 + o_orderkey % 11) + 0.75 * (1 + o_orderkey % 7)), 6) AS kd FROM orders GROUP BY ALL")
def seedless_affinity(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_orderkey") % 11).alias("a"), (F.col("o_orderkey") % 7).alias("w")).distinct()
    return rows.select("a", "w", F.round(site.seedless_kd(-(F.col("a") + 1).cast("double"), -(F.col("w") + 1).cast("double")), 6).alias("kd"))


_OLD = "CASE WHEN m = '11111111' THEN '8-mer' WHEN m LIKE '1111111_' THEN '7-mer-m8' WHEN m LIKE '_111111_' AND a1 THEN '7-mer-A1' WHEN m LIKE '_111111_' THEN '6-mer' WHEN m LIKE '111111__' THEN 'offset-6-mer' WHEN length(replace(m, '0', '')) >= 6 THEN '1-bulge' ELSE 'seedless' END"


@query(f"SELECT k, m, {_OLD} AS seed_type FROM (SELECT o_orderkey AS k, array_to_string(list_transform(range(8), lambda i: CASE WHEN (o_orderkey * 37 >> i) & 3 > 0 THEN '1' ELSE '0' END), '') AS m, o_custkey % 2 = 0 AS a1 FROM orders)")
def older_seed_types(spark, d):
    bits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.floor(F.col("o_orderkey") * 37 / F.pow(F.lit(2.0), i)) % 4 > 0, "1").otherwise("0"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.array_join(bits, "").alias("m"), (F.col("o_custkey") % 2 == 0).alias("a1"))
    return rows.select("k", "m", site.older_seed_type(F.col("m"), F.col("a1")).alias("seed_type"))


@query(f"WITH {STRANDS}, g AS (SELECT (key % 40) || '/' || length(s) AS grp, key AS id, s AS structure FROM strands) SELECT a.grp AS key, a.id, b.id AS other, CAST(hamming(a.structure, b.structure) AS INTEGER) AS apart FROM g a JOIN g b ON a.grp = b.grp AND a.id < b.id WHERE hamming(a.structure, b.structure) <= 3")
def structure_graph(spark, d):
    """Whole strings of one length that differ in at most three places."""
    rows = _strands(spark, d).select(F.concat((F.col("key") % 40).cast("string"), F.lit("/"), F.length("s").cast("string")).alias("key"), F.col("key").alias("id"), F.col("s").alias("structure"))
    return fold.structure_graph(rows)
