"""Queries over dot-bracket structures, and the scan of guides against transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindlattice.functions import sequence as seq
from bindlattice.operators import fold, joins, ranking, scan, signal, structure
from bindlattice.operators import sites as site
from bindlattice.plans.site_queries import STRANDS, _strands
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


# Two helices, of odd parts inside a third one; sizes come from the part's columns.
_DRAWN = "repeat('(', o) || repeat('(', a) || repeat('.', b) || repeat(')', a) || repeat('.', c) || repeat('(', e) || '...' || repeat(')', e) || repeat(')', o)"
STRUCTURES = f"""{STRANDS}, sized AS (
  SELECT p_partkey AS id, p_brand AS key, p_size AS size, CAST(3 + p_size % 5 AS INTEGER) AS a, CAST(3 + p_partkey % 4 AS INTEGER) AS b, CAST(p_size % 3 AS INTEGER) AS c,
    CAST(2 + p_partkey % 3 AS INTEGER) AS e, CAST(2 * (p_partkey % 2) AS INTEGER) AS o FROM part
), structures AS (SELECT z.*, {_DRAWN} AS structure, s || s AS letters FROM sized z JOIN strands t ON t.key = z.id)"""
PAIRS = f"""{STRUCTURES}, pairs AS (
  SELECT id, key, size, letters, x AS i, length(structure) - 1 - x AS j FROM (SELECT *, unnest(range(0, o)) AS x FROM structures)
  UNION ALL SELECT id, key, size, letters, o + x, o + 2 * a + b - 1 - x FROM (SELECT *, unnest(range(0, a)) AS x FROM structures)
  UNION ALL SELECT id, key, size, letters, o + 2 * a + b + c + x, o + 2 * a + b + c + 2 * e + 2 - x FROM (SELECT *, unnest(range(0, e)) AS x FROM structures)
)"""


def _structures(spark, d) -> DataFrame:
    """id, key, weight, structure and a sequence at least as long, of each part."""
    drawn = table(spark, d, "part").selectExpr(
        "p_partkey AS id", "p_brand AS key", "CAST(p_size AS double) AS weight", "CAST(3 + p_size % 5 AS int) AS a", "CAST(3 + p_partkey % 4 AS int) AS b",
        "CAST(p_size % 3 AS int) AS c", "CAST(2 + p_partkey % 3 AS int) AS e", "CAST(2 * (p_partkey % 2) AS int) AS o",
    ).selectExpr("id", "key", "weight", f"{_DRAWN} AS structure")
    letters = _strands(spark, d).select(F.col("key").alias("id"), F.concat("s", "s").alias("letters"))
    return drawn.join(letters, "id").select("id", "key", "weight", "structure", F.substring(F.col("letters"), F.lit(1), F.length("structure")).alias("sequence"))


def _long(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("long") for c in columns})


@query(f"WITH {PAIRS} SELECT id, i, j FROM pairs")
def structure_pairs(spark, d):
    return _long(fold.pairs_of(_structures(spark, d)), "i", "j")


@query(f"WITH {PAIRS}, t AS (SELECT size AS w, key FROM structures), z AS (SELECT key, sum(w) AS total FROM t GROUP BY key) SELECT p.key, i, j, round(sum(size) / any_value(total), 9) AS frequency FROM pairs p JOIN z ON p.key = z.key GROUP BY p.key, i, j")
def contact_map(spark, d):
    return _long(fold.contact_map(_structures(spark, d)), "i", "j").withColumn("frequency", F.round("frequency", 9))


@query(f"WITH {PAIRS}, z AS (SELECT key, sum(size) AS total FROM structures GROUP BY key), f AS (SELECT p.key, sum(size) / any_value(total) AS v FROM pairs p JOIN z ON p.key = z.key GROUP BY p.key, i, j), m AS (SELECT key, sum(v) AS total, max(v) AS most, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, avg(v) AS mean, var_samp(v) AS variance, stddev_samp(v) AS deviation FROM f GROUP BY key), a AS (SELECT f.key, avg(abs(v - mean)) AS mad_mean, avg(abs(v - median)) AS mad_median FROM f JOIN m ON f.key = m.key GROUP BY f.key) SELECT m.key, round(total, 7) AS total, round(most, 7) AS most, round(q1, 7) AS q1, round(median, 7) AS median, round(mean, 7) AS mean, round(variance, 7) AS variance, round(deviation, 7) AS deviation, round(mad_mean, 7) AS mad_mean, round(mad_median, 7) AS mad_median FROM m JOIN a ON a.key = m.key")
def contact_statistics(spark, d):
    found = structure.statistics(fold.contact_map(_structures(spark, d)), "key", "frequency")
    return found.select("key", *(F.round(c, 7).alias(c) for c in found.columns if c != "key"))


@query(f"WITH {STRUCTURES} SELECT id, o + a AS first, o + a + b - 1 AS last, true AS hairpin FROM structures UNION ALL SELECT id, o + 2 * a + b, o + 2 * a + b + c - 1, false FROM structures WHERE c > 0 UNION ALL SELECT id, o + 2 * a + b + c + e, o + 2 * a + b + c + e + 2, true FROM structures")
def structure_loops(spark, d):
    return structure.loops(_structures(spark, d))


@query(f"WITH {STRUCTURES} SELECT id, CASE WHEN o > 0 THEN '(()())' ELSE '()()' END AS shape FROM structures")
def abstract_shapes(spark, d):
    return structure.shapes(_structures(spark, d))


@query(f"WITH {PAIRS}, b AS (SELECT id, i, j, letters[i + 1:i + 1] || letters[j + 1:j + 1] AS two FROM pairs) SELECT id, i, j, CASE WHEN two IN ('AU', 'UA', 'GC', 'CG') THEN ')' WHEN two IN ('GU', 'UG') THEN '}}' ELSE '>' END AS type FROM b")
def duplex_pair_types(spark, d):
    return _long(structure.pair_types(_structures(spark, d)), "i", "j")


@query(f"WITH {STRUCTURES}, h AS (SELECT id, unnest(range(0, o - 1)) AS i FROM structures UNION ALL SELECT id, o + unnest(range(0, a - 1)) FROM structures UNION ALL SELECT id, o + 2 * a + b + c + unnest(range(0, e - 1)) FROM structures) SELECT id, i, 0::BIGINT AS \"left\", 0::BIGINT AS \"right\" FROM h")
def stacked_interiors(spark, d):
    return _long(structure.interiors(_structures(spark, d)), "i", "left", "right")


@query(f"WITH {STRUCTURES}, c AS (SELECT key, p - 1 AS pos, structure[p:p] AS ch FROM (SELECT *, unnest(range(1, length(structure) + 1)) AS p FROM structures)) SELECT key, pos, count(*) AS n, count(*) FILTER (WHERE ch = '(') AS opens, count(*) FILTER (WHERE ch = ')') AS closes, count(*) FILTER (WHERE ch = '.') AS dots FROM c GROUP BY key, pos")
def pair_profile(spark, d):
    return _long(structure.profile(_structures(spark, d)), "pos")


@query(f"WITH {STRUCTURES}, w AS (SELECT id, structure[5:12] AS state, structure FROM structures) SELECT id, contains(state, '....') AS accessible, length(structure) - length(replace(structure, '(', '')) = length(structure) - length(replace(structure, ')', '')) AS balanced, array_to_string(list_filter(['two', 'wide', 'none'], lambda x: (x = 'two' AND regexp_full_match(structure, '\\(+\\.+\\)+\\.*\\(+\\.+\\)+')) OR (x = 'wide' AND regexp_full_match(structure, '\\(\\(.*\\)\\)')) OR (x = 'none' AND regexp_full_match(structure, '\\.+'))), ',') AS masks FROM w")
def structure_masks(spark, d):
    masks = {"two": r"\(+\.+\)+\.*\(+\.+\)+", "wide": r"\(\(.*\)\)", "none": r"\.+"}
    state = F.substring("structure", 5, 8)
    return _structures(spark, d).select("id", structure.accessible(state).alias("accessible"), structure.is_shape("structure").alias("balanced"), F.array_join(structure.mask_names("structure", masks), ",").alias("masks"))


@query(f"WITH {STRUCTURES}, h AS (SELECT id, letters, o + a AS f, b AS n, o + 2 * a + b + c + e AS g FROM structures), q AS (SELECT *, letters[f + 1:f + 3] AS x, reverse(letters[g + 1:g + 3]) AS y, n FROM h), k AS (SELECT id, CAST(f AS BIGINT) AS first, CAST(g AS BIGINT) AS second, CAST(list_sum(list_transform(range(1, 4), lambda p: CASE WHEN x[p:p] || y[p:p] IN ('AU', 'UA', 'GC', 'CG', 'GU', 'UG') THEN 1 ELSE 0 END)) AS BIGINT) AS pairs FROM q) SELECT * FROM k WHERE pairs >= 2")
def pseudoknot_loops(spark, d):
    return _long(structure.pseudoknots(_structures(spark, d)), "first", "second")


@query(f"WITH {STRUCTURES}, r AS (SELECT key, -size AS energy, structure, id, row_number() OVER (PARTITION BY key ORDER BY -size, structure, id) AS rank FROM (SELECT key, size, structure, min(id) AS id FROM structures GROUP BY key, size, structure)) SELECT key, CAST(energy AS DOUBLE) AS energy, structure, rank FROM r WHERE rank <= 5")
def best_structures(spark, d):
    rows = _structures(spark, d).select("key", (-F.col("weight")).alias("energy"), "structure").distinct()
    return structure.best_structures(rows, 5)


@query(f"WITH {STRUCTURES}, c AS (SELECT key, id, p - 1 + id % 7 AS pos, CASE WHEN structure[p:p] = '.' THEN 0.0 ELSE 1.0 END AS v FROM (SELECT *, unnest(range(1, least(20, length(structure)) + 1)) AS p FROM structures)) SELECT key, pos, round(avg(v), 9) AS p FROM c GROUP BY key, pos")
def tile_profile(spark, d):
    paired = F.transform(F.split("structure", ""), lambda c: F.when(c == ".", 0.0).otherwise(1.0))
    tiles = _structures(spark, d).select("key", (F.col("id") % 7).alias("start"), paired.alias("paired"))
    return signal.tile_accessibility(tiles, 20).withColumn("p", F.round("p", 9))


@query(f"WITH {STRUCTURES}, c AS (SELECT id, [CASE WHEN x = '.' THEN 0.0 ELSE 1.0 END / (1 + id % 5) FOR x IN string_split(structure, '')] AS p FROM structures) SELECT id, round(1 - list_min(p[id % 4 + 1:id % 4 + 7]), 9) AS accessibility FROM c")
def span_accessibility(spark, d):
    p = F.transform(F.split("structure", ""), lambda c: F.when(c == ".", 0.0).otherwise(1.0) / (1 + F.col("id") % 5))
    rows = _structures(spark, d).select("id", p.alias("p"))
    spans = rows.select("id", (F.col("id") % 4).cast("int").alias("b"), (F.col("id") % 4 + 6).cast("int").alias("e"))
    return signal.accessibility(rows.withColumnRenamed("id", "key"), spans.withColumn("key", F.col("id"))).select("id", F.round("accessibility", 9).alias("accessibility"))


# Guides: what pairs with the longest strand of each brand; transcripts: strands, there and back.
LONGEST = STRANDS + ", longest AS (SELECT p_brand, key, s FROM (SELECT p_brand, key, s, row_number() OVER (PARTITION BY p_brand ORDER BY length(s) DESC, key) AS rn FROM strands JOIN part ON p_partkey = key) WHERE rn = 1)"


def _longest(spark, d) -> DataFrame:
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_brand")
    rows = _strands(spark, d).join(brands, "key").withColumn("size", F.length("s"))
    return ranking.first_writer(rows, ["p_brand"], [F.col("size").desc(), "key"]).drop("size")


@query(f"WITH {LONGEST} SELECT p_brand, key, s FROM longest")
def longest_per_family(spark, d):
    return _longest(spark, d).select("p_brand", "key", "s")


_KD = ", ".join(f"('{k}', {v})" for k, v in site.CLASS_KD.items())
_PAIRED = "('AU', 'UA', 'GC', 'CG', 'GU', 'UG')"
_SAME = "z.guide_id = h.guide_id AND z.transcript_id = h.transcript_id"
SCAN = f"""{LONGEST}, g AS (SELECT p_brand AS guide_id, reverse(translate(s, 'ACGU', 'UGCA'))[1:22] AS gs FROM longest),
t AS (SELECT key AS transcript_id, s || reverse(s) || s AS ts FROM strands),
w AS (SELECT transcript_id, pos, ts[pos + 1:pos + 4] AS word FROM (SELECT *, unnest(range(0, length(ts) - 3)) AS pos FROM t)),
sl AS (SELECT guide_id, k, reverse(translate(gs[2 + k:5 + k], 'ACGU', 'UGCA')) AS word FROM g, range(3) r(k)),
h AS (SELECT DISTINCT guide_id, transcript_id, pos, k FROM w JOIN sl USING (word)),
b1 AS (SELECT * FROM h WHERE k = 0 UNION ALL SELECT * FROM h WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM h z WHERE z.k = 0 AND {_SAME} AND z.pos = h.pos + 1)),
seeds AS (SELECT guide_id, transcript_id, pos + 3 + k AS g2, k AS seed_offset FROM (SELECT * FROM b1 UNION ALL SELECT * FROM h WHERE k = 2 AND NOT EXISTS (SELECT 1 FROM b1 z WHERE {_SAME} AND z.pos IN (h.pos + 1, h.pos + 2)))),
su AS (SELECT guide_id, k, word FROM g, range(2) r(k), (SELECT DISTINCT word FROM w) d WHERE {" AND ".join(f"gs[{17 - m} + k:{17 - m} + k] || word[{m}:{m}] IN {_PAIRED}" for m in range(1, 5))}),
supps AS (SELECT DISTINCT guide_id, transcript_id, pos + 3 + k AS g13, k AS supp_offset FROM w JOIN su USING (word)),
best AS (SELECT *, row_number() OVER (PARTITION BY guide_id, transcript_id, g2, seed_offset ORDER BY bridge, supp_offset) AS rn FROM (SELECT *, g2 - g13 - 7 AS bridge FROM seeds JOIN supps USING (guide_id, transcript_id)) WHERE bridge BETWEEN 1 AND 15),
placed AS (SELECT *, ts[g2 - 28:g2 + 2] AS win FROM best JOIN t USING (transcript_id) JOIN g USING (guide_id) WHERE rn = 1 AND g2 - 29 >= 0 AND g2 + 1 < length(ts)),
kinded AS (SELECT *, array_to_string(list_transform(range(2, 9), lambda i: CASE WHEN gs[i:i] || win[32 - i:32 - i] IN ('AU', 'UA', 'GC', 'CG') THEN 'W' WHEN gs[i:i] || win[32 - i:32 - i] IN ('GU', 'UG') THEN 'G' ELSE 'x' END), '') AS kinds,
  array_to_string(list_transform(range(13, 18), lambda i: CASE WHEN gs[i:i] || ts[g2 - bridge - 6 - (i - 13):g2 - bridge - 6 - (i - 13)] IN {_PAIRED} THEN '+' ELSE 'x' END), '') AS bound FROM placed),
classed AS (SELECT *, CASE WHEN bound = '+++++' THEN '5mer' WHEN bound LIKE '++++%' THEN '4mer' WHEN bound LIKE '_++++' THEN 'offset-4mer' ELSE 'suppless' END AS supp_class, CASE WHEN win[31:31] = 'A' THEN 'A1-' ELSE '' END AS a1 FROM kinded),
seeded AS (SELECT *, CASE
  WHEN kinds LIKE 'WWWW%' THEN a1 || CASE WHEN kinds[7:7] <> 'x' THEN '7mer' WHEN kinds[6:6] <> 'x' THEN '6mer' WHEN kinds[5:5] <> 'x' THEN '5mer' ELSE '4mer' END
  WHEN kinds LIKE '_WWWW%' THEN CASE WHEN kinds[7:7] <> 'x' THEN 'offset-6mer' WHEN kinds[6:6] <> 'x' THEN 'offset-5mer' ELSE 'offset-4mer' END
  WHEN kinds LIKE '__WWWW%' THEN CASE WHEN kinds[7:7] <> 'x' THEN 'distant-5mer' ELSE 'distant-4mer' END
  WHEN length(regexp_replace(kinds, '[^W]', '', 'g')) >= 6 THEN a1 || '7mer' ELSE 'seedless' END AS seed_class FROM classed)"""
_SPAN = "CASE WHEN seed_class LIKE 'offset%' THEN 2 WHEN seed_class LIKE 'distant%' THEN 3 ELSE 1 END"


@query(f"WITH {SCAN}, c(seed_class, base) AS (VALUES {_KD}), e AS (SELECT *, {_SPAN} AS f, coalesce(try_cast(regexp_extract(seed_class, '(\\d)mer', 1) AS INTEGER), 0) AS n FROM seeded JOIN c USING (seed_class)) SELECT guide_id, transcript_id, g2 - 29 AS position_start, bridge, win AS \"window\", seed_class, supp_class, round(log2(base) + coalesce(list_sum(list_transform(range(f, f + n), lambda i: CASE WHEN kinds[i:i] = 'G' THEN {list(site.WOBBLE)}[i] WHEN kinds[i:i] = 'x' THEN {list(site.MISMATCH)}[i] ELSE 0.0 END)), 0.0), 6) AS log2_kd FROM e")
def site_scan(spark, d):
    guides = _longest(spark, d).select(F.col("p_brand").alias("guide_id"), F.substring(seq.reverse_complement("s"), 1, 22).alias("sequence"))
    transcripts = _strands(spark, d).select(F.col("key").alias("transcript_id"), F.concat("s", F.reverse("s"), "s").alias("sequence"))
    found = scan.scan(guides, transcripts)
    return found.select("guide_id", "transcript_id", (F.col("g2") - 29).cast("long").alias("position_start"), F.col("bridge").cast("long").alias("bridge"), "window", "seed_class", "supp_class", F.round(F.log2("kd"), 6).alias("log2_kd"))


@query(f"WITH {SCAN} SELECT seed_class, supp_class, count(*) AS n FROM seeded WHERE seed_class <> 'seedless' GROUP BY ALL")
def scan_classes(spark, d):
    return site_scan(spark, d).where("seed_class <> 'seedless'").groupBy("seed_class", "supp_class").agg(F.count("*").alias("n"))


@query(f"WITH {LONGEST}, k AS (SELECT p_brand, pos, s[pos + 1:pos + 4] AS w FROM (SELECT p_brand, s, unnest(range(0, length(s) - 3)) AS pos FROM longest)), q AS (SELECT DISTINCT a.w || '/' || b.w AS grip, a.p_brand FROM k a JOIN k b ON a.p_brand = b.p_brand AND a.pos - b.pos BETWEEN 11 AND 18) SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS shared FROM q x JOIN q y ON x.grip = y.grip AND x.p_brand < y.p_brand GROUP BY ALL")
def grip_couplings(spark, d):
    """Grips that the longest strands of two families share."""
    from bindlattice.operators import design

    rows = _longest(spark, d).select(F.col("p_brand").alias("transcript_id"), F.col("s").alias("sequence"))
    return design.couplings(design.grips(rows, 4, 4, 10))


@query(f"WITH {STRANDS}, p AS (SELECT key, k, s[pos + 1:pos + k] AS kmer, pos FROM (SELECT key, s, k, unnest(range(0, length(s) - k + 1)) AS pos FROM strands, range(3, 6) r(k))) SELECT kmer, key, count(*) AS n, min(pos) AS first, max(pos) AS last FROM p WHERE kmer IN (SELECT kmer FROM p GROUP BY kmer HAVING count(DISTINCT key) >= 20) GROUP BY kmer, key")
def kmer_positions(spark, d):
    from bindlattice.operators import design

    found = design.kmer_positions(_strands(spark, d), "key", "s", 3, 5, 20)
    return found.select("kmer", "key", F.size("positions").cast("long").alias("n"), F.array_min("positions").cast("long").alias("first"), F.array_max("positions").cast("long").alias("last"))


@query("""WITH i AS (SELECT user_id % 50 AS k, event_id * 5 AS "start", event_id * 5 + 1 + event_id % 9 AS "end", event_id FROM events), p AS (SELECT o_orderkey AS probe, o_custkey % 50 AS k, o_orderkey * 4 AS at FROM orders)
SELECT p.probe, CASE WHEN p.at < i."end" THEN i.event_id ELSE -1 END AS event_id FROM p ASOF LEFT JOIN i ON p.k = i.k AND p.at >= i."start" """)
def point_in_interval(spark, d):
    spans = table(spark, d, "events").selectExpr("user_id % 50 AS k", "event_id * 5 AS start", "event_id * 5 + 1 + event_id % 9 AS end", "event_id")
    probes = table(spark, d, "orders").selectExpr("o_orderkey AS probe", "o_custkey % 50 AS k", "o_orderkey * 4 AS at")
    return joins.point_in_interval(spans, probes, "k", "at", "event_id", "probe", -1)


@query(f"WITH {STRANDS} SELECT key, strpos('ACGU' || s || 'GGG' || s, s[4:12]) - 1 AS at, 100 + strpos('ACGU' || s || 'GGG' || s, s[4:12]) - 1 AS genomic FROM strands")
def locate_shift(spark, d):
    rows = _strands(spark, d).withColumn("genome", F.concat(F.lit("ACGU"), "s", F.lit("GGG"), "s"))
    at = (F.expr("instr(genome, substring(s, 4, 9))") - 1).cast("long")
    return rows.select("key", at.alias("at"), (at + 100).alias("genomic"))


@query("SELECT l_partkey AS key, arg_min({'kd': l_quantity, 'o': l_orderkey, 'n': l_linenumber}, {'kd': l_quantity, 'o': l_orderkey, 'n': l_linenumber}).o AS best, min(l_quantity) AS kd FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus <> 'F' GROUP BY l_partkey")
def best_conformation(spark, d):
    """Least kd among conformations that are neither shifted (R) nor bulgy (F)."""
    rows = table(spark, d, "lineitem").where("l_returnflag <> 'R' and l_linestatus <> 'F'")
    best = F.min(F.struct(F.col("l_quantity").alias("kd"), F.col("l_orderkey").alias("o"), "l_linenumber"))
    return rows.groupBy(F.col("l_partkey").alias("key")).agg(best.alias("b")).select("key", F.col("b.o").alias("best"), F.col("b.kd").alias("kd"))


@query("SELECT l_partkey AS site, l_suppkey AS found_by, phase FROM (SELECT l_partkey, l_suppkey, l_linenumber % 4 AS phase, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber % 4, l_suppkey, l_orderkey) AS rn FROM lineitem) WHERE rn = 1")
def first_phase_coverage(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("found_by"), (F.col("l_linenumber") % 4).alias("phase"), "l_orderkey")
    return ranking.first_writer(rows, ["site"], ["phase", "found_by", "l_orderkey"]).select("site", "found_by", "phase")


_SLICES = (("seed", 2, 8), ("offset", 3, 8), ("distant", 4, 8), ("whole", 1, 22), ("supp", 13, 16), ("offset_supp", 14, 17))


@query(f"WITH {STRANDS} SELECT key, {', '.join(f's[{a}:{b}] AS {n}' for n, a, b in _SLICES)}, reverse(translate(s[13:16], 'ACGU', 'UGCA')) || reverse(translate(s[2:8], 'ACGU', 'UGCA')) AS antisense, length(s) - length(replace(s, 'A', '')) AS letters_a, reverse(s) AS backwards FROM strands")
def guide_regions(spark, d):
    rows = _strands(spark, d)
    return rows.select(
        "key", *(seq.region("s", a, b).alias(n) for n, a, b in _SLICES), F.concat(seq.reverse_complement(seq.region("s", 13, 16)), seq.reverse_complement(seq.region("s", 2, 8))).alias("antisense"),
        seq.count_letter("s", "A").cast("long").alias("letters_a"), F.reverse("s").alias("backwards"),
    )


_VARIANT_SQL = "SELECT key, pos FROM (SELECT key, s, unnest(range(0, length(s) - 3)) AS pos FROM strands) WHERE "


@query(f"WITH {STRANDS} {_VARIANT_SQL} {' AND '.join(f'{chr(39)}{g}{chr(39)} || s[pos + {m}:pos + {m}] IN {_PAIRED}' for m, g in zip(range(1, 5), 'AUGG', strict=True))}")
def wobble_sites(spark, d):
    """All overlapping places of all strings that pair with GGUA when wobbles count."""
    variants = _strands(spark, d).select("key", "s", F.explode(seq.complements_with_wobbles(F.lit("GGUA"))).alias("v"))
    return _long(variants.select("key", F.explode(seq.occurrences("s", F.col("v"))).alias("pos")), "pos")


@query(f"WITH {STRANDS} SELECT key, pos, CASE WHEN pos < 8 THEN '5UTR' WHEN pos <= 20 THEN 'CDS' ELSE '3UTR' END AS region, CASE WHEN pos < 8 THEN 4 WHEN pos <= 20 THEN 2 ELSE 1 END AS code FROM (SELECT key, s, unnest(range(0, length(s) - 1)) AS pos FROM strands) WHERE s[pos + 1:pos + 2] = 'GA'")
def kmers_in_region(spark, d):
    found = _strands(spark, d).select("key", F.explode(seq.occurrences("s", "GA")).alias("pos"))
    label = seq.region_label(F.col("pos"), F.col("pos"), F.lit(8), F.lit(20))
    return found.select("key", F.col("pos").cast("long").alias("pos"), label.alias("region"), seq.region_code(label).alias("code"))


@query("SELECT o_orderkey AS k, (o_orderkey % 8 & 1) > 0 AND o_orderkey % 3 = 0 OR (o_orderkey % 8 & 2) > 0 AND o_orderkey % 3 = 1 OR (o_orderkey % 8 & 4) > 0 AND o_orderkey % 3 = 2 AS inside FROM orders")
def region_mask(spark, d):
    label = F.element_at(F.array(F.lit("3UTR"), F.lit("CDS"), F.lit("5UTR")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), seq.in_region(label, (F.col("o_orderkey") % 8).cast("int")).alias("inside"))


@query("SELECT a || b || c || d AS kmer FROM (VALUES ('A'), ('C'), ('G'), ('U')) p(a), (VALUES ('A'), ('C'), ('G'), ('U')) q(b), (VALUES ('A'), ('C'), ('G'), ('U')) r(c), (VALUES ('A'), ('C'), ('G'), ('U')) t(d) WHERE a || b || c || d NOT LIKE '%AA%' AND a || b || c || d NOT LIKE '%GU%'")
def generated_kmers(spark, d):
    from bindlattice.operators import design

    return design.all_kmers(spark, 4, ["AA", "GU"])


# Stems of part keys with unpaired letters on either side between an outer and an inner run of pairs.
_STEM = "repeat('(', 2 + key % 3) || repeat('.', key % 4) || '((' || repeat('.', 3 + key % 5) || '))' || repeat('.', (key // 4) % 3) || repeat(')', 2 + key % 3)"


@query("""WITH k AS (SELECT p_partkey AS key FROM part)
SELECT key AS id, CAST(i AS BIGINT) AS i, CAST(CASE WHEN i = 1 + key % 3 THEN key % 4 ELSE 0 END AS BIGINT) AS "left", CAST(CASE WHEN i = 1 + key % 3 THEN (key // 4) % 3 ELSE 0 END AS BIGINT) AS "right"
FROM k, range(0, 8) r(i) WHERE i <= 1 + key % 3 OR i = 2 + key % 3 + key % 4""")
def bulged_interiors(spark, d):
    """Pairs that close another one, in stems with bulges and interior loops of every size up to 3 by 2."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    stems = rows.select(F.col("key").alias("id"), F.expr(_STEM.replace("//", "DIV").replace("key % 3)", "CAST(key % 3 AS INT))")).alias("structure"))
    return structure.interiors(stems).select("id", *(F.col(c).cast("long").alias(c) for c in ("i", "left", "right")))
