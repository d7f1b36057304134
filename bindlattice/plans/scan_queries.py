"""Queries of the whole site scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindlattice.functions import sequence as seq
from bindlattice.operators import design_search, locate, scan, seed_words, site_scan
from bindlattice.operators import sites as site
from bindlattice.operators.fold import STACK
from bindlattice.plans.site_queries import STRANDS, _strands
from bindlattice.plans.structure_queries import LONGEST, _longest
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


# Guides: what pairs with the longest strand of each brand; transcripts: strands, there and back.
def _guides(spark, d) -> DataFrame:
    return _longest(spark, d).select(F.col("p_brand").alias("guide_id"), F.substring(seq.reverse_complement("s"), 1, 22).alias("sequence"))


def _transcripts(spark, d) -> DataFrame:
    return _strands(spark, d).select(F.col("key").alias("transcript_id"), F.concat("s", F.reverse("s"), "s").alias("sequence"))


_BASES = "(SELECT unnest(['A', 'C', 'G', 'U']) AS x)"
_PAIRED = "('AU', 'UA', 'GC', 'CG', 'GU', 'UG')"
_KIND = "CASE WHEN {0} IN ('AU', 'UA', 'GC', 'CG') THEN 'W' WHEN {0} IN ('GU', 'UG') THEN 'G' ELSE 'x' END"
_STACKS = ", ".join(f"'{a}{b}': {round(100 * v)}" for a, row in STACK.items() for b, v in row.items())
_KD = ", ".join(f"'{k}': {v}" for k, v in site.CLASS_KD.items())
_SAME = "z.guide_id = h.guide_id AND z.transcript_id = h.transcript_id"
_AT = "(32 - {0} + CASE WHEN lst = 4 AND {0} > 6 OR lst = 5 AND {0} > 5 THEN 1 WHEN lst = 6 AND {0} >= 5 THEN -1 ELSE 0 END)"
# Pairs of a part without those that have no neighbour in the guide, and the energy of a list of pairs.
_PAIRS = "list_transform(list_filter(range({0}, {1} + 1), lambda i: k{2}[i - {0} + 1:i - {0} + 1] IN ('W', 'G') AND (k{2}[i - {0}:i - {0}] IN ('W', 'G') OR k{2}[i - {0} + 2:i - {0} + 2] IN ('W', 'G'))), lambda i: {{'g': i, 't': {3}, 'p': gs[i:i] || win[{3}:{3}]}})"
_ENERGY = f"CAST(coalesce(list_sum(list_transform(range(2, CAST(len({{0}}) AS BIGINT) + 1), lambda n: CASE WHEN {{0}}[n].g - {{0}}[n - 1].g = 1 AND {{0}}[n - 1].t - {{0}}[n].t = 1 THEN MAP {{{{{_STACKS}}}}}[{{0}}[n - 1].p || {{0}}[n].p] ELSE 170 + 20 * (({{0}}[n].g - {{0}}[n - 1].g - 1) + ({{0}}[n - 1].t - {{0}}[n].t - 1)) END)), 0) AS BIGINT)"

# Over guides g(guide_id, gs) and transcripts t(transcript_id, ts).
_SCAN = f"""f AS (SELECT guide_id, reverse(translate(gs[2:8], 'ACGU', 'UGCA')) AS rc, gs FROM g),
four AS (SELECT DISTINCT ts[pos + 1:pos + 4] AS word FROM (SELECT ts, unnest(range(0, length(ts) - 3)) AS pos FROM t)),
wanted AS (
  SELECT guide_id, k AS lst, reverse(translate(gs[2 + k:5 + k], 'ACGU', 'UGCA')) AS word FROM g, range(3) r(k)
  UNION SELECT guide_id, 3, rc[1:i] || x || rc[i + 2:7] FROM f, {_BASES}, (SELECT unnest([2, 3]) AS i) WHERE x <> rc[i + 1:i + 1]
  UNION SELECT guide_id, 4, rc[1:2] || rc[4:7] FROM f
  UNION SELECT guide_id, 5, rc[1:3] || rc[5:7] FROM f WHERE rc[1:2] || rc[4:7] <> rc[1:3] || rc[5:7]
  UNION SELECT guide_id, 6, rc[1:4] || x || rc[5:7] FROM f, {_BASES}
  UNION SELECT guide_id, 7 + k, word FROM g, range(2) r(k), four WHERE {" AND ".join(f"gs[{17 - m} + k:{17 - m} + k] || word[{m}:{m}] IN {_PAIRED}" for m in range(1, 5))}
), w AS (SELECT transcript_id, pos, ts[pos + 1:pos + n] AS word FROM (SELECT t.*, n, unnest(range(0, length(ts) - n + 1)) AS pos FROM t, (SELECT unnest([4, 6, 7, 8]) AS n))),
h AS (SELECT guide_id, transcript_id, pos, lst FROM w JOIN wanted USING (word)),
b1 AS (SELECT * FROM h WHERE lst = 0 UNION ALL SELECT * FROM h WHERE lst = 1 AND NOT EXISTS (SELECT 1 FROM h z WHERE z.lst = 0 AND {_SAME} AND z.pos = h.pos + 1)),
seeds AS (SELECT *, pos AS site, pos + [3, 4, 5, 6, 5, 5, 7][lst + 1] AS g2, CASE lst WHEN 3 THEN 0 WHEN 4 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 4 ELSE 6 END AS rank FROM (
  SELECT * FROM b1 UNION ALL SELECT * FROM h WHERE lst = 2 AND NOT EXISTS (SELECT 1 FROM b1 z WHERE {_SAME} AND z.pos IN (h.pos + 1, h.pos + 2)) UNION ALL SELECT * FROM h WHERE lst BETWEEN 3 AND 6)),
supps AS (SELECT guide_id, transcript_id, lst - 7 AS po, pos + 3 + lst - 7 AS g13 FROM h WHERE lst >= 7),
cand AS (
  SELECT guide_id, transcript_id, site, lst, g2, g2 - g13 - 7 AS bridge, po, rank FROM seeds JOIN supps USING (guide_id, transcript_id) WHERE g2 - g13 - 7 BETWEEN 1 AND 15
  UNION ALL SELECT guide_id, transcript_id, site, lst, g2, [4, 4, 4, 7, 6, 6, 8][lst + 1], -1, CASE rank WHEN 6 THEN 7 ELSE rank + 1 END FROM seeds
  UNION ALL SELECT guide_id, transcript_id, g13 + 8, 0, g13 + 11, 4, po, 8 FROM supps
), placed AS (SELECT cand.*, gs, ts[g2 - 28:g2 + 2] AS win FROM cand JOIN t USING (transcript_id) JOIN g USING (guide_id) WHERE g2 - 29 >= 0 AND g2 + 1 < length(ts)),
kinded AS (SELECT *, array_to_string(list_transform(range(2, 9), lambda i: CASE WHEN lst = 4 AND i = 6 OR lst = 5 AND i = 5 THEN '-' ELSE {_KIND.format("gs[i:i] || win[" + _AT.format("i") + ":" + _AT.format("i") + "]")} END), '') AS k1,
  CASE WHEN po < 0 THEN 'xxxxx' ELSE array_to_string(list_transform(range(13, 18), lambda i: {_KIND.format("gs[i:i] || win[36 - bridge - i:36 - bridge - i]")}), '') END AS k2 FROM placed),
paired AS (SELECT *, {_PAIRS.format(2, 8, 1, _AT.format("i"))} AS p1, {_PAIRS.format(13, 17, 2, "(36 - bridge - i)")} AS p2 FROM kinded),
weighed AS (SELECT *, p1 || p2 AS p, {_ENERGY.format("(p1 || p2)")} AS energy, {_ENERGY.format("p1")} AS e1, {_ENERGY.format("p2")} AS e2 FROM paired),
spanned AS (SELECT *, win[31:31] = 'A' AS a1, list_filter(range(2, 9), lambda i: k1[i - 1:i - 1] IN ('W', 'G')) AS bound FROM weighed WHERE energy < 0),
ended AS (SELECT *, bound[1] AS lo, CASE WHEN lst <> 6 AND k1 LIKE 'WWWW%' THEN greatest(5, bound[-1]) WHEN lst <> 6 AND k1 LIKE '_WWWW%' THEN greatest(6, bound[-1]) WHEN lst <> 6 AND k1 LIKE '__WWWW%' THEN greatest(7, bound[-1])
  WHEN length(regexp_replace(k1, '[^W]', '', 'g')) >= 6 THEN 8 END AS hi FROM spanned),
classed AS (SELECT *, CASE WHEN hi IS NULL THEN 'seedless' WHEN lo = 2 OR hi - lo = 6 THEN CASE WHEN a1 THEN 'A1-' ELSE '' END || hi - lo + 1 || 'mer' WHEN lo = 3 OR hi - lo = 5 THEN 'offset-' || hi - lo + 1 || 'mer' ELSE 'distant-' || hi - lo + 1 || 'mer' END AS seed_class,
  CASE WHEN translate(k2, 'G', 'W') = 'WWWWW' THEN '5mer' WHEN translate(k2, 'G', 'W') LIKE 'WWWW%' THEN '4mer' WHEN translate(k2, 'G', 'W') LIKE '%WWWW' THEN 'offset-4mer' ELSE 'suppless' END AS supp_class FROM ended),
best AS (SELECT *, row_number() OVER (PARTITION BY guide_id, transcript_id, site ORDER BY energy, rank, lst, po, bridge DESC) AS rn FROM classed
  WHERE (seed_class <> 'seedless' OR supp_class <> 'suppless') AND (rank < 8 OR k1 NOT LIKE '%WWWW%'))"""
WHOLE = f"""{LONGEST}, g AS (SELECT p_brand AS guide_id, reverse(translate(s, 'ACGU', 'UGCA'))[1:22] AS gs FROM longest),
t AS (SELECT key AS transcript_id, s || reverse(s) || s AS ts FROM strands),
{_SCAN}"""
_PENALTY = f"coalesce(list_sum(list_transform(range(lo, hi + 1), lambda i: CASE k1[i - 1:i - 1] WHEN 'G' THEN {list(site.WOBBLE)}[i - 1] WHEN 'x' THEN {list(site.MISMATCH)}[i - 1] WHEN '-' THEN {list(site.DELETION)}[i - 1] ELSE 0.0 END + CASE WHEN lst = 6 AND i = 4 AND i < hi THEN {site.BULGE[2]} ELSE 0.0 END)), 0.0)"
_STRENGTH = "(0.25 * greatest(-e1, 0) / 100.0 + 0.75 * greatest(-e2, 0) / 100.0)"


@query(f"""WITH {WHOLE} SELECT guide_id, transcript_id, site, {list(site_scan.KINDS)}[rank + 1] AS kind, bridge, win AS "window", k1 AS kinds, seed_class, supp_class, energy / 100.0 AS energy,
  round(CASE WHEN seed_class = 'seedless' THEN log2(1e9) - CASE WHEN {_STRENGTH} > 0 THEN log2({_STRENGTH}) ELSE 0 END ELSE log2(MAP {{{_KD}}}[seed_class]) + {_PENALTY} END, 6) AS log2_kd
FROM best WHERE rn = 1""")
def whole_site_scan(spark, d):
    found = site_scan.scan_sites(_guides(spark, d), _transcripts(spark, d))
    whole = [F.col(c).cast("long").alias(c) for c in ("site", "bridge")]
    return found.select("guide_id", "transcript_id", whole[0], "kind", whole[1], "window", "kinds", "seed_class", "supp_class", "energy", F.round(F.log2("kd"), 6).alias("log2_kd"))


_SPAN = "CASE WHEN found.g2 - 29 < 20 THEN ['5UTR'] ELSE [] END || CASE WHEN found.g2 - 29 <= 60 + found.transcript_id % 30 AND found.g2 + 1 >= 20 THEN ['CDS'] ELSE [] END || CASE WHEN found.g2 + 1 > 60 + found.transcript_id % 30 THEN ['3UTR'] ELSE [] END"


@query(f"""WITH {WHOLE}, found AS (SELECT *, CASE WHEN seed_class = 'seedless' THEN 1e9 / CASE WHEN {_STRENGTH} > 0 THEN {_STRENGTH} ELSE 1 END ELSE MAP {{{_KD}}}[seed_class] * pow(2, {_PENALTY}) END AS kd FROM best WHERE rn = 1),
c AS (SELECT p_partkey AS transcript_id, 40 * i + p_partkey % 7 AS "start", 40 * i + p_partkey % 7 + 20 AS "end", (p_partkey + i) % 5 / 4.0 AS value FROM part, range(4) r(i)),
v AS (SELECT found.guide_id, found.transcript_id, found.site, CAST(round(31 * coalesce(sum((least(c."end", g2 + 2) - greatest(c."start", g2 - 29)) * value) / sum(least(c."end", g2 + 2) - greatest(c."start", g2 - 29)), -1)) AS INTEGER) AS conservation
  FROM found LEFT JOIN c ON c.transcript_id = found.transcript_id AND c."start" < g2 + 2 AND c."end" > g2 - 29 GROUP BY ALL)
SELECT found.guide_id, found.transcript_id, found.site, seed_class, array_to_string({_SPAN}, ' and ') AS region, conservation, round(kd, 3) AS kd
FROM found JOIN v USING (guide_id, transcript_id, site)
WHERE kd <= 20000 AND seed_class <> 'seedless' AND regexp_extract(seed_class, '(\\dmer)', 1) >= '5mer' AND (list_contains({_SPAN}, 'CDS') OR list_contains({_SPAN}, '3UTR'))
  AND 1 - list_min([CASE WHEN (found.transcript_id + g2 - 3 + i) % 6 = 0 THEN 0.0 ELSE 0.5 END FOR i IN range(4)]) + 0.005 >= 0.15 AND (4 <= conservation OR conservation = -1)""")
def filtered_site_scan(spark, d):
    """The scan under all filters: region, accessibility and conservation come from tables made of parts."""
    from bindlattice import settings

    transcripts = _transcripts(spark, d)
    part = F.col("transcript_id")
    coding = transcripts.select("transcript_id", F.lit(20).alias("cds_start"), (60 + part % 30).alias("cds_end"))
    places = F.transform(F.sequence(F.lit(0), F.length("sequence") - 1), lambda i: F.when((part + i) % 6 == 0, 0.0).otherwise(0.5))
    unpaired = transcripts.select("transcript_id", places.alias("p"))
    steps = transcripts.select("transcript_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    conserved = steps.select("transcript_id", (40 * F.col("i") + part % 7).alias("start"), (40 * F.col("i") + part % 7 + 20).alias("end"), ((part + F.col("i")) % 5 / 4).alias("value"))
    filters = settings.Filters(min_seed="5mer", max_kd=20_000.0, utr5=False, conserved=4)
    found = settings.scan(_guides(spark, d), transcripts, filters, coding, unpaired, conserved)
    return found.select("guide_id", "transcript_id", F.col("site").cast("long").alias("site"), "seed_class", "region", "conservation", F.round("kd", 3).alias("kd"))


# Every alignment of a seed on nine letters, held against every pair of a guide and a target.
_CORE = " OR ".join("(" + " AND ".join(f"ok[{k + i}]" for i in range(4)) + ")" for k in range(1, 4))
NINE = f"""{LONGEST}, g AS (SELECT p_brand AS guide_id, reverse(translate(s, 'ACGU', 'UGCA'))[2:8] AS seed FROM longest),
t AS (SELECT key AS transcript_id, s AS ts FROM strands),
places AS (SELECT transcript_id, pos, reverse(ts[pos + 1:pos + 9]) AS word FROM (SELECT *, unnest(range(0, length(ts) - 8)) AS pos FROM t)),
ways(way, bulged) AS (VALUES {", ".join(f"('{at}', {bulged})" for at, bulged in seed_words.alignments())}),
held AS (SELECT seed, word, bulged,
  list_transform(range(1, 8), lambda i: way[i:i] <> '-' AND seed[i:i] || word[coalesce(try_cast(way[i:i] AS INTEGER), 0) + 1:coalesce(try_cast(way[i:i] AS INTEGER), 0) + 1] IN ('AU', 'UA', 'GC', 'CG')) AS ok
  FROM (SELECT DISTINCT seed FROM g), (SELECT DISTINCT word FROM places), ways),
bound AS (SELECT DISTINCT seed, word FROM held WHERE {_CORE} OR (len(list_filter(ok, lambda b: b)) >= 6 AND 7 - len(list_filter(ok, lambda b: b)) + CASE WHEN bulged THEN 1 ELSE 0 END = 1))"""


@query(f"WITH {NINE} SELECT guide_id, transcript_id, count(*) AS n, min(pos) AS first FROM places JOIN bound USING (word) JOIN g USING (seed) GROUP BY guide_id, transcript_id")
def bulged_seed_sites(spark, d):
    """Places that the seeds of the guides bind with one bulge at most, by guide and transcript."""
    transcripts = _strands(spark, d).select(F.col("key").alias("transcript_id"), F.col("s").alias("sequence"))
    found = seed_words.seed_sites(_guides(spark, d), transcripts)
    return found.groupBy("guide_id", "transcript_id").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first"))


_REQUIRED, _EXCLUDED = ("Brand#1", "Brand#3", "Brand#5"), ("Brand#7", "Brand#9")
_REQUIRED_KD, _EXCLUDED_KD = 20_000.0, 1_500.0
_LETTERS = "(VALUES ('A'), ('C'), ('G'), ('U'))"
DESIGN = f"""{LONGEST}, t AS (SELECT p_brand AS transcript_id, s || reverse(s) || s AS ts FROM longest WHERE p_brand IN {_REQUIRED + _EXCLUDED}),
w3 AS (SELECT transcript_id, pos, ts[pos + 1:pos + 4] AS w FROM (SELECT *, unnest(range(0, length(ts) - 3)) AS pos FROM t)),
w5 AS (SELECT transcript_id, pos, ts[pos + 1:pos + 3] AS w FROM (SELECT *, unnest(range(0, length(ts) - 2)) AS pos FROM t)),
grips AS (SELECT x.w AS a, y.w AS b FROM w3 x JOIN w5 y ON x.transcript_id = y.transcript_id AND x.pos - y.pos - 7 BETWEEN 3 AND 15 WHERE x.transcript_id IN {_REQUIRED} GROUP BY x.w, y.w HAVING count(DISTINCT x.transcript_id) = (SELECT count(*) FROM t WHERE transcript_id IN {_REQUIRED})),
made AS (SELECT a || '/' || b AS grip, 'C' || reverse(translate(a, 'ACGU', 'UGCA')) || p.l || q.l || r.l || 'UUAA' || reverse(translate(b, 'ACGU', 'UGCA')) || u.l || v.l || 'AAUU' AS gs
  FROM grips, {_LETTERS} p(l), {_LETTERS} q(l), {_LETTERS} r(l), {_LETTERS} u(l), {_LETTERS} v(l)),
g AS (SELECT grip || ' ' || gs AS guide_id, grip, gs FROM made WHERE gs NOT LIKE '%GGG%' AND gs NOT LIKE '%CCC%' AND length(regexp_replace(gs, '[^GC]', '', 'g'))::DOUBLE / length(gs) BETWEEN 0.3 AND 0.7),
{_SCAN}"""


@query(f"""WITH {DESIGN}, valued AS (SELECT guide_id, transcript_id, rank, seed_class, supp_class, CASE WHEN seed_class = 'seedless' THEN 1e9 / CASE WHEN {_STRENGTH} > 0 THEN {_STRENGTH} ELSE 1 END ELSE MAP {{{_KD}}}[seed_class] * pow(2, {_PENALTY}) END AS kd FROM best WHERE rn = 1),
covers AS (SELECT guide_id FROM valued WHERE kd <= {_REQUIRED_KD} AND transcript_id IN {_REQUIRED} GROUP BY guide_id HAVING count(DISTINCT transcript_id) = (SELECT count(*) FROM t WHERE transcript_id IN {_REQUIRED})),
barred AS (SELECT DISTINCT guide_id FROM valued WHERE kd <= {_EXCLUDED_KD} AND transcript_id IN {_EXCLUDED} AND rank IN (0, 2, 4, 6) AND seed_class <> 'seedless' AND supp_class <> 'suppless')
SELECT grip, count(*) AS n, min(gs) AS first FROM g WHERE guide_id IN (SELECT guide_id FROM covers) AND guide_id NOT IN (SELECT guide_id FROM barred) GROUP BY grip""")
def design_search_sites(spark, d):
    """How many strings made for each grip bind the longest strands of three brands and of none of two others."""
    strands = _longest(spark, d).select(F.col("p_brand").alias("transcript_id"), F.concat("s", F.reverse("s"), "s").alias("sequence"))
    required, excluded = (strands.where(F.col("transcript_id").isin(*names)) for names in (_REQUIRED, _EXCLUDED))
    found = design_search.search(required, excluded, _REQUIRED_KD, _EXCLUDED_KD, ["GGG", "CCC"])
    return found.groupBy("grip").agg(F.count("*").alias("n"), F.min("sequence").alias("first"))


@query(f"""WITH {STRANDS}, named AS (SELECT p_brand, key, s FROM strands JOIN part ON p_partkey = key),
genome AS (SELECT p_brand AS chromosome, string_agg(s, '' ORDER BY key) AS letters FROM named GROUP BY p_brand)
SELECT key AS piece, chromosome, CAST(instr(letters, s[5:24]) - 1 AS BIGINT) AS pos, CAST(instr(letters, s[5:24]) - 1 + 1000 * length(chromosome) AS BIGINT) AS genome_pos
FROM named, genome WHERE instr(letters, s[5:24]) > 0""")
def located_pieces(spark, d):
    """The first place of twenty letters of every strand in each chromosome; a chromosome is a brand's strands one after the other."""
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("chromosome"))
    named = _strands(spark, d).join(brands, "key")
    number = F.row_number().over(Window.partitionBy("chromosome").orderBy("key")) - 1
    chunks = named.select("chromosome", number.cast("long").alias("number"), F.col("s").alias("letters"))
    pieces = named.select(F.col("key").alias("piece"), F.substring("s", 5, 20).alias("letters"))
    genes = brands.select("chromosome").distinct().withColumn("offset", F.length("chromosome").cast("long") * 1000)
    return locate.shifted(locate.first_places(pieces, chunks), genes).select("piece", "chromosome", "pos", "genome_pos")


@query(f"""WITH {LONGEST}, g AS (SELECT p_brand AS guide_id, reverse(translate(s, 'ACGU', 'UGCA'))[1:22] AS gs FROM longest),
t AS (SELECT key AS transcript_id, s || reverse(s) || s AS ts FROM strands),
w AS (SELECT transcript_id, length(ts) AS size, pos, ts[pos + 1:pos + 4] AS word FROM (SELECT *, unnest(range(0, length(ts) - 3)) AS pos FROM t)),
a AS (SELECT guide_id, transcript_id, pos AS seed FROM w JOIN g ON word = reverse(translate(gs[2:5], 'ACGU', 'UGCA')) WHERE pos >= 26 AND pos + 4 < size),
b AS (SELECT guide_id, transcript_id, pos AS supp FROM w JOIN g ON word = reverse(translate(gs[13:16], 'ACGU', 'UGCA'))),
p AS (SELECT a.guide_id, a.transcript_id, seed, min(supp) AS supp FROM a LEFT JOIN b ON a.guide_id = b.guide_id AND a.transcript_id = b.transcript_id AND seed - 4 - (supp + 4) > 2 AND seed - 4 - (supp + 4) <= 15 GROUP BY ALL)
SELECT guide_id, transcript_id, seed, supp, coalesce(seed - 4 - (supp + 4), 3) AS bridge FROM p""")
def older_site_scan(spark, d):
    found = scan.older_scan(_guides(spark, d), _transcripts(spark, d))
    return found.select("guide_id", "transcript_id", *(F.col(c).cast("long").alias(c) for c in ("seed", "supp", "bridge")))


_LINE = "o_orderpriority || ' [' || o_custkey || '..' || o_orderkey || '] dG: -' || (o_orderkey % 40) || '.' || (10 + o_custkey % 80)"


@query(f"""WITH l AS (SELECT o_orderkey AS k, {_LINE} AS line FROM orders),
n AS (SELECT k, list_transform(regexp_extract_all(line, '\\d+'), lambda x: CAST(x AS BIGINT)) AS whole, list_transform(regexp_extract_all(line, '-?\\d+(?:\\.\\d+)?'), lambda x: CAST(x AS DOUBLE)) AS parts FROM l)
SELECT k, CAST(len(whole) AS BIGINT) AS n, whole[2] AS "start", CAST(list_sum(whole) AS BIGINT) AS total, round(parts[-1], 6) AS energy FROM n""")
def numbers_of_lines(spark, d):
    """Whole numbers and decimals of lines of text, by their order."""
    lines = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr(f"concat({_LINE.replace(' || ', ', ')})").alias("line"))
    found = lines.select("k", seq.integers_in("line").alias("whole"), seq.decimals_in("line").alias("parts"))
    total = F.aggregate("whole", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("k", F.size("whole").cast("long").alias("n"), F.get("whole", F.lit(1)).alias("start"), total.alias("total"), F.round(F.element_at("parts", -1), 6).alias("energy"))


@query(f"""WITH {WHOLE}, valued AS (SELECT guide_id, transcript_id, site, energy, CASE WHEN seed_class = 'seedless' THEN 1e9 / CASE WHEN {_STRENGTH} > 0 THEN {_STRENGTH} ELSE 1 END ELSE MAP {{{_KD}}}[seed_class] * pow(2, {_PENALTY}) END AS kd FROM best WHERE rn = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY guide_id ORDER BY round(kd, 4), energy, transcript_id, site) AS place FROM valued)
SELECT guide_id, CAST(place AS INTEGER) AS place, transcript_id, site, round(kd, 3) AS kd, energy / 100.0 AS energy FROM ranked WHERE place <= 10""")
def strongest_sites(spark, d):
    """The ten sites of each guide of least kd, by energy where that is equal."""
    ranked = site_scan.strongest(_guides(spark, d), _transcripts(spark, d), 10)
    return ranked.select("guide_id", F.col("place").cast("int").alias("place"), "transcript_id", F.col("site").cast("long").alias("site"), F.round("kd", 3).alias("kd"), "energy")
