"""Small cases with results worked out by hand."""

import numpy as np
from pyspark.sql import functions as F

from bindlattice.functions import sequence as seq
from bindlattice.operators import factor, graph, joins, matrix, signal
from bindlattice.operators import sites as site


def test_null_seed_types_stay_and_absent_pairs_are_zero(spark):
    rows = spark.createDataFrame([(1, "a", -2.0, None), (1, "a", -4.0, "7mer"), (1, "b", -9.0, "seedless"), (2, "b", -1.0, "6mer")], "row_id long, col_id string, dg double, seed_type string")
    pairs = matrix.pair_mean(rows)
    assert {tuple(r) for r in pairs.collect()} == {(1, "a", 3.0), (2, "b", 1.0)}
    grid = {(r["row_id"], r["col_id"]): r["w"] for r in matrix.dense_grid(pairs).collect()}
    assert grid == {(1, "a"): 3.0, (1, "b"): 0.0, (2, "a"): 0.0, (2, "b"): 1.0}
    cells = {(r["row_id"], r["col_id"]): r["v"] for r in matrix.residual(pairs).collect()}
    assert cells == {(1, "a"): 1.5, (1, "b"): matrix.FLOOR, (2, "a"): matrix.FLOOR, (2, "b"): 0.5}


def test_sequence_functions(spark):
    r = spark.range(1).select(
        seq.reverse_complement(F.lit("AACG")).alias("rc"), seq.occurrences(F.lit("AAAA"), "AA").alias("occ"), seq.base4(F.lit("UCAG")).alias("b"),
        seq.from_base4(F.lit(210), 4).alias("s"), seq.complements_with_wobbles(F.lit("AG")).alias("w"), seq.complements_with_wobbles(F.lit("GG"), 1).alias("w1"),
        seq.complements_with_deletion(F.lit("ACGU")).alias("d"), seq.complements_with_insertion(F.lit("ACGUA")).alias("i"), seq.count_pairs(F.lit("AGU"), F.lit("ACU")).alias("p"),
        seq.fasta_wrapped(F.lit("ABCDE"), 2).alias("f"), seq.gc_fraction(F.lit("")).alias("gc"),
    ).first()
    assert r["rc"] == "CGUU" and r["occ"] == [0, 1, 2] and r["b"] == 3 * 64 + 16 + 2 and r["s"] == "UCAG"
    assert r["w"] == ["CU", "UU"] and r["w1"] == ["CC", "CU", "UC"]
    assert r["d"] == ["ACG", "ACU"] and len(r["i"]) == 4 and r["p"] == 3 and r["f"] == "AB\nCD\nE" and r["gc"] is None


def test_band_and_overlap_joins_match_nested_loops(spark):
    rng = np.random.default_rng(1)
    a, b = [(1, int(x)) for x in rng.integers(0, 200, 60)], [(1, int(x)) for x in rng.integers(0, 200, 60)]
    got = joins.band_join(spark.createDataFrame(a, "k int, p long"), spark.createDataFrame(b, "k int, q long"), ["k"], "p", "q", 1, 15).count()
    assert got == sum(1 <= x - y <= 15 for _, x in a for _, y in b)
    spans = [(1, int(s), int(s + n), 1.0) for s, n in zip(rng.integers(0, 300, 40), rng.integers(0, 90, 40), strict=True)]
    asks = [(1, i, int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 300, 40), rng.integers(0, 90, 40), strict=True))]
    met = joins.overlap_join(spark.createDataFrame(spans, "k int, start long, end long, v double"), spark.createDataFrame(asks, "k int, id int, q_start long, q_end long"), "k", 32).count()
    assert met == sum(s < qe and qs < e and s < e and qs < qe for _, s, e, _ in spans for _, _, qs, qe in asks)


def test_graph_quality_and_components(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    assert {tuple(r) for r in graph.connected_components(nodes, edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)], "id long, label int")
    assert abs(graph.modularity(edges, labels).first()[0] - (2 / 3 - (4 / 6) ** 2 + 1 / 3 - (2 / 6) ** 2)) < 1e-12
    two = spark.createDataFrame([(a, b, 1.0) for c in (0, 10) for a in range(c, c + 5) for b in range(a + 1, c + 5)] + [(0, 10, 0.1)], "src long, dst long, weight double")
    found = graph.communities(spark.createDataFrame([(i,) for c in (0, 10) for i in range(c, c + 5)], "id long"), two)
    assert graph.modularity(two, found).first()[0] > 0.4


def test_factorisation_lowers_its_error(spark):
    rng = np.random.default_rng(0)
    v = rng.random((40, 2)) @ rng.random((2, 6)) + 0.01
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    weights, h, errors = factor.nmf(rows, 6, 2, iterations=12)
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:], strict=False)) and h.shape == (2, 6) and weights.count() == 40
    assert abs(factor.cophenetic(np.kron(np.eye(2), np.ones((3, 3)))) - 1.0) < 1e-9


def test_candidates_and_blocks(spark):
    guide = "UGAGGUAGUAGGUUGUAUAGUU"
    target = "A" * 20 + "AACUAUACAACC" + "CUACUACCUCA" + "A" * 20
    guides, transcripts = spark.createDataFrame([("g", guide)], "guide_id string, sequence string"), spark.createDataFrame([("t", target)], "transcript_id string, sequence string")
    found = site.candidate_sites(guides, transcripts)
    assert found.count() > 0 and found.where("bridge < 1 or bridge > 15 or length(window) <> 31").count() == 0
    kinds = found.select(site.seed_kinds(F.lit(guide), F.col("window")).alias("k"), F.substring("window", -1, 1).alias("last")).select(site.seed_class(F.col("k"), F.col("last")).alias("c"), site.kd(F.lit("6mer"), F.lit("WWGWWWW")).alias("kd"))
    assert {r["c"] for r in kinds.collect()} == {"A1-7mer"} and abs(kinds.first()["kd"] - 343 * 2**7.432) < 1e-6
    text = "5'-AC-3' X [12..42] (CDS and 3UTR) target site: 7mer-m8 in: TarBase\n|| bridge: 6 phastcons: -1.00 dG: -36.90 Kd: 1,490\n3'-GG-5' m\n5'-AC-3' no energy"
    r = site.parse_blocks(spark.createDataFrame([(text,)], "t string"), "t").collect()
    assert len(r) == 1 and (r[0]["region"], r[0]["kd"], r[0]["bridge"], r[0]["validated"], r[0]["dg"]) == (None, 1490.0, 6, True, -36.9)


def test_signals(spark):
    s = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 5, 5, 1, 5])], "key int, pos long, value double")
    assert signal.longest_run(s, 5).first()["longest"] == 2
    assert signal.moving_average(s, 1).orderBy("pos").first()["smooth"] == 3.0
    assert signal.gaussian(s, 1.0).count() == 5


def test_reports_and_names(spark):
    from bindlattice.operators import report

    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "row_id long, label int")
    hits = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "row_id long, col_id string")
    got = {r["label"]: (r["n"], r["rank"], [t["col_id"] for t in r["targets"]]) for r in report.cluster_report(labels, hits).collect()}
    assert got == {0: (2, 1, ["a", "b"]), 1: (1, 2, ["c"])}
    assert report.leaf_order(np.array([[0.0], [9.0], [0.1], [9.2]])) in ([0, 2, 1, 3], [1, 3, 0, 2])
    guide = "UGAGGUAGUAGGUUGUAUAGUU"
    r = spark.range(1).select(seq.sync_name(F.lit(guide)).alias("n")).select("n", seq.from_sync_name("n").alias("g"), seq.hamming(F.lit("ACGU"), F.lit("AGGA")).alias("h"), seq.hamming(F.lit("A"), F.lit("AC")).alias("u")).first()
    assert r["n"].startswith("sync-GAGGUAG-") and r["g"] == guide and r["h"] == 2 and r["u"] is None


def test_factorisation_runs_to_its_tolerance(spark):
    rng = np.random.default_rng(2)
    v = rng.random((40, 3)) @ rng.random((3, 7)) + 0.3 * rng.random((40, 7))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")

    def brute(w, h):
        errors = []
        for i in range(500):
            w = w * (v @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
            h = h * (w.T @ v) / np.maximum(w.T @ w @ h, 1e-12)
            errors.append(np.linalg.norm(v - w @ h))
            if i and i % 10 == 0 and errors[-11] - errors[-1] < 0.03 * errors[0]:
                break
        return w, h, errors

    u, s, vt = np.linalg.svd(v, full_matrices=False)
    w0, h0 = np.zeros((40, 2)), np.zeros((2, 7))
    w0[:, 0], h0[0] = np.sqrt(s[0]) * abs(u[:, 0]), np.sqrt(s[0]) * abs(vt[0])
    x, y = max(((np.maximum(z * u[:, 1], 0), np.maximum(z * vt[1], 0)) for z in (1, -1)), key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
    m = np.sqrt(s[1] * np.linalg.norm(x) * np.linalg.norm(y))
    w0[:, 1], h0[1] = m * x / np.linalg.norm(x), m * y / np.linalg.norm(y)
    w0[w0 < 1e-6], h0[h0 < 1e-6] = 0, 0
    w, h, errors = brute(w0, h0)
    weights, got, found = factor.nmf(rows, 7, 2, iterations=500, tolerance=0.03, start=factor.nndsvd(rows, 7, 2))
    assert len(found) == len(errors) and np.allclose(found, errors, rtol=1e-5) and np.allclose(got, h, rtol=1e-4, atol=1e-6)
    assert np.allclose([r["w"] for r in weights.orderBy("id").collect()], w, rtol=1e-4, atol=1e-6)
    weights, hs, runs = factor.nmf_runs(rows, 7, 2, [0, 1], tolerance=0.03)
    side = np.array([r["w"] for r in weights.orderBy("id").collect()])
    for r in (0, 1):
        w, h, errors = brute(factor._start(np.arange(40), r, 2, v.mean()), factor._start(np.arange(7) + 7_777_777, r, 2, v.mean()).T)
        assert len(runs[r]) == len(errors) and np.allclose(hs[r], h, rtol=1e-5) and np.allclose(side[:, 2 * r : 2 * r + 2], w, rtol=1e-5)


def test_scan_keeps_uncovered_sites(spark):
    from bindlattice.operators import scan

    guide = "UGAGGUAGUAGGUUGUAUAGUU"
    target = "A" * 20 + "AACUAUACAACC" + "CUACUACCUCA" + "A" * 20
    guides, transcripts = spark.createDataFrame([("g", guide)], "guide_id string, sequence string"), spark.createDataFrame([("t", target)], "transcript_id string, sequence string")
    rows = scan.scan(guides, transcripts).collect()
    assert {(r["seed_class"], r["supp_class"]) for r in rows if r["seed_offset"] == 0} == {("A1-7mer", "5mer")}
    # Hits of letters 3-6 and 4-7 lie one and two letters before the plain hit, which covers them.
    assert {r["seed_offset"] for r in rows} == {0} and all(1 <= r["bridge"] <= 15 and len(r["window"]) == 31 for r in rows)


def test_structures(spark):
    from bindlattice.operators import structure

    frame = spark.createDataFrame([(1, "((..((...))..))", "GGAAGGAAACCAACC"), (2, "(((...)))(...)", "GGGAAACCCGAAAC"), (3, "....", "AAAA")], "id long, structure string, sequence string")
    assert {r["id"]: r["shape"] for r in structure.shapes(frame).collect()} == {1: "()", 2: "()()", 3: ""}
    assert {(r["id"], r["first"], r["last"]) for r in structure.loops(frame).where("hairpin").collect()} == {(1, 6, 8), (2, 3, 5), (2, 10, 12)}
    assert {(r["i"], r["left"], r["right"]) for r in structure.interiors(frame.where("id = 1")).collect()} == {(0, 0, 0), (1, 2, 2), (4, 0, 0)}
    assert {r["type"] for r in structure.pair_types(frame).collect()} == {")"}
    r = spark.range(1).select(structure.accessible(F.lit("((....))")).alias("a"), structure.accessible(F.lit("..(")).alias("b"), structure.is_shape(F.lit("(()")).alias("c"), structure.is_shape(F.lit(")(")).alias("d"), structure.is_shape(F.lit("(.)")).alias("e")).first()
    assert tuple(r) == (True, False, False, False, True)


def test_exact_percentiles_and_top_residuals(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.exponential(5, 3000), 2)
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = matrix.order_statistics(frame, "v", [0.0, 0.5, 0.95, 1.0], bins=8, most=20)
    assert np.allclose(got, np.quantile(values, [0.0, 0.5, 0.95, 1.0]))
    pairs = spark.createDataFrame([(1, "a", 9.0), (2, "a", 1.0), (3, "b", 2.0)], "row_id long, col_id string, w double")
    found = {(r["col_id"], r["rn"]): (r["row_id"], r["v"]) for r in matrix.top_residual(pairs, 2).collect()}
    assert found == {("a", 1): (1, 5.666667), ("a", 2): (2, matrix.FLOOR), ("b", 1): (3, 1.333333), ("b", 2): (1, matrix.FLOOR)}


def test_as_of_carries_values_over_bins(spark):
    events = spark.createDataFrame([(1, 5, "x"), (1, 70_000, "y"), (2, 3, None)], "k int, at long, v string")
    probes = spark.createDataFrame([(1, 4, 1), (1, 6, 2), (1, 69_999, 3), (1, 500_000, 4), (2, 9, 5), (3, 9, 6)], "k int, at long, probe long")
    assert {r["probe"]: r["v"] for r in joins.as_of(events, probes, "k", "at", "v", "probe").collect()} == {1: None, 2: "x", 3: "x", 4: "y", 5: None, 6: None}
    spans = spark.createDataFrame([(1, 5, 8, 7.0)], "k int, start long, end long, v double")
    assert {r["probe"]: r["v"] for r in joins.point_in_interval(spans, probes, "k", "at", "v", "probe", -1.0).collect()} == {1: -1.0, 2: 7.0, 3: -1.0, 4: -1.0, 5: -1.0, 6: -1.0}


def test_blocks_read_their_own_lines(spark):
    text = "5'-AC-3' X [12..42] (CDS) target site: 6mer\n|| bridge: 6 dG: -3.5 Kd: 10\n3'-GG-5' m\n5'-AC-3' X [1..2] no second line"
    rows = site.parse_blocks(spark.createDataFrame([(text,), ("5'-A-3' X\n[1..9] (CDS) dG: -1.0",)], "t string"), "t").collect()
    assert [(r["position_start"], r["kd"], r["interaction_string"].count("\n")) for r in rows] == [(12, 10.0, 2)]
