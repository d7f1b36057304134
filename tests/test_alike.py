"""Work that is done once for equal strings, held against plain versions with repeated keys and strings."""

from collections import Counter

from bindlattice import settings
from bindlattice.operators import design, joins, locate, site_scan
from bindlattice.plans import extended_queries
from bindlattice.plans.catalogue import QUERIES

ROWS = [(1, "ACGUACGUAC"), (2, "ACGUACGUAC"), (3, "GGGUUUACGA"), (3, "ACGU"), (4, "AC"), (5, None), (6, "ACGU" * 300), (None, "ACGUACGUAC")]
PARTS = "p_partkey long, p_name string, p_type string, p_brand string, p_size int"


def _parts(spark, folder):
    rows = [(i, ("red ring", "old nut", "red bolt")[i % 3], ("SMALL", "LARGE")[i % 2], f"Brand#{i % 4}", i % 5) for i in range(60)]
    spark.createDataFrame(rows, PARTS).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def _words(rows, k):
    return [(key, at, s[at : at + k]) for key, s in rows if key is not None and s for at in range(len(s) - k + 1)]


def test_keys_of_equal_strings_share_a_text(spark):
    members, texts = joins.alike(spark.createDataFrame(ROWS, "key long, s string"), "key", "s")
    assert {(r["key"], r["text"]) for r in members.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (6, 6)}
    assert Counter((r["text"], r["s"], r["n"]) for r in texts.collect()) == Counter([(1, "ACGUACGUAC", 2), (3, "GGGUUUACGA", 1), (3, "ACGU", 1), (4, "AC", 1), (6, "ACGU" * 300, 1)])


def test_word_pairs_of_rows_chunks_and_repeated_keys(spark):
    found = joins.word_pairs(spark.createDataFrame(ROWS, "key long, s string"), "key", "s", 3, 2, 1, 4)
    plain = Counter((a, i, x, j, y) for a, i, x in _words(ROWS, 3) for b, j, y in _words(ROWS, 2) if a == b and 1 <= i - j <= 4)
    assert Counter(map(tuple, found.collect())) == plain


def test_grips_lie_within_reach(spark):
    rows = spark.createDataFrame([(i, "ACGUACGUACGUACGUACGUACG") for i in range(50)], "transcript_id long, sequence string")
    found = design.grips(rows, 4, 4, 10)
    assert found.where("grip is null or bridge not between 3 and 10").isEmpty() and found.count() == 50 * sum(20 - gap for gap in range(11, 19))


def test_grip_queries_count_every_part_of_equal_strings(spark, tmp_path):
    folder = _parts(spark, tmp_path)
    strings = {r["key"]: r["s"] for r in extended_queries._strands(spark, folder).collect()}
    n, strands = Counter(), {}
    for key, s in strings.items():
        for j in range(len(s) - 3):
            for i in range(j + 7, min(j + 12, len(s) - 4) + 1):
                grip = s[i : i + 4] + "/" + s[j : j + 4]
                n[grip] += 1
                strands.setdefault(grip, set()).add(key)
    assert {tuple(r) for r in QUERIES["grip_map"](spark, folder).collect()} == {(g, n[g], len(k)) for g, k in strands.items() if len(k) >= 3}


def test_antisense_strings_are_made_once_for_equal_letters(spark, tmp_path, monkeypatch):
    folder, made = _parts(spark, tmp_path), []
    whole = design.antisense_candidates
    monkeypatch.setattr(design, "antisense_candidates", lambda words, *rest: made.append(words.count()) or whole(words, *rest))
    found = {r["key"]: (r["n"], r["first"]) for r in extended_queries.antisense_strings(spark, folder).collect()}
    strings = {r["key"]: r["s"] for r in extended_queries._strands(spark, folder).collect()}
    assert made == [len({s[:7] for s in strings.values()})] and made[0] < len(strings)
    assert set(found) <= set(strings) and all(found[a] == found[b] for a in found for b in found if strings[a][:7] == strings[b][:7])


def test_equal_pieces_are_looked_up_once(spark, monkeypatch):
    chunks = spark.createDataFrame([("x", 0, "ACGUACGU"), ("x", 1, "GGACGU"), ("y", 0, "UUACGG")], "chromosome string, number long, letters string")
    pieces = spark.createDataFrame([(1, "ACGU"), (2, "ACGU"), (3, "ACG"), (3, "GG"), (4, None), (5, "CCC")], "piece long, letters string")
    asked, places = [], locate.places
    monkeypatch.setattr(locate, "places", lambda p, c: asked.append(p.count()) or places(p, c))
    assert {tuple(r) for r in locate.first_places(pieces, chunks).collect()} == {(1, "x", 0), (2, "x", 0), (3, "x", 0), (3, "y", 2)}
    assert asked == [5]


def test_transcripts_of_equal_letters_are_scanned_once(spark, monkeypatch):
    letters = "GGACCAUGCAUUUACGAACUACCUCAUGCUAACUACCUCAGGAUUACAUCGAUCGGA" * 2
    guides = spark.createDataFrame([("g", "UGAGGUAGUAGGUUGUAUAGUU"), ("h", "UAGCAGCACGUAAAUAUUGGCG")], "guide_id string, sequence string")
    rows = [(i, letters[i % 3 :]) for i in range(9)] + [(9, letters), (9, letters[5:])]
    transcripts = spark.createDataFrame(rows, "transcript_id long, sequence string")
    scanned, whole = [], site_scan.word_hits
    monkeypatch.setattr(site_scan, "word_hits", lambda g, t: scanned.append(t.count()) or whole(g, t))
    found = site_scan.scan_sites(guides, transcripts).collect()
    assert scanned == [5] and len({r["transcript_id"] for r in found}) == 10
    alone = site_scan._scanned(guides, transcripts).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, alone))
    order = lambda r: (round(r["kd"], 4), r["energy"], r["transcript_id"], r["site"])
    plain = [(g, i + 1, r["transcript_id"], r["site"]) for g in "gh" for i, r in enumerate(sorted((r for r in alone if r["guide_id"] == g), key=order)[:7])]
    assert sorted(tuple(r) for r in site_scan.strongest(guides, transcripts, 7).select("guide_id", "place", "transcript_id", "site").collect()) == plain


def test_tables_of_transcripts_are_not_broadcast(spark):
    found = spark.createDataFrame([(1, 40, 4, "7mer", "4mer")], "transcript_id long, g2 int, bridge int, seed_class string, supp_class string")
    coding = spark.createDataFrame([(1, 5, 90)], "transcript_id long, cds_start int, cds_end int")
    unpaired = spark.createDataFrame([(1, [0.5] * 80)], "transcript_id long, p array<double>")
    conserved = spark.createDataFrame([(1, 0, 80, 0.5)], "transcript_id long, start long, end long, value double")
    done = settings.annotated(found, coding, unpaired, conserved)
    plan = done._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 3 and done.first()["conservation"] == 16
    sides = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert len(sides) <= 2  # the windows that were asked, back to their sites
