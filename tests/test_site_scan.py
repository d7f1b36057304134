"""The whole site scan against a plain version that goes place by place."""

import numpy as np
import pytest

from bindlattice import settings
from bindlattice.operators import fold, site_scan
from bindlattice.operators import sites as site

WATSON_CRICK, WOBBLES = {"AU", "UA", "GC", "CG"}, {"GU", "UG"}
REACH, LONE = (3, 4, 5, 6, 5, 5, 7), (4, 4, 4, 7, 6, 6, 8)


def kind(a, b):
    return "W" if a + b in WATSON_CRICK else "G" if a + b in WOBBLES else "x"


def reverse_complement(s):
    return s.translate(str.maketrans("ACGU", "UGCA"))[::-1]


def places(t, words):
    return sorted({p for w in set(words) for p in range(len(t) - len(w) + 1) if w and t[p : p + len(w)] == w})


def with_wobbles(s):
    out = [""]
    for c in s:
        out = [x + o for o in out for x in {"A": "U", "C": "G", "G": "CU", "U": "AG"}[c]]
    return out


def energy(g, t, *parts):
    pairs = []
    for part in parts:
        letters = {i for i, _ in part}
        pairs += [(i, y) for i, y in part if i - 1 in letters or i + 1 in letters]
    total = 0
    for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False):
        loop = (c - a - 1) + (b - d - 1)
        total += round(100 * fold.STACK[g[a - 1] + t[b]][g[c - 1] + t[d]]) if not loop else 170 + 20 * loop
    return total


def classes(kinds, inserted, a1, faced):
    """Class, kd, interaction type and site type of a seed; None where it does not bind."""
    bound = [i for i in range(2, 9) if kinds[i - 2] in "WG"]
    last = None
    for core, at in () if inserted else ((5, 0), (6, 1), (7, 2)):
        if last is None and kinds[at : at + 4] == "WWWW":
            last = max([core, *(i for i in bound if i > core)])
    if last is None and kinds.count("W") >= 6:
        last = 8
    if last is None:
        return None
    first = bound[0]
    k = last - first + 1
    plain = k == 7 or first == 2
    name = f"{k}mer" if plain else f"offset-{k}mer" if first == 3 else f"distant-{k}mer"
    exponent, marks, site_marks = 0.0, "", ""
    for i in range(first, last + 1):
        c = kinds[i - 2]
        if inserted and i == 4 and i < last:
            exponent, marks, site_marks = exponent + site.BULGE[2], marks + "b(4.5)", site_marks + f"b{faced(4, 1)}(4.6)"
        if c != "W":
            exponent += {"x": site.MISMATCH, "G": site.WOBBLE, "-": site.DELETION}[c][i - 2]
            marks += {"x": "x", "G": "w", "-": "b"}[c] + str(i)
            site_marks += f"x{faced(i, 0)}{i}" if c == "x" else {"G": f"w{i}", "-": ""}[c]
    label = ("A1-" if a1 and plain else "") + name
    size = k - ("-" in kinds) + inserted
    table = {8: "9mer" if a1 else "8mer", 7: "8mer" if a1 else "7mer-m8", 6: "7mer-A1" if a1 else "6mer", 5: "6mer-A1" if a1 else "5mer-m2.6"} if plain else {7: "7mer-m8", 6: "6mer-m8", 5: "5mer-m3.7"} if first == 3 else {5: "5mer-m4.8"}
    kind_of_site = table.get(size, "seedless")
    if kind_of_site != "seedless" and site_marks:
        kind_of_site += ("" if "-" in kind_of_site else "-") + site_marks
    return label, site.CLASS_KD[label] * 2**exponent, ("A1-" if a1 else "") + name + ("-" + marks if marks else ""), kind_of_site


def plain_scan(g, t):
    found = [places(t, [reverse_complement(g[1 + k : 5 + k])]) for k in range(3)]
    shifted = [p for p in found[1] if p + 1 not in found[0]]
    bag = {*found[0], *shifted}
    lists = {0: found[0], 1: shifted, 2: [p for p in found[2] if p + 1 not in bag and p + 2 not in bag]}
    full = reverse_complement(g[1:8])
    less_6, less_5 = full[:2] + full[3:], full[:3] + full[4:]
    lists[3] = places(t, [full[:i] + x + full[i + 1 :] for i in (2, 3) for x in "ACGU" if x != full[i]])
    lists[4], lists[5] = places(t, [less_6]), places(t, [less_5]) if less_5 != less_6 else []
    lists[6] = places(t, [full[:4] + x + full[4:] for x in "ACGU"])
    supps = [places(t, with_wobbles(g[12 + k : 16 + k])) if len(g) >= 16 + k else [] for k in range(2)]
    best = {}

    def offer(at, which, g2, bridge, offset, rank):
        if g2 - 29 < 0 or g2 + 1 >= len(t):
            return
        faces = {}
        for i in range(2, 9):
            if i != {4: 6, 5: 5}.get(which):
                faces[i] = g2 - (i - 2) + (which in (4, 5) and i > {4: 6, 5: 5}[which]) - (which == 6 and i >= 5)
        kinds = "".join(kind(g[i - 1], t[faces[i]]) if i in faces else "-" for i in range(2, 9))
        g13 = g2 - 7 - bridge
        behind = "".join(kind(g[i - 1 : i], t[g13 - (i - 13)]) for i in range(13, 18)) if offset >= 0 else "xxxxx"
        seed = [(i, y) for i, y in faces.items() if kinds[i - 2] != "x"]
        supp = [(i, g13 - (i - 13)) for i in range(13, 18) if behind[i - 13] != "x"]
        e = energy(g, t, seed, supp)
        if e >= 0:
            return
        made = classes(kinds, which == 6, t[g2 + 1] == "A", lambda i, back: t[faces[i] - back])
        sup = "5mer" if "x" not in behind else "4mer" if "x" not in behind[:4] else "offset-4mer" if "x" not in behind[1:] else "suppless"
        if made is None and (sup == "suppless") or rank == 8 and "WWWW" in kinds:
            return
        if made is None:
            gain = 0.25 * max(-energy(g, t, seed), 0) / 100 + 0.75 * max(-energy(g, t, supp), 0) / 100
            made = "seedless", 1e9 / (gain or 1.0), "seedless", "seedless"
        key = (e, rank, which, offset, -bridge)
        if at not in best or key < best[at][0]:
            best[at] = key, (site_scan.KINDS[rank], g2, bridge, t[g2 - 29 : g2 + 2], kinds, sup, e / 100, made[0], round(made[1], 4), made[2], made[3])

    for which, hits in lists.items():
        rank = {3: 0, 4: 2, 5: 2, 6: 4}.get(which, 6)
        for p in hits:
            for offset in (0, 1):
                for q in supps[offset]:
                    bridge = p + REACH[which] - (q + 3 + offset) - 7
                    if 1 <= bridge <= 15:
                        offer(p, which, p + REACH[which], bridge, offset, rank)
            offer(p, which, p + REACH[which], LONE[which], -1, 7 if rank == 6 else rank + 1)
    for offset in (0, 1):
        for q in supps[offset]:
            offer(q + 11 + offset, 0, q + 14 + offset, 4, offset, 8)
    return {at: row for at, (_, row) in best.items()}


@pytest.fixture(scope="module")
def strands():
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(rng.choice(list("ACGU"), n))
    guides = {f"g{i}": letters(22) for i in range(4)} | {"short": letters(12), "same": "UAAAAAAAGCGCGCAUAUGC", "seventeen": letters(17)}
    planted = []
    for g in guides.values():
        full = reverse_complement(g[1:8])
        behind = reverse_complement(g[12:17])
        for word in (full, full[:4] + "C" + full[4:], full[:4] + "G" + full[4:], full[:2] + full[3:], full[:3] + full[4:], full[:3] + "A" + full[4:]):
            planted += [letters(20) + behind + letters(6) + word + "A" + letters(9), letters(40) + word + letters(9)]
    texts = {f"t{i}": letters(n) for i, n in enumerate((0, 4, 31, 600, 1300))} | {"planted": "".join(planted), "odd": letters(200) + "N-n" + letters(200), "flat": "A" * 90}
    return guides, texts


@pytest.mark.parametrize("salted", [False, True])
def test_whole_scan(spark, strands, salted, monkeypatch):
    guides, texts = strands
    if salted:  # the way of many guides, over chunks of few letters
        monkeypatch.setattr(site_scan, "small", lambda frame: frame)
        monkeypatch.setattr(site_scan, "CHUNK", 50)
    frame = lambda rows, name: spark.createDataFrame(list(rows.items()), f"{name} string, sequence string")
    got = site_scan.scan_sites(frame(guides, "guide_id"), frame(texts, "transcript_id")).collect()
    mine = {(r["guide_id"], r["transcript_id"], r["site"]): (r["kind"], r["g2"], r["bridge"], r["window"], r["kinds"], r["supp_class"], r["energy"], r["seed_class"], round(r["kd"], 4), r["interaction_type"], r["site_type"]) for r in got}
    expected = {(g, t, at): row for g, a in guides.items() for t, b in texts.items() for at, row in plain_scan(a, b).items()}
    assert len(got) == len(mine) and mine == expected
    assert {r["kind"] for r in got} == set(site_scan.KINDS)


def test_empty_scan(spark):
    none = spark.createDataFrame([], "guide_id string, transcript_id string, sequence string")
    assert site_scan.scan_sites(none.select("guide_id", "sequence"), none.select("transcript_id", "sequence")).count() == 0


def test_filters_of_a_scan(spark, strands):
    guides, texts = strands
    frame = lambda rows, name: spark.createDataFrame(list(rows.items()), f"{name} string, sequence string")
    g, t = frame(guides, "guide_id"), frame(texts, "transcript_id")
    every = settings.scan(g, t, settings.Filters(max_kd=1e12)).collect()
    at = lambda rows: {(r["guide_id"], r["transcript_id"], r["site"]) for r in rows}
    coding = spark.createDataFrame([("planted", 300, 700)], "transcript_id string, cds_start int, cds_end int")
    only = settings.scan(g, t, settings.Filters(max_kd=1e12, cds=False, utr3=False), coding=coding).collect()
    assert at(only) == at(r for r in every if r["transcript_id"] == "planted" and r["g2"] - 29 < 300)
    paired = spark.createDataFrame([("planted", [1.0 if 100 <= i < 400 else 0.2 for i in range(len(texts["planted"]))])], "transcript_id string, p array<double>")
    open_ = settings.scan(g, t, settings.Filters(max_kd=1e12, seed_access=0.5), unpaired=paired).collect()
    assert at(open_) == at(r for r in every if r["transcript_id"] == "planted" and not all(100 <= i < 400 for i in range(r["g2"] - 3, r["g2"] + 1)))
    kept = spark.createDataFrame([("planted", 0, 500, 1.0), ("planted", 500, 900, 0.0)], "transcript_id string, start long, end long, value double")
    scored = settings.scan(g, t, settings.Filters(max_kd=1e12, conserved=16), conserved=kept).collect()
    mean = lambda r: sum(min(500, r["g2"] + 2) > i for i in range(r["g2"] - 29, r["g2"] + 2)) / max(1, sum(i < 900 for i in range(r["g2"] - 29, r["g2"] + 2)))
    assert at(scored) == at(r for r in every if r["transcript_id"] == "planted" and r["g2"] - 29 < 900 and int(31 * mean(r) + 0.5) >= 16)
    seeds = settings.scan(g, t, settings.Filters(min_seed="6mer", max_kd=1e12, supp_paired=True)).collect()
    assert at(seeds) == at(r for r in every if r["seed_class"][-4:] in ("6mer", "7mer") and r["supp_class"] != "suppless")
    with pytest.raises(ValueError):
        settings.scan(g, t, settings.Filters(min_seed="9mer"))


def test_search_of_guides(spark):
    from bindlattice.operators import design, design_search

    rng = np.random.default_rng(21)
    letters = lambda n: "".join(rng.choice(list("ACGU"), n))
    guides = {f"g{i}": letters(21) for i in range(25)}
    texts = {f"t{i}": letters(400) for i in range(5)}
    frame = lambda rows, name: spark.createDataFrame(list(rows.items()), f"{name} string, sequence string")
    required, excluded = {k: texts[k] for k in ("t0", "t1", "t2", "t3")}, {"t4": texts["t4"]}
    scanned = {(g, t): plain_scan(a, b).values() for g, a in guides.items() for t, b in texts.items()}
    covers = {g for g in guides if all(any(r[8] <= 3000 for r in scanned[g, t]) for t in required)}
    barred = {g for g in guides if any(r[8] <= 3e5 and r[0].endswith("+supp") and r[7] != "seedless" and r[5] != "suppless" for r in scanned[g, "t4"])}
    assert 0 < len(covers) < len(guides) and 0 < len(barred) < len(guides)
    found = design_search.covering(frame(guides, "guide_id"), frame(required, "transcript_id"), 3000.0)
    assert {r["guide_id"] for r in found.collect()} == covers
    assert {r["guide_id"] for r in design_search.binds_any(frame(guides, "guide_id"), frame(excluded, "transcript_id"), 3e5).collect()} == barred
    assert design_search.covering(frame(guides, "guide_id"), frame(texts, "transcript_id").limit(0), 1.0).count() == len(guides)
    # Two short transcripts: every kept string has the letters of a grip that both have.
    both = {"a": "GAUUACAGGCAUGCAAUCGUAGCAUUACGAUUACAGCAUGGCAU", "b": "CCGAUUACAGAACAUCGUAGCAUUAACGAUUACAGCAUGACUUU"}
    made = design_search.candidates(frame(both, "transcript_id"), ["GGG", "CCC"]).collect()
    grips = {r["grip"] for r in design.required_grips(design.grips(frame(both, "transcript_id"), 4, 3, 15).select("grip", "transcript_id"), frame(both, "transcript_id")).collect()}
    assert made and {r["grip"] for r in made} <= grips
    for r in made[:50]:
        w3, w5 = r["grip"].split("/")
        assert r["sequence"][1:5] == reverse_complement(w3) and r["sequence"][12:15] == reverse_complement(w5) and len(r["sequence"]) == 21
