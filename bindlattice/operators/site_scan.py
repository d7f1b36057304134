"""The whole scan: seed, one-default, bulged, lone and seedless sites, the one of least energy at each place.

Words that a guide can pair with are few, so they are listed once (a list an
alignment class) and every transcript word is held against them in one equi-join.
Each word occurrence carries the letters around it, so that nothing after it goes
back to a transcript.  Places, classes and energies are column expressions; a band
join pairs seed parts with supplementary parts.

Alignment classes, by the words of a guide (letters counted from 1):

    seed      letters 2-5, 3-6 and 4-7; the shifted ones where no earlier list covers them
    special   letters 2-8 with one wobble or mismatch opposite letter 6 or 5
    delete    letters 2-8 less the target letter opposite 6 or 5 (a bulge in the guide)
    insert    letters 2-8 with one more target letter between 5 and 4 (a bulge in the target)
    supp      letters 13-16 and 14-17, wobbles allowed

A candidate is a seed part with a supplementary part 1 to 15 letters before it, a seed
part alone, or a supplementary part alone whose seed has no four Watson-Crick pairs in
a row.  At each place of a guide in a transcript the candidate of least energy stays,
if that is below 0; ties go to the earlier class, then to the earlier lists and places.

Energies are sums over the alignment, in hundredths of a kcal/mol: stacks of
neighbouring pairs, and loops for all else between two pairs.  Pairs without a pair next
to them in the guide do not count, nor does a supplement that a candidate has no part of.

Defined results: guides too short for a list have no words in it; places whose 31-letter
window does not lie in the transcript give no site; letters other than A, C, G and U
pair with nothing; repeated ids count as rows of one guide or transcript.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindlattice.functions import sequence as seq
from bindlattice.operators import sites as site
from bindlattice.operators.fold import INTERIOR, STACK
from bindlattice.operators.graph import checkpointed
from bindlattice.operators.joins import alike, band_join, small

#: Lists of words: the three seed lists, one-default, bulge opposite letter 6 and 5, inserted letter, supplements.
SPECIAL, DELETE_6, DELETE_5, INSERT, SUPP = 3, 4, 5, 6, 7
#: Letters of a word by list, and how far behind its first letter the one opposite letter 2 (13) lies.
LENGTH = (4, 4, 4, 7, 6, 6, 8, 4, 4)
REACH = (3, 4, 5, 6, 5, 5, 7, 3, 4)
#: Bridge that a lone seed part is written with, by list.
LONE_BRIDGE = (4, 4, 4, 7, 6, 6, 8)
KINDS = ("special+supp", "special", "delete+supp", "delete", "insert+supp", "insert", "seed+supp", "seed", "supp")
#: Letters before a word, and from its first on, that a site's window can take up.
BEFORE, AFTER = 26, 17
#: Letters of a transcript cut at once, and keys that hot words are dealt to where guides are many.
CHUNK, SALTS = 512, 64
#: Stands for letters beyond the ends of a transcript.
_BEYOND = "\0"
_PLACE = ["guide_id", "transcript_id"]
_PAIR_NAMES = ",".join(STACK)
_STACKS = [round(100 * STACK[a][b]) for a in STACK for b in STACK]


def guide_words(guides: DataFrame) -> DataFrame:
    """(guide_id, guide, list, word) of every word that each guide (guide_id, sequence) can pair with."""
    full = seq.region("sequence", 2, 8)
    lists = [F.array(seq.reverse_complement(seq.region("sequence", 2 + k, 5 + k))) for k in range(3)]
    rc = seq.reverse_complement(full)
    less_6, less_5 = (F.concat(F.substring(rc, 1, at), F.substr(rc, F.lit(at + 2))) for at in (2, 3))
    lists += [seq.complements_with_default(full), F.array(less_6), F.when(less_5 != less_6, F.array(less_5)), seq.complements_with_insertion(full)]
    lists += [seq.complements_with_wobbles(seq.region("sequence", 13 + k, 16 + k)) for k in range(2)]
    named = F.array(*(F.struct(F.lit(k).alias("list"), words.alias("words")) for k, words in enumerate(lists)))
    each = guides.select("guide_id", F.col("sequence").alias("guide"), F.explode(named).alias("l")).select("guide_id", "guide", "l.list", F.explode("l.words").alias("word"))
    sound = F.length("word") == F.element_at(F.array(*map(F.lit, LENGTH)), F.col("list") + 1)
    return each.where(sound).distinct()


def transcript_words(transcripts: DataFrame) -> DataFrame:
    """(transcript_id, pos, around, word) of each word of 4, 6, 7 and 8 letters; ``around`` has BEFORE letters before it and AFTER from its first on, zero letters beyond the ends."""
    padded = F.concat(F.repeat(F.lit(_BEYOND), BEFORE), F.col("sequence"), F.repeat(F.lit(_BEYOND), AFTER))
    starts = F.when(F.length("sequence") > 0, F.sequence(F.lit(0), F.length("sequence") - 1, F.lit(CHUNK)))
    # A chunk holds the letters around all its words, so cutting takes time in proportion to a transcript's length.
    chunks = F.transform(starts, lambda c: F.struct(c.alias("start"), F.substring(padded, c + 1, F.lit(CHUNK + BEFORE + AFTER)).alias("letters")))
    cut = transcripts.select("transcript_id", F.explode(chunks).alias("c")).select("transcript_id", "c.start", "c.letters")
    held = F.least(F.length("letters") - BEFORE - AFTER, F.lit(CHUNK))
    around = F.transform(F.sequence(F.lit(0), held - 1), lambda i: F.struct((F.col("start") + i).alias("pos"), F.substring("letters", i + 1, F.lit(BEFORE + AFTER)).alias("around")))
    each = cut.select("transcript_id", F.explode(around).alias("a")).select("transcript_id", "a.pos", "a.around")
    words = F.array(*(F.substring("around", BEFORE + 1, n) for n in sorted(set(LENGTH))))
    return each.select("transcript_id", "pos", "around", F.explode(words).alias("word")).where(~F.contains("word", F.lit(_BEYOND)))


def word_hits(guides: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(guide_id, transcript_id, guide, list, pos, around) wherever a transcript holds one of a guide's words."""
    wanted = checkpointed(guide_words(guides))
    found = transcript_words(transcripts)
    sent = small(wanted)
    if sent is wanted:  # many guides: the few words are hot keys, so each is dealt to SALTS of them
        found = found.withColumn("salt", F.pmod(F.xxhash64("transcript_id", "pos"), F.lit(SALTS)))
        wanted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        hits = found.join(wanted, ["word", "salt"])
    else:
        hits = found.join(sent, "word")
    return hits.select("guide_id", "transcript_id", "guide", "list", "pos", "around")


def _uncovered(hits: DataFrame, by: DataFrame, shift: int) -> DataFrame:
    return hits.join(by.select(*_PLACE, (F.col("pos") - shift).alias("pos")).distinct(), [*_PLACE, "pos"], "left_anti")


def seed_parts(hits: DataFrame) -> DataFrame:
    """Hits of the seed lists that no earlier list covers, and those of the longer lists."""
    lists = [hits.where(F.col("list") == k) for k in range(3)]
    bag = lists[0].unionByName(_uncovered(lists[1], lists[0], 1))
    plain = bag.unionByName(_uncovered(_uncovered(lists[2], bag, 1), bag, 2))
    return plain.unionByName(hits.where(F.col("list").between(SPECIAL, INSERT)))


def _of_list(values: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col("list") + 1)


def _window(g2: Column) -> Column:
    """The 31 letters that end behind the letter opposite guide letter 2."""
    return F.substring(F.col("around"), g2 - F.col("pos") + (BEFORE - site.WINDOW + 3), F.lit(site.WINDOW))


def candidates(hits: DataFrame) -> DataFrame:
    """Seed parts with each supplementary part in reach, seed parts alone, supplementary parts alone."""
    g2 = F.col("pos") + _of_list(REACH)
    rank = F.when(F.col("list") == SPECIAL, 0).when(F.col("list").isin(DELETE_6, DELETE_5), 2).when(F.col("list") == INSERT, 4).otherwise(6)
    seeds = seed_parts(hits).select(*_PLACE, "guide", F.col("pos").alias("site"), "list", g2.alias("g2"), _window(g2).alias("window"), rank.alias("rank"))
    supps = hits.where(F.col("list") >= SUPP).withColumn("supp_offset", F.col("list") - SUPP).withColumn("g13", F.col("pos") + 3 + F.col("supp_offset"))
    least, most = site.LEAST_BRIDGE + 7, site.MOST_BRIDGE + 7
    both = band_join(seeds, supps.select(*_PLACE, "g13", "supp_offset"), _PLACE, "g2", "g13", least, most).withColumn("bridge", F.col("g2") - F.col("g13") - 7)
    lone = seeds.withColumns({"bridge": _of_list(LONE_BRIDGE), "rank": F.when(F.col("rank") == 6, 7).otherwise(F.col("rank") + 1), "supp_offset": F.lit(-1)})
    # A supplement alone stands for a seed four letters on, whatever that seed's letters are.
    alone = supps.withColumn("g2", F.col("g13") + 11)
    alone = alone.select(*_PLACE, "guide", (F.col("g2") - 3).alias("site"), F.lit(0).alias("list"), "g2", _window(F.col("g2")).alias("window"), F.lit(8).alias("rank"), F.lit(4).alias("bridge"), "supp_offset")
    every = both.select(*alone.columns).unionByName(lone.select(*alone.columns)).unionByName(alone)
    return every.where((F.length("window") == site.WINDOW) & ~F.contains("window", F.lit(_BEYOND)))


def _shift(g: int | Column) -> Column:
    """How far a bulge moves the letter opposite seed letter g."""
    bulged = F.when(F.col("list") == DELETE_6, 6).when(F.col("list") == DELETE_5, 5)
    g = F.lit(g) if isinstance(g, int) else g
    return F.when(g > bulged, 1).when((F.col("list") == INSERT) & (g >= 5), -1).otherwise(0)


def _facing(g: int | Column) -> Column:
    """Place in the window opposite seed letter g."""
    return site.WINDOW + 1 - g + _shift(g)


def _faced() -> Column:
    """The window's letters opposite guide letters 2 to 8; a dash opposite one that is bulged out."""
    back = lambda first, n: F.reverse(F.substring("window", first, n))
    less = {DELETE_6: F.concat(back(27, 4), F.lit("-"), back(25, 2)), DELETE_5: F.concat(back(28, 3), F.lit("-"), back(25, 3)), INSERT: F.concat(back(28, 3), back(23, 4))}
    out = F.when(F.lit(False), "")
    for k, letters in less.items():
        out = out.when(F.col("list") == k, letters)
    return out.otherwise(back(24, 7))


def _pair_code(guide: Column, target: Column) -> Column:
    """Place of a pair among the stacking table's pairs, from 0, Watson-Crick pairs first; -1 for no pair."""
    named = F.concat(F.lit(","), guide, target, F.lit(","))
    return ((F.position(named, F.lit(f",{_PAIR_NAMES},")) + 2) / 3).cast("int") - 1


def _at(table: list[int], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, table)), index + 1)


def _kept(mask: int, n: int) -> list[int]:
    """Letters, from 0, of a mask that have a pair next to them."""
    paired = [k for k in range(n) if mask >> k & 1]
    return [k for k in paired if k - 1 in paired or k + 1 in paired]


def _bulge(kind: int, k: int) -> int:
    """Target letters by which seed letter k (from 0, for letter 2) of an alignment lies further back; the kinds are plain, delete 6, delete 5, insert."""
    return {1: -1 if k > 4 else 0, 2: -1 if k > 3 else 0, 3: 1 if k > 2 else 0}.get(kind, 0)


def _loops(mask: int, n: int, kind: int) -> int:
    """Hundredths of a kcal/mol of all loops between the kept pairs of a part; stacks not counted."""
    kept = _kept(mask, n)
    gaps = [(j - i - 1) + (j - i - 1 + _bulge(kind, j) - _bulge(kind, i)) for i, j in zip(kept, kept[1:], strict=False)]
    return sum(round(100 * INTERIOR) + 20 * gap for gap in gaps if gap)


_SEED_MASKS, _SUPP_MASKS = range(128), range(32)
_SEED_LOOPS = [_loops(m, 7, kind) for kind in range(4) for m in _SEED_MASKS]
_SUPP_LOOPS = [_loops(m, 5, 0) for m in _SUPP_MASKS]
_LAST_KEPT = [max(_kept(m, 7), default=-3) + 2 for m in _SEED_MASKS]
_FIRST_KEPT = [min(_kept(m, 5), default=-14) + 13 for m in _SUPP_MASKS]
_FIRST_PAIR = [min((k for k in range(7) if m >> k & 1), default=-3) + 2 for m in _SEED_MASKS]
_LAST_PAIR = [max((k for k in range(7) if m >> k & 1), default=-3) + 2 for m in _SEED_MASKS]


def _stacked(codes: list[str], broken: dict[int, Column]) -> Column:
    """Sum of the stacks of neighbouring pairs; ``broken`` says for a place where a bulge lies behind it."""
    terms = []
    for k, (a, b) in enumerate(zip(codes, codes[1:], strict=False)):
        both = (F.col(a) >= 0) & (F.col(b) >= 0)
        both = both & ~broken[k] if k in broken else both
        terms.append(F.when(both, _at(_STACKS, F.col(a) * len(STACK) + F.col(b))).otherwise(0))
    return sum(terms[1:], terms[0])


def _mask(codes: list[str]) -> Column:
    bits = [F.when(F.col(c) >= 0, 1 << k).otherwise(0) for k, c in enumerate(codes)]
    return sum(bits[1:], bits[0])


def _kind_letter(code: str) -> Column:
    return F.substring(F.lit("xWWWWGG"), F.col(code) + 2, F.lit(1))


def with_energy(rows: DataFrame) -> DataFrame:
    """Candidates with the pair kinds of both parts (W, G, x, and - for a letter bulged out), their energies in hundredths, and the mask of paired seed letters."""
    seed, supp = [f"_s{g}" for g in range(2, 9)], [f"_p{g}" for g in range(13, 18)]
    letter = lambda g: F.substring("guide", g, 1)
    coded = rows.withColumn("_faced", _faced())
    coded = coded.withColumns({
        **{c: _pair_code(letter(g), F.substring("_faced", g - 1, 1)) for g, c in zip(range(2, 9), seed, strict=True)},
        **{c: F.when(F.col("supp_offset") >= 0, _pair_code(letter(g), F.substring("window", F.lit(36 - g) - F.col("bridge"), F.lit(1)))).otherwise(-1) for g, c in zip(range(13, 18), supp, strict=True)},
    })
    masked = coded.withColumns({"mask": _mask(seed), "_supp_mask": _mask(supp)})
    bulged = {"_s6": DELETE_6, "_s5": DELETE_5}
    kinds = [F.when(F.col("list") == bulged[c], "-").otherwise(_kind_letter(c)) if c in bulged else _kind_letter(c) for c in seed]
    kind = F.when(F.col("list") == DELETE_6, 1).when(F.col("list") == DELETE_5, 2).when(F.col("list") == INSERT, 3).otherwise(0)
    priced = masked.withColumns({
        "kinds": F.concat(*kinds), "supp_kinds": F.concat(*map(_kind_letter, supp)),
        "seed_energy": _stacked(seed, {2: F.col("list") == INSERT}) + _at(_SEED_LOOPS, kind * 128 + F.col("mask")),
        "supp_energy": _stacked(supp, {}) + _at(_SUPP_LOOPS, F.col("_supp_mask")),
        "_last": _at(_LAST_KEPT, F.col("mask")), "_first": _at(_FIRST_KEPT, F.col("_supp_mask")),
    })
    # Between the parts lies one loop, of guide letters and of target letters.
    letters = (F.col("_first") - F.col("_last") - 1) + (_facing(F.col("_last")) - (36 - F.col("bridge") - F.col("_first")) - 1)
    between = F.when((F.col("_last") > 0) & (F.col("_first") > 0), round(100 * INTERIOR) + 20 * letters).otherwise(0)
    return priced.withColumn("energy", F.col("seed_energy") + F.col("supp_energy") + between).drop("_faced", "_last", "_first", "_supp_mask", *seed, *supp)


def seed_span(kinds: Column, mask: Column, inserted: Column) -> tuple[Column, Column]:
    """First and last guide letter of a bound seed: from the first pair on to the deepest one that the core reaches; nulls for none."""
    core = F.when(inserted, F.lit(None)).when(kinds.startswith("WWWW"), 5).when(F.substring(kinds, 2, 4) == "WWWW", 6).when(F.substring(kinds, 3, 4) == "WWWW", 7)
    whole = F.length(F.replace(F.replace(F.replace(kinds, F.lit("x")), F.lit("G")), F.lit("-"))) >= 6
    last = F.when(core.isNotNull(), F.greatest(core, _at(_LAST_PAIR, mask))).when(whole, F.lit(8))
    return F.when(last.isNotNull(), _at(_FIRST_PAIR, mask)), last


def spanned_class(first: Column, last: Column, a1: Column) -> Column:
    """Seed class by the span of its letters."""
    size = last - first + 1
    name = F.concat(size.cast("string"), F.lit("mer"))
    plain = F.when((first == 2) | (size == 7), F.concat(F.when(a1, "A1-").otherwise(""), name)).when((first == 3) | (size == 6), F.concat(F.lit("offset-"), name))
    return F.when(size.isNull(), "seedless").otherwise(F.coalesce(plain, F.concat(F.lit("distant-"), name)))


def _each_letter(first: Column, last: Column, of: object) -> Column:
    at = F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, of)


def log2_penalty(kinds: Column, inserted: Column, first: Column, last: Column) -> Column:
    """Sum of the exponents of wobbles, mismatches and bulges between two letters, both counted."""
    tables = {"G": site.WOBBLE, "x": site.MISMATCH, "-": site.DELETION}

    def one(g: Column) -> Column:
        kind = F.substring(kinds, g - 1, F.lit(1))
        own = [F.when(kind == k, F.element_at(F.array(*map(F.lit, t)), g - 1)) for k, t in tables.items()]
        return F.coalesce(*own, F.lit(0.0)) + F.when(inserted & (g == 4) & (g < last), site.BULGE[2]).otherwise(0.0)

    return F.aggregate(_each_letter(first, last, one), F.lit(0.0), lambda a, x: a + x)


def _labels(kinds: Column, inserted: Column, first: Column, last: Column, site_type: bool) -> Column:
    """The letters of a span that are not plain pairs, one after the other."""

    def one(g: Column) -> Column:
        kind, faced = F.substring(kinds, g - 1, F.lit(1)), F.substring(F.col("window"), _facing(g), F.lit(1))
        number = g.cast("string")
        bulge = F.lit("b(4.5)") if not site_type else F.concat(F.lit("b"), F.substring(F.col("window"), _facing(g) - 1, F.lit(1)), F.lit("(4.6)"))
        mark = F.when(kind == "x", F.concat(F.lit("x"), faced if site_type else F.lit(""), number)).when(kind == "G", F.concat(F.lit("w"), number))
        if not site_type:
            mark = F.when(kind == "-", F.concat(F.lit("b"), number)).otherwise(mark)
        return F.concat(F.when(inserted & (g == 4) & (g < last), bulge).otherwise(""), F.coalesce(mark, F.lit("")))

    return F.array_join(_each_letter(first, last, one), "")


def site_label(label: Column, kinds: Column, inserted: Column, first: Column, last: Column, a1: Column) -> Column:
    """Site type by the number of letters bound and whether A faces letter 1, with its defaults behind it."""
    size = last - first + 1 - F.contains(kinds, F.lit("-")).cast("int") + inserted.cast("int")
    plain = F.when(size == 8, F.when(a1, "9mer").otherwise("8mer")).when(size == 7, F.when(a1, "8mer").otherwise("7mer-m8"))
    plain = plain.when(size == 6, F.when(a1, "7mer-A1").otherwise("6mer")).when(size == 5, F.when(a1, "6mer-A1").otherwise("5mer-m2.6"))
    offset = F.when(size == 7, "7mer-m8").when(size == 6, "6mer-m8").when(size == 5, "5mer-m3.7")
    distant = F.when(size == 5, "5mer-m4.8")
    core = F.when(label == "seedless", None).when(label.startswith("offset"), offset).when(label.startswith("distant"), distant).otherwise(plain)
    marks = _labels(kinds, inserted, first, last, True)
    dash = F.when((marks != "") & ~F.contains(core, F.lit("-")), "-").otherwise("")
    return F.coalesce(F.concat(core, dash, marks), F.lit("seedless"))


def _a1() -> Column:
    return F.substring("window", site.WINDOW, 1) == "A"


def classed(rows: DataFrame) -> DataFrame:
    """Candidates with the span of their seed, seed class and supplementary class."""
    first, last = seed_span(F.col("kinds"), F.col("mask"), F.col("list") == INSERT)
    spanned = rows.withColumns({"first": first, "last": last})
    bound = F.translate("supp_kinds", "G", "W")
    supp = F.when(bound == "WWWWW", "5mer").when(bound.startswith("WWWW"), "4mer").when(bound.endswith("WWWW"), "offset-4mer").otherwise("suppless")
    return spanned.withColumns({"seed_class": spanned_class(F.col("first"), F.col("last"), _a1()), "supp_class": supp})


def named(rows: DataFrame) -> DataFrame:
    """Sites with kd, interaction type and site type."""
    kinds, inserted, first, last, label = F.col("kinds"), F.col("list") == INSERT, F.col("first"), F.col("last"), F.col("seed_class")
    # Parts that cost energy hold nothing together; where neither part gains any the seedless constant stays.
    gain = lambda c: F.greatest(-F.col(c), F.lit(0)) / 100
    strength = 0.25 * gain("seed_energy") + 0.75 * gain("supp_energy")
    loose = site.CLASS_KD["seedless"] / F.when(strength > 0, strength).otherwise(1.0)
    kd = F.when(label == "seedless", loose).otherwise(site.class_kd(label) * F.pow(F.lit(2.0), log2_penalty(kinds, inserted, first, last)))
    marks = _labels(kinds, inserted, first, last, False)
    # Of a class that A opposite letter 1 makes no stronger, the name still says that it is there.
    prefix = F.when(_a1() & ~label.startswith("A1-"), "A1-").otherwise("")
    interaction = F.when(label == "seedless", label).otherwise(F.concat(prefix, label, F.when(marks != "", F.concat(F.lit("-"), marks)).otherwise("")))
    return rows.withColumns({"kd": kd, "interaction_type": interaction, "site_type": site_label(label, kinds, inserted, first, last, _a1())})


def _scanned(guides: DataFrame, transcripts: DataFrame) -> DataFrame:
    hits = checkpointed(word_hits(guides, transcripts))
    found = classed(with_energy(candidates(hits)))
    binds = (F.col("seed_class") != "seedless") | (F.col("supp_class") != "suppless")
    seedless = (F.col("rank") < 8) | ~F.contains("kinds", F.lit("WWWW"))
    # The conditions stand inside the aggregate: as a filter they would be worked out a second time below the energies.
    order = F.struct("energy", "rank", "list", "supp_offset", (-F.col("bridge")).alias("place"), "guide", "g2", "bridge", "window", "kinds", "seed_class", "supp_class", "first", "last", "seed_energy", "supp_energy")
    best = found.groupBy(*_PLACE, "site").agg(F.min(F.when((F.col("energy") < 0) & binds & seedless, order)).alias("b")).where("b is not null")
    sites = named(best.select(*_PLACE, "site", "b.*").withColumn("kind", _at_name(F.col("rank"))))
    return sites.select(*_PLACE, "site", "kind", "g2", "bridge", "window", "kinds", "seed_class", "supp_class", "interaction_type", "site_type", (F.col("energy") / 100).alias("energy"), "kd")


def _by_text(guides: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites of transcripts with equal letters, found once under the least id of them, and (transcript_id, text) of all transcripts."""
    members, texts = alike(transcripts, "transcript_id", "sequence")
    return _scanned(guides, texts.select(F.col("text").alias("transcript_id"), "sequence")), members


def _of_members(found: DataFrame, members: DataFrame) -> DataFrame:
    """Sites by text for every transcript of the text."""
    return found.withColumnRenamed("transcript_id", "text").join(members, "text").select(*found.columns)


def scan_sites(guides: DataFrame, transcripts: DataFrame, max_kd: float | None = None) -> DataFrame:
    """The site of least energy at each place of every guide (guide_id, sequence) in every transcript (transcript_id, sequence).

    guide_id, transcript_id, site (place of the seed part), kind, g2 (place opposite guide letter 2),
    bridge, window (its 31 letters), kinds, seed_class, supp_class, interaction_type, site_type, energy (kcal/mol) and kd.
    Transcripts with equal letters are scanned once.
    """
    found, members = _by_text(guides, transcripts)
    return _of_members(found if max_kd is None else found.where(F.col("kd") <= max_kd), members)


def strongest(guides: DataFrame, transcripts: DataFrame, k: int) -> DataFrame:
    """The k sites of each guide of least kd (to four decimals), then energy, transcript_id and site, with their ``place`` from 1.

    A text stands under the least id of its transcripts, so a site that k sites of texts
    come before has k sites before it in each of its transcripts: only the first k by text
    go on to the transcripts.
    """
    found, members = _by_text(guides, transcripts)
    place = F.row_number().over(Window.partitionBy("guide_id").orderBy(F.round("kd", 4), "energy", "transcript_id", "site"))
    first = found.withColumn("place", place).where(F.col("place") <= k).drop("place")
    return _of_members(first, members).withColumn("place", place).where(F.col("place") <= k)


def _at_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), rank + 1)
