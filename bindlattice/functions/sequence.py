"""Column functions over RNA strings (A, C, G, U); positions are 0-based unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rna(c: str | Column) -> Column:
    """Upper case with U for T."""
    return F.translate(F.upper(_col(c)), "T", "U")


def is_rna(c: str | Column) -> Column:
    return F.coalesce(_col(c).rlike("^[ACGU]*$"), F.lit(False))


def complement(c: str | Column) -> Column:
    return F.translate(_col(c), "ACGU", "UGCA")


def reverse_complement(c: str | Column) -> Column:
    return F.reverse(complement(c))


def _letters(c: Column) -> Column:
    """The letters as an array; none for an empty string."""
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def complements_with_wobbles(c: str | Column, most: int | None = None) -> Column:
    """All strings that pair with the guide when G and U may pair, in reading order of the target.

    A guide G pairs with C or U, a guide U with A or G.  With ``most``, strings
    with at most that many wobbles.
    """
    struct = "array<struct<s: string, n: int>>"
    start = F.array(F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))).cast(struct)

    def grow(acc: Column, letter: Column) -> Column:
        plain = F.transform(acc, lambda x: F.struct(F.concat(F.translate(letter, "ACGU", "UGCA"), x["s"]).alias("s"), x["n"].alias("n")))
        wobbly = F.transform(acc, lambda x: F.struct(F.concat(F.translate(letter, "GU", "UG"), x["s"]).alias("s"), (x["n"] + 1).alias("n")))
        both = F.when(letter.isin("G", "U"), F.concat(plain, wobbly)).otherwise(plain)
        return (both if most is None else F.filter(both, lambda x: x["n"] <= most)).cast(struct)

    return F.array_sort(F.transform(F.aggregate(_letters(_col(c)), start, grow), lambda x: x["s"]))


def _default_at(rc: Column, at: int) -> Column:
    """rc with each other letter at ``at``."""
    letters = F.filter(F.array(*map(F.lit, "ACGU")), lambda x: x != F.substring(rc, at + 1, 1))
    return F.transform(letters, lambda x: F.concat(F.substring(rc, 1, at), x, F.substr(rc, F.lit(at + 2))))


def complements_with_default(c: str | Column) -> Column:
    """Reverse complements with exactly one wobble or mismatch, at index 2 or 3 of the target."""
    rc = reverse_complement(c)
    return F.array_sort(F.concat(_default_at(rc, 2), _default_at(rc, 3)))


def complements_with_deletion(c: str | Column) -> Column:
    """Reverse complements less the letter at index 2 or 3; one string if the two are equal."""
    rc = reverse_complement(c)
    cut = lambda at: F.concat(F.substring(rc, 1, at), F.substr(rc, F.lit(at + 2)))
    return F.array_sort(F.array_distinct(F.array(cut(2), cut(3))))


def complements_with_insertion(c: str | Column) -> Column:
    """Reverse complements with one more letter after index 3."""
    rc = reverse_complement(c)
    return F.array_sort(F.transform(F.array(*map(F.lit, "ACGU")), lambda x: F.concat(F.substring(rc, 1, 4), x, F.substr(rc, F.lit(5)))))


def kmers(c: str | Column, k: int) -> Column:
    """All windows of k letters, in order."""
    n = F.length(_col(c)) - k + 1
    at = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(_col(c), i, F.lit(k)))


def occurrences(c: str | Column, pattern: str | Column) -> Column:
    """0-based positions of all occurrences, overlapping ones, too; none for an empty pattern."""
    s, p = _col(c), F.lit(pattern) if isinstance(pattern, str) else pattern
    last = F.length(s) - F.length(p)
    at = F.when((last >= 0) & (F.length(p) > 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: F.substring(s, i + 1, F.length(p)) == p)


def base4(c: str | Column) -> Column:
    """A, C, G, U as digits 0 to 3 of one number."""
    return F.conv(F.translate(_col(c), "ACGU", "0123"), 4, 10).cast("long")


def from_base4(number: str | Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(_col(number).cast("string"), 10, 4), k, "0"), "0123", "ACGU")


def gc_fraction(c: str | Column) -> Column:
    s = _col(c)
    return F.length(F.regexp_replace(s, "[^GC]", "")) / F.when(F.length(s) > 0, F.length(s))


def count_pairs(sense: str | Column, antisense: str | Column) -> Column:
    """Watson-Crick and wobble pairs of sense with the antisense read backwards."""
    both = F.zip_with(_letters(_col(sense)), _letters(F.reverse(_col(antisense))), lambda a, b: F.concat(a, b))
    return F.size(F.filter(both, lambda p: p.isin("AU", "UA", "GC", "CG", "GU", "UG"))).cast("long")


def region(c: str | Column, start: int, end: int) -> Column:
    """Letters start to end, both counted, of a guide whose first letter is 1."""
    return F.substring(_col(c), start, end - start + 1)


def fasta_wrapped(c: str | Column, width: int = 60) -> Column:
    return F.regexp_replace(_col(c), f"(.{{{width}}})(?!$)", "$1\n")


def without_version(c: str | Column) -> Column:
    return F.substring_index(_col(c), ".", 1)


def sync_name(c: str | Column) -> Column:
    """sync-<g2..g8>-<hex of the 2-bit letters of g1 and g9 to the end>-<length less 17>."""
    s = _col(c)
    body = F.concat(F.substring(s, 1, 1), F.substr(s, F.lit(9)))
    return F.concat(F.lit("sync-"), F.substring(s, 2, 7), F.lit("-"), F.hex(base4(body)), F.lit("-"), (F.length(s) - 17).cast("string"))


def region_label(start: Column, end: Column, cds_start: Column, cds_end: Column) -> Column:
    """Which of 5UTR, CDS and 3UTR a span touches, by the bounds of the coding part."""
    touches = [F.when(start < cds_start, "5UTR"), F.when((start <= cds_end) & (end >= cds_start), "CDS"), F.when(end > cds_end, "3UTR")]
    return F.array_join(F.array_compact(F.array(*touches)), " and ")


def passes_design(c: str | Column, excluded: list[str], least_gc: float, most_gc: float) -> Column:
    """No excluded part, GC fraction within bounds, last letter other than U."""
    s = _col(c)
    clean = reduce(lambda a, b: a & b, [F.instr(s, x) == 0 for x in excluded], F.lit(True))
    return clean & gc_fraction(s).between(least_gc, most_gc) & (F.substring(s, -1, 1) != "U")


def from_sync_name(c: str | Column) -> Column:
    """The guide that a sync name stands for."""
    parts = F.split(_col(c), "-")
    size = F.get(parts, F.lit(3)).cast("int") + 17 - 7
    body = F.lpad(F.conv(F.get(parts, F.lit(2)), 16, 4), size, "0")
    letters = F.translate(body, "0123", "ACGU")
    return F.concat(F.substring(letters, 1, 1), F.get(parts, F.lit(1)), F.substr(letters, F.lit(2)))


def seed_reaches(core: Column, least: str) -> Column:
    """Whether a seed class's four-letter core reaches ``least`` as text; a class without core does not."""
    found = F.regexp_extract(core, r"(\dmer)", 1)
    return (found != "") & (found >= least)


def hamming(a: str | Column, b: str | Column) -> Column:
    """Places in which two strings differ; null for strings of different length."""
    x, y = _col(a), _col(b)
    apart = F.size(F.filter(F.zip_with(_letters(x), _letters(y), lambda p, q: p != q), lambda d: d))
    return F.when(F.length(x) == F.length(y), apart)


def count_letter(c: str | Column, letter: str) -> Column:
    s = _col(c)
    return F.length(s) - F.length(F.replace(s, F.lit(letter)))


# Codes of transcript regions.
REGION_CODES = {"3UTR": 1, "CDS": 2, "CDS and 3UTR": 3, "5UTR": 4, "5UTR and CDS": 6, "5UTR and CDS and 3UTR": 7}


def region_code(label: str | Column) -> Column:
    """1 for 3UTR, 2 for CDS, 4 for 5UTR, sums for spans over several; null for other labels."""
    codes = F.create_map(*(F.lit(x) for pair in REGION_CODES.items() for x in pair))
    return F.try_element_at(codes, _col(label))


def in_region(label: str | Column, mask: Column) -> Column:
    """Whether one of 3UTR, CDS and 5UTR, by exactly this label, is in the mask of codes; other labels are not."""
    code = F.when(_col(label).isin("3UTR", "CDS", "5UTR"), region_code(label))
    return F.coalesce(code.bitwiseAND(mask) > 0, F.lit(False))


def is_double(c: str | Column) -> Column:
    return _col(c).try_cast("double").isNotNull()


def is_int(c: str | Column) -> Column:
    return F.coalesce(_col(c).rlike("^-?[0-9]+$"), F.lit(False)) & _col(c).try_cast("int").isNotNull()


def only_letters(c: str | Column, letters: str) -> Column:
    """Whether a string has no letter outside a character class."""
    return F.coalesce(_col(c).rlike(f"^[{letters}]*$"), F.lit(False))


def power_set(c: str | Column) -> Column:
    """All subsets of an array of up to 20 items; the place of a subset has the bits of its members."""
    items = _col(c)
    masks = F.sequence(F.lit(0), F.pow(F.lit(2.0), F.size(items)).cast("int") - 1)
    return F.transform(masks, lambda m: F.filter(items, lambda x, i: F.floor(m / F.pow(F.lit(2.0), i)) % 2 == 1))


def contains_all(c: str | Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, _col(c))) == 0


def integers_in(c: str | Column) -> Column:
    """All runs of digits of a text as numbers, in order; none for null, nulls for those beyond a long."""
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(\d+)"), 1)
    return F.transform(found, lambda x: x.try_cast("long"))


def decimals_in(c: str | Column) -> Column:
    """All numbers of a text, with a sign and a fraction if they have them, in order; none for null."""
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(-?\d+(?:\.\d+)?)"), 1)
    return F.transform(found, lambda x: x.try_cast("double"))
