"""Seeds on nine-letter targets against all alignments of all seeds."""

import itertools

import numpy as np

from bindlattice.operators import seed_words

PAIRS = {"AU", "UA", "GC", "CG"}


def plain_ways():
    """Target letters opposite each seed letter, None for a bulged one, and bulged target letters."""
    for n, window in ((7, 7), (6, 6), (7, 8)):
        for start in range(9 - window + 1):
            if n == 7 and window == 7:
                yield list(range(start, start + 7)), 0
            elif n == 6:
                for b in range(7):
                    left = iter(range(start, start + 6))
                    yield [None if i == b else next(left) for i in range(7)], 0
            else:
                for b in range(8):
                    yield [start + i for i in range(8) if i != b], 1


def binds(seed, word):
    for way, bulged in plain_ways():
        ok = [t is not None and seed[i] + word[t] in PAIRS for i, t in enumerate(way)]
        if any(all(ok[k : k + 4]) for k in range(3)) or sum(ok) >= 6 and 7 - sum(ok) + bulged == 1:
            return True
    return False


def test_alignments():
    assert len(seed_words.alignments()) == 47 == len(list(plain_ways()))
    assert sorted((at, b) for at, b in seed_words.alignments()) == sorted(("".join("-" if t is None else str(t) for t in way), bool(b)) for way, b in plain_ways())


def test_compatible_seeds(spark):
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("ACGU"), 9)) for _ in range(6)} | {"AAAAAAAAA", "ACGUACGUA"}
    frame = spark.createDataFrame([(w,) for w in [*words, "ACGU", "ACGUNACGU", *list(words)[:2]]], "word string")
    got = {(r["word"], r["seed"]) for r in seed_words.compatible(frame, seed_words.all_seeds(spark)).collect()}
    seeds = ["".join(s) for s in itertools.product("ACGU", repeat=7)]
    assert got == {(w, s) for w in words for s in seeds if binds(s, w)}
