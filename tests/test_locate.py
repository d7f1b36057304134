"""Places in a genome of chunks against a plain search."""

import numpy as np
import pytest

from bindlattice.operators import locate


@pytest.mark.parametrize("sizes", [(40, 60), (1, 9), (0, 3)])
def test_places(spark, sizes):
    rng = np.random.default_rng(sizes[1])
    genome, rows = {}, []
    for name in ("c1", "c2", "c3"):
        text, number = "", 0
        while len(text) < 400:
            part = "".join(rng.choice(list("ACGU"), int(rng.integers(sizes[0], sizes[1] + 1))))
            rows.append((name, number, part))
            text, number = text + part, number + 1
        genome[name] = text
    genome["flat"] = "A" * 90
    rows += [("flat", i, "A" * 30) for i in range(3)]
    pieces = {f"p{i}": genome["c1"][at : at + n] for i, (at, n) in enumerate(((0, 31), (3, 31), (100, 31), (369, 31), (50, 5), (200, 20), (10, 12), (7, 1)))}
    pieces |= {"again": genome["c2"][20:51], "none": "ACGU" * 8, "a": "AAAAAAA", "empty": "", "null": None}
    chunks = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "chromosome string, number long, letters string")
    frame = spark.createDataFrame(list(pieces.items()), "piece string, letters string")
    expected = {(p, c, i) for p, s in pieces.items() if s for c, t in genome.items() for i in range(len(t)) if t.startswith(s, i)}
    got = locate.places(frame, chunks).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    first = {(r["piece"], r["chromosome"]): r["pos"] for r in locate.first_places(frame, chunks).collect()}
    assert first == {(p, c): min(i for q, d, i in expected if (q, d) == (p, c)) for p, c, _ in expected}
    offsets = spark.createDataFrame([("c1", 1000)], "chromosome string, offset long")
    assert {r["genome_pos"] - r["pos"] for r in locate.shifted(locate.first_places(frame, chunks), offsets).collect()} == {1000}


def test_nothing_to_locate(spark):
    none = spark.createDataFrame([], "piece string, letters string")
    chunks = spark.createDataFrame([("c", 0, "ACGU")], "chromosome string, number long, letters string")
    assert locate.places(none, chunks).count() == 0
    assert locate.places(spark.createDataFrame([("p", "CG")], "piece string, letters string"), chunks.limit(0)).count() == 0
