"""Every query with an oracle against DuckDB on the smallest tables."""

import pandas as pd
import pytest

from bindlattice.plans.catalogue import ORACLE_SQL, QUERIES


def rows(frame):
    columns = sorted(frame.columns)
    text = lambda v: "" if pd.isna(v) else f"{v:.5g}" if isinstance(v, float) else str(v)
    return columns, sorted(tuple(text(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, sf, oracle, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(oracle.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).toPandas() is not None


def test_every_part_is_folded_and_aligned_whole(spark, sf):
    from functools import cache

    from bindlattice.operators import fold
    from bindlattice.plans.site_queries import _strands

    strands = {r["key"]: r["s"] for r in _strands(spark, sf).collect()}
    assert {r["id"]: (r["energy"], r["structure"]) for r in QUERIES["fold_mfe"](spark, sf).collect()} == {k: fold.fold_one(s) for k, s in strands.items()}

    def best(a, b):
        @cache
        def at(i, j, gap):
            """Best score of a[i:] and b[j:] after a gap in b (1), in a (2) or none (0)."""
            if i == len(a) and j == len(b):
                return 0.0
            out = -1e9
            if i < len(a) and j < len(b):
                out = at(i + 1, j + 1, 0) + (2.0 if a[i] == b[j] else -3.0)
            if i < len(a):
                out = max(out, at(i + 1, j, 1) - (1.0 if gap == 1 else 5.0))
            return max(out, at(i, j + 1, 2) - (1.0 if gap == 2 else 5.0)) if j < len(b) else out

        return at(0, 0, 0)

    assert {r["id"]: r["score"] for r in QUERIES["affine_align"](spark, sf).collect()} == {k: best(s, s[7:]) for k, s in strands.items()}


def test_betweenness_reads_every_edge(spark, sf, monkeypatch):
    from bindlattice.operators import graph
    from bindlattice.plans import iterative_queries

    # Hubs beyond 300; a path, whose middle edges lie on most shortest paths.
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(1000, 1009)], "src long, dst long, weight double")
    monkeypatch.setattr(iterative_queries, "_whole_graph", lambda *_: (None, edges))
    got = {r["src"] - 1000: r["score"] for r in QUERIES["betweenness_split"](spark, sf).collect()}
    every = {i: 2.0 * (i + 1) * (9 - i) for i in range(9)}
    assert got == {i: every[i] for i in sorted(every, key=lambda i: (every[i], i))[:5]}
    assert graph.sparsified(edges, 2).count() == 9


def test_graph_holds_every_order(spark, sf, oracle):
    from bindlattice.plans.site_queries import _whole_graph

    orders = oracle.execute("SELECT o_custkey, o_orderkey FROM orders").fetchall()
    ids = [r[0] for r in oracle.execute("SELECT c_custkey FROM customer").fetchall()]
    expected = {}
    for a, key in orders:
        b = min(ids) + key * 7 % len(ids)
        if a != b:
            expected[min(a, b), max(a, b)] = max(key % 9 + 1.0, expected.get((min(a, b), max(a, b)), 0))
    nodes, edges = _whole_graph(spark, sf)
    assert {(r["src"], r["dst"]): r["weight"] for r in edges.collect()} == expected
    assert {x for e in expected for x in e} <= set(ids) and nodes.count() == len(ids)
    ends = {x for e in expected for x in e}
    assert {r["id"] for r in QUERIES["spectral_clusters"](spark, sf).collect()} == ends


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
