"""Tiles of vectors: what is sent, copies, and labels, against plain versions."""

import os
from urllib.parse import urlparse

import numpy as np

from bindlattice.operators import density, fold, graph, spectral


def copied(rng, distinct, copies, width):
    x = rng.normal(0, 1, (distinct, width)).astype(np.float32).astype(np.float64)
    return np.concatenate([x] * copies)


def test_blocks_grow_with_the_rows(spark):
    rows = spark.range(100_000).selectExpr("id", "array_repeat(cast(id as float), 64) as vector")
    # Every row is sent once for each block: blocks of 2048 would send each 98 times as two sides.
    assert graph._block_pairs(rows).count() <= 9 * 100_000
    # Results of many labels a row keep blocks small.
    assert graph._most(rows, 1_000_000) == -(-100_000 // graph.BLOCK)


def test_neighbours_of_copies_come_by_id(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 40)
    monkeypatch.setattr(graph, "PIECE", 17)
    x = copied(np.random.default_rng(1), 50, 7, 24)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    got = {}
    for r in graph.knn(frame, 9).orderBy("id", "rn").collect():
        got.setdefault(r["id"], []).append(r["other"])
    base = x[:50] / np.linalg.norm(x[:50], axis=1, keepdims=True)
    cosine = np.tile(base @ base.T, (7, 7))
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (j % 50 != i % 50, -cosine[i % 50, j % 50], j))
        assert got[i] == order[:9]


def test_silhouette_of_copies(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 30)
    monkeypatch.setattr(graph, "PIECE", 13)
    rng = np.random.default_rng(2)
    x = copied(rng, 40, 4, 12) + 1000.0
    label = np.concatenate([rng.integers(0, 4, len(x) - 1), [9]])
    frame = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "id long, vector array<double>, label int")
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        b = min(gap[i, label == c].mean() for c in set(label) if c != label[i])
        scores.append((b - gap[i, own].mean()) / max(b, gap[i, own].mean()) if own.any() else 0.0)
    assert np.isclose(graph.silhouette(frame).first()[0], np.mean(scores), atol=1e-8)


def test_eigenvectors_leave_no_older_basis(spark, monkeypatch):
    folders, real = [], graph.checkpointed

    def kept(df):
        out = real(df)
        folders.append(os.path.dirname(urlparse(out.inputFiles()[0]).path))
        return out

    monkeypatch.setattr(spectral, "checkpointed", kept)
    edges = spark.createDataFrame([(i, j, 1.0 + (i * j) % 3) for i in range(40) for j in range(i + 1, 40) if (i * 7 + j) % 4 == 0], "src long, dst long, weight double")
    found, values = spectral.eigenvectors(edges, 3)
    assert found.count() == 40 and len(values) == 3
    assert [os.path.exists(f) for f in folders] == [False] * (len(folders) - 1) + [True]  # only the vectors stay


def test_structures_meet_once_for_all_their_copies(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("(.)"), 11)) for _ in range(6)]
    texts = base * 4 + [b[:4] + "." + b[5:] for b in base] + ["", "", "(.", "))"]
    frame = spark.createDataFrame([(i % 2, i, x) for i, x in enumerate(texts)], "key long, id long, structure string")
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    expected = [(k % 2, k, j, apart(texts[k], texts[j])) for j in range(len(texts)) for k in range(j) if k % 2 == j % 2 and len(texts[k]) == len(texts[j]) and apart(texts[k], texts[j]) <= 3]
    found = fold.structure_graph(frame)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    # Strings are compared before their ids come in: no comparison follows a join on ids.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [key") >= 2


def test_nearest_points_are_sent_once_a_pair_of_blocks(spark, monkeypatch):
    sent, real = [], graph._block_pairs
    monkeypatch.setattr(density, "_block_pairs", lambda rows: sent.append(real(rows)) or sent[0])
    x = np.random.default_rng(5).normal(0, 1, (20_000, 2)).round(2)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = {}
    for r in density.nearest_others(frame, 4).where("id < 40").orderBy("id", "rn").collect():
        got.setdefault(r["id"], []).append((r["other"], r["gap"]))
    for i in range(40):
        gap = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert got[i] == [(j, gap[j]) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (gap[j], j))[:4]]
    assert sent[0].count() <= 9 * len(x)  # both sides by blocks of 2048 were 20


def test_neighbours_held_do_not_grow_with_the_pieces(spark, monkeypatch):
    # Before, a task held k rows of every piece until its end; now at most twice k a row and some room.
    monkeypatch.setattr(graph, "PIECE", 16)
    rng = np.random.default_rng(6)
    values = rng.normal(0, 1, (64, 40_000))
    best, most = graph._Best(64, 5), 0
    for at in range(0, values.shape[1], 16):
        piece = values[:, at : at + 16]
        i, j = np.nonzero(piece >= best.least(slice(0, 64), piece)[:, None])
        best.add(i, j + at, piece[i, j])
        most = max(most, best.held)
    assert most < 64 * 40_000 // 16
    rows, others, value = best.all()
    order = np.argsort(-values, axis=1)[:, :5]
    assert others.reshape(64, 5).tolist() == order.tolist() and rows.tolist() == np.repeat(np.arange(64), 5).tolist()
    assert np.array_equal(value.reshape(64, 5), np.take_along_axis(values, order, axis=1)) and np.array_equal(best.bar, value.reshape(64, 5)[:, -1])


def test_silhouettes_leave_a_task_run_by_run(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    from bindlattice.operators import sweeps

    sizes, real = [], PandasGroupedOpsMixin.applyInArrow
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", lambda self, f, schema: sizes.append(f) or real(self, f, schema))
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (60, 3))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    labels = spark.createDataFrame([(r, i, i % (r + 2)) for r in range(3) for i in range(60)], "run long, id long, label long")
    got = {r["run"]: r["silhouette"] for r in sweeps.silhouettes(points, labels).collect()}
    frame = lambda r: spark.createDataFrame([(i, x[i].tolist(), i % (r + 2)) for i in range(60)], "id long, vector array<double>, label long")
    assert all(np.isclose(got[r], graph.silhouette(frame(r)).first()[0], atol=1e-9) for r in range(3))
    import pyarrow as pa

    some = pa.record_batch({"id": list(range(60)), "vector": x.tolist(), "labels": [[float(i % (r + 2)) for r in range(3)] for i in range(60)], "own": [0] * 60, "row": [0] * 60, "col": [0] * 60})
    assert [len(b) for b in sizes[0](iter([some]))] == [60 * (r + 2) for r in range(3)]
