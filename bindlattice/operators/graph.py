"""Graphs over matrix rows: neighbours, filters, components, communities and their quality."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_ROUNDS = 50


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read back; a local one only where none is set in local mode."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:///tmp/checkpoints"
    path = f"{folder}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Remove the folder of a checkpointed table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("graph-"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Rows of a block of vectors, more where there are many; a task works on two blocks, BYTES each at most, PIECE rows of either at a time.
BLOCK, BYTES, PIECE = 2048, 2**24, 1024


def _most(rows: DataFrame, values: int = 1) -> int:
    """How many blocks rows (id, vector, ...) need.

    What is sent grows with rows times blocks, so blocks grow to an eighth of the rows, as
    long as their vectors, and a row's ``values`` results, stay within BYTES.
    """
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    room = BYTES // (8 * max(width or 1, values, 1) + 64)
    return max(1, -(-n // max(BLOCK, min(room, -(-n // 8)))))


def _block_pairs(rows: DataFrame, values: int = 1) -> DataFrame:
    """rows (id, vector, ...) dealt to blocks (own), once for each pair of blocks (row <= col) that theirs is in."""
    blocks = _most(rows, values)
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return dealt.withColumns({"row": F.least("own", "_with"), "col": F.greatest("own", "_with")}).drop("_with")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _split(tile: pa.Table) -> tuple[pa.Table, pa.Table]:
    side = tile.column("side").to_numpy()
    return tile.filter(pa.array(side == 0)), tile.filter(pa.array(side == 1))


def _ends(tile: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """The two blocks of a tile of _block_pairs, and whether they are one."""
    row, col = tile.column("row")[0].as_py(), tile.column("col")[0].as_py()
    own = tile.column("own").to_numpy()
    return tile.filter(pa.array(own == row)), tile.filter(pa.array(own == col)), row == col


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of vectors of one length, without nulls, as a matrix."""
    return np.asarray(pa.compute.list_flatten(column).to_numpy(), np.float64).reshape(len(column), -1)


def _pieces(a: int, b: int) -> Iterator[tuple[slice, slice]]:
    for i in range(0, a, PIECE):
        for j in range(0, b, PIECE):
            yield slice(i, min(i + PIECE, a)), slice(j, min(j + PIECE, b))


def _dots(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, gaps: bool = False) -> np.ndarray:
    """Inner products, or squared distances, of rows i of x with rows j of y, each alike wherever its rows lie."""
    out = np.empty(len(i))
    for at in range(0, len(i), 65536):
        p, q = x[i[at : at + 65536]], y[j[at : at + 65536]]
        p, q = (p - q, p - q) if gaps else (p, q)
        out[at : at + 65536] = np.einsum("ij,ij->i", p, q)
    return out


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows; those that a difference of products would blur are worked out apart."""
    if x.shape[1] <= 8:
        return np.sqrt(sum((x[:, None, d] - y[None, :, d]) ** 2 for d in range(x.shape[1])))
    sizes = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :]
    square = sizes - 2 * (x @ y.T)
    i, j = np.nonzero(square <= 1e-5 * sizes)
    square[i, j] = _dots(x, y, i, j, gaps=True)
    return np.sqrt(np.maximum(square, 0))


def _first(ids: np.ndarray, others: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest values of each id; ties go to smaller others."""
    order = np.lexsort((others, -value, ids))
    ids, others, value = ids[order], others[order], value[order]
    start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
    rank = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
    return ids[rank < k], others[rank < k], value[rank < k]


class _Best:
    """The k largest values of each of n rows, as pieces of a matrix of values come.

    A bar a row tells what can still be among its k; what was found is cut back to k a row
    whenever it has doubled, so it never grows with the number of pieces.
    """

    def __init__(self, n: int, k: int):
        self.k, self.bar, self.room = k, np.full(n, -np.inf), 2 * k * n + 2**16
        self.found, self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def least(self, rows: slice, values: np.ndarray) -> np.ndarray:
        """What a value of each of ``rows`` (values has a line for each) must reach."""
        bar = self.bar[rows]
        if values.shape[1] > self.k and np.isneginf(bar).any():
            np.maximum(bar, np.partition(values, -self.k, axis=1)[:, -self.k], out=bar)
        return bar

    def add(self, rows: np.ndarray, others: np.ndarray, value: np.ndarray) -> None:
        self.found.append(_first(rows, others, value, self.k))
        self.held += len(self.found[-1][0])
        if self.held > self.room:
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, others and values of what is held, rows in order, their values falling."""
        rows, others, value = _first(*map(np.concatenate, zip(*self.found, strict=True)), self.k)
        self.found, self.held = [(rows, others, value)], len(rows)
        last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)[: len(rows)])
        full = last[np.bincount(rows, minlength=len(self.bar))[rows[last]] == self.k]
        self.bar[rows[full]] = np.maximum(self.bar[rows[full]], value[full])
        return rows, others, value


def _neighbours(ids: tuple[np.ndarray, ...], best: list[_Best], name: str, sign: float = 1.0) -> pa.Table:
    """(id, other, value) of what is held for the rows of each side."""
    found = [(own[rows], others, sign * value) for own, (rows, others, value) in zip(ids, (held.all() for held in best), strict=False)]
    a, b, value = map(np.concatenate, zip(*found, strict=True))
    return pa.table({"id": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), name: pa.array(value, pa.float64())})


def knn(vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest other rows of each row by cosine (id, vector of one length; zero vectors have no neighbours), exact.

    Rows are dealt to blocks by their number; each pair of blocks is one key, taken once for
    both, and keeps k neighbours a row, so what is shuffled on is k rows for each row and block.
    Products of whole pieces only tell who can be among the k; those are worked out one by
    one, so that equal vectors tie wherever they lie.
    """
    size = F.sqrt(dot("vector", "vector"))
    real = vectors.withColumn("size", size).where("size > 0").select("id", "vector")

    def nearest(tile: pa.Table) -> pa.Table:
        mine, theirs, one = _ends(tile)
        sides = []
        for part in (mine, theirs):
            v = _flat(part.column("vector"))
            sides.append((part.column("id").to_numpy(), v / np.sqrt(_dots(v, v, np.arange(len(v)), np.arange(len(v))))[:, None]))
        (ids, x), (others, y) = sides
        best = [_Best(len(x), k)] if one else [_Best(len(x), k), _Best(len(y), k)]
        for p, q in _pieces(len(x), len(y)):
            cosine = x[p] @ y[q].T
            cosine[np.isnan(cosine) | (ids[p, None] == others[None, q])] = -np.inf
            for held, rows, far, values in ((best[0], p, others[q], cosine), (best[-1], q, ids[p], cosine.T))[: len(best)]:
                i, j = np.nonzero((values >= held.least(rows, values)[:, None] - 1e-9) & (values > -np.inf))
                value = _dots(x[p], y[q], i, j) if values is cosine else _dots(y[q], x[p], i, j)
                held.add(i + rows.start, far[j], value)
        return _neighbours((ids, others), best, "cosine")

    pairs = _block_pairs(real).groupBy("row", "col").applyInArrow(nearest, "id long, other long, cosine double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other"))
    return pairs.withColumn("rn", rank.cast("long")).where(F.col("rn") <= k)


def undirected(pairs: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Edges src < dst, once each, with the largest weight given to them."""
    return pairs.groupBy(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(F.max(weight).alias("weight")).where("src <> dst")


def sparsified(edges: DataFrame, k: int) -> DataFrame:
    """Edges that are among the k heaviest of either end."""
    ends = edges.select(F.col("src").alias("node"), "src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("node"), "src", "dst", "weight"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("weight").desc(), "src", "dst"))
    return ends.withColumn("rn", rank).where(F.col("rn") <= k).select("src", "dst", "weight").distinct()


def min_degree(edges: DataFrame, least: int, rounds: int = 5, row: str = "row_id", col: str = "col_id") -> DataFrame:
    """Edges left after up to ``rounds`` rounds that drop nodes of too low degree on both sides at once; ends when a round drops none.

    Degrees are counted with partial sums and joined back, so no node's edges gather in one task.
    """
    now = checkpointed(edges)
    n = now.count()
    for _ in range(rounds):
        kept = [now.groupBy(c).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(c) for c in (row, col)]
        now = checkpointed(now.join(kept[0], row, "left_semi").join(kept[1], col, "left_semi"))
        before, n = n, now.count()
        if n == before:
            break
    return now


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least node reachable. Least labels travel along edges, then jump to their label's label."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = checkpointed(both)
    now = checkpointed(nodes.select("id", F.col("id").alias("component")))
    for _ in range(MOST_ROUNDS):
        near = both.join(now, both["dst"] == now["id"]).groupBy("src").agg(F.min("component").alias("near"))
        met = now.join(near, now["id"] == near["src"], "left").select("id", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        jump = now.select(F.col("id").alias("_id"), F.col("component").alias("further"))
        met = met.join(jump, F.col("component") == F.col("_id"), "left").select("id", F.least("component", "further").alias("component"), "before")
        met = checkpointed(met)
        now = met.select("id", "component")
        if met.where("component <> before").isEmpty():
            return now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: sum over communities of inner weight / m - gamma * (degree / 2m) squared."""
    named = labels.select(F.col("id").alias("_id"), "label")
    first = edges.join(named.select(F.col("_id").alias("src"), F.col("label").alias("a")), "src").join(named.select(F.col("_id").alias("dst"), F.col("label").alias("b")), "dst")
    sides = first.select(F.explode(F.array(F.struct(F.col("a").alias("label"), "weight", F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0).alias("inner")), F.struct(F.col("b").alias("label"), "weight", F.lit(0.0).alias("inner")))).alias("s")).select("s.*")
    by = sides.groupBy("label").agg(F.sum("weight").alias("degree"), F.sum("inner").alias("inner"))
    total = by.agg((F.sum("degree") / 2).alias("m"))
    return by.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inner") / F.col("m") - gamma * F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("modularity"))


def _label_sums(gap: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Sums of a row's distances by label (numbers below k)."""
    order = np.argsort(labels, kind="stable")
    there, start = np.unique(labels[order], return_index=True)
    out = np.zeros((len(gap), k))
    if len(there):
        out[:, there] = np.add.reduceat(gap[:, order], start, axis=1)
    return out


def silhouette(points: DataFrame) -> DataFrame:
    """Mean euclidean silhouette of (id, vector, label), exact; single members score 0.

    Each pair of blocks is one task that sums its distances by row and label, for both of them.
    """
    rows = points.select("id", "vector", F.col("label").cast("long").alias("label"))
    known = rows.select("label").distinct().count()

    def summed(tile: pa.Table) -> pa.Table:
        mine, theirs, one = _ends(tile)
        sides = []
        for part in (mine, theirs):
            names, which = np.unique(part.column("label").to_numpy(), return_inverse=True)
            sides.append((part.column("id").to_numpy(), _flat(part.column("vector")), part.column("label").to_numpy(), names, which))
        (ids, x, own, names, which), (others, y, far, theirs_names, theirs_which) = sides
        total, back = np.zeros((len(ids), len(theirs_names))), np.zeros((len(others), len(names)))
        same = np.zeros((len(ids), len(theirs_names)), np.int64)
        for p, q in _pieces(len(x), len(y)):
            gap = _gaps(x[p], y[q])
            i, j = np.nonzero(ids[p, None] == others[None, q]) if one else (np.zeros(0, np.int64),) * 2
            gap[i, j] = 0.0
            np.add.at(same, (i + p.start, theirs_which[q][j]), 1)
            total[p] += _label_sums(gap, theirs_which[q], len(theirs_names))
            if not one:
                back[q] += _label_sums(gap.T, which[p], len(names))

        def table(ids, own, total, n, names):
            return [np.repeat(ids, len(names)), np.repeat(own, len(names)), np.tile(names, len(ids)), total.reshape(-1), n.reshape(-1)]

        out = [table(ids, own, total, np.bincount(theirs_which, minlength=len(theirs_names))[None, :] - same, theirs_names)]
        if not one:
            out.append(table(others, far, back, np.repeat(np.bincount(which, minlength=len(names))[None, :], len(others), axis=0), names))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("id", "label", "theirs", "gap", "n"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)})

    sums = _block_pairs(rows, known).groupBy("row", "col").applyInArrow(summed, "id long, label long, theirs long, gap double, n long")
    sums = sums.groupBy("id", "label", "theirs").agg((F.sum("gap") / F.when(F.sum("n") > 0, F.sum("n"))).alias("gap"))
    own = F.max(F.when(F.col("label") == F.col("theirs"), F.col("gap")))
    near = F.min(F.when(F.col("label") != F.col("theirs"), F.col("gap")))
    scored = sums.groupBy("id", "label").agg(own.alias("a"), near.alias("b"))
    return scored.agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings of the same rows."""
    two = lambda c: F.sum(c * (c - 1) / 2)
    cells = labels.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(two(F.col("n")).alias("both"), F.sum("n").alias("n"))
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("left"))
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("right"))
    joined = both.crossJoin(left).crossJoin(right).withColumn("chance", F.col("left") * F.col("right") / (F.col("n") * (F.col("n") - 1) / 2))
    most = (F.col("left") + F.col("right")) / 2
    return joined.select(F.when(most == F.col("chance"), 1.0).otherwise((F.col("both") - F.col("chance")) / (most - F.col("chance"))).alias("ari"))


def _local_moves(both: DataFrame, degree: DataFrame, twice: float, gamma: float, rounds: int) -> DataFrame:
    """(id, label) of the nodes in ``degree`` after rounds of moves to the neighbouring community of the largest gain."""
    now = checkpointed(degree.select("id", F.col("id").alias("label")))
    for r in range(rounds):
        held = now.join(degree, "id")
        mass = held.groupBy("label").agg(F.sum("degree").alias("mass"))
        links = both.join(now, both["dst"] == now["id"]).groupBy(F.col("src").alias("id"), F.col("label").alias("to")).agg(F.sum("weight").alias("links"))
        options = links.unionByName(now.select("id", F.col("label").alias("to"), F.lit(0.0).alias("links"))).groupBy("id", "to").agg(F.sum("links").alias("links"))
        options = options.join(held, "id").join(mass.withColumnRenamed("label", "to"), "to")
        others = F.col("mass") - F.when(F.col("to") == F.col("label"), F.col("degree")).otherwise(0.0)
        gain = F.round(F.col("links") - gamma * F.col("degree") * others / twice, 9)
        best = options.groupBy("id").agg(F.max_by("to", F.struct(gain, F.col("to") == F.col("label"), -F.col("to"))).alias("best"))
        turn = F.pmod(F.xxhash64(F.col("id"), F.lit(r)), F.lit(2)) == 0
        moved = now.join(best, "id", "left").select("id", F.when(turn, F.coalesce("best", "label")).otherwise(F.col("label")).alias("label"), F.col("label").alias("before"))
        moved = checkpointed(moved)
        now = moved.select("id", "label")
        if r > 1 and moved.where("label <> before").isEmpty():
            break
    return now


def communities(nodes: DataFrame, edges: DataFrame, gamma: float = 1.0, rounds: int = 12, levels: int = 3) -> DataFrame:
    """(id, label) by local moves that raise modularity, then the same over whole communities.

    A move gains w(node, c) - gamma * degree * degree(c) / 2m.  In each round half of
    the nodes, drawn by hash, move, which keeps pairs from swapping for ever.
    Nodes without edges keep their own label.
    """
    both = checkpointed(edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    degree = checkpointed(both.groupBy("src").agg(F.sum("weight").alias("degree")).withColumnRenamed("src", "id"))
    twice = degree.agg(F.sum("degree")).first()[0] or 1.0
    labels = nodes.select("id", F.col("id").alias("label"))
    for _ in range(levels):
        found = _local_moves(both, degree, twice, gamma, rounds)
        found = found.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
        labels = checkpointed(labels.join(found, F.col("label") == F.col("_id"), "left").select("id", F.coalesce("_label", "label").alias("label")))
        if found.where("_id <> _label").isEmpty():
            break
        ends = [found.select(F.col("_id").alias(end), F.col("_label").alias(f"_{end}")) for end in ("src", "dst")]
        both = both.join(ends[0], "src").join(ends[1], "dst").where("_src <> _dst").groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.sum("weight").alias("weight"))
        both = checkpointed(both)
        degree = checkpointed(degree.join(found, F.col("id") == F.col("_id")).groupBy(F.col("_label").alias("id")).agg(F.sum("degree").alias("degree")))
    return labels


def sweep(nodes: DataFrame, edges: DataFrame, gammas: list[float]) -> DataFrame:
    """Communities and modularity for each gamma, one row each."""
    spark: SparkSession = nodes.sparkSession
    rows = []
    for gamma in gammas:
        found = communities(nodes, edges, gamma)
        n = found.select("label").distinct().count()
        rows.append((float(gamma), n, modularity(edges, found).first()[0]))
    return spark.createDataFrame(rows, "gamma double, communities long, modularity double")
