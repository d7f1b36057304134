"""Vector codes: four codebooks fitted by rounds of exact nearest search, one byte a part.

Components become integers floor(1024 * x); a vector is cut into equal parts, and each
part position has a codebook of up to 256 entries, which starts as that part of the
vectors of the smallest ids.

A round
    A kd-tree per codebook is broadcast.  Each task carries its rows down the trees, a
    batch at a time: a node of which the bounding box is no farther away than the best
    entry so far is visited, equal distances included, so of entries at one distance
    the lower index wins wherever it lies in the tree.  A task adds up the parts of
    each entry and sends one row an entry, which the tasks of the next stage sum up;
    entries become floor(sum / count), unused ones stay.
Codes
    After the rounds every part gets the index of its nearest entry.

All sums and distances are exact integers: distances in double precision while every
one is below 2^53, in Python's integers otherwise; sums of components in two numbers,
of the upper and the lower 24 bits.

What is broadcast and what the driver holds is one set of codebooks: entries times the
length of a vector.

Defined results: vectors that are null or hold null, nan or infinite components are
dropped; components beyond +-2^48 are held there, and errors at the largest long;
vectors shorter than the longest, or than a multiple of the parts, end in zeros; null
ids come after all others in the choice of first entries, rows of one id in order of
their components; fewer rows than entries make shorter codebooks; equal rows get equal
codes, one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindlattice.llm.common import arrow_map, batch, quoted, read, small, stage

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries that a leaf of a tree holds, at most.
LEAF = 32
_TOP, _LOW_BITS, _LONG = 1 << 48, 24, (1 << 63) - 1
#: Distances below this are exact in double precision.
_EXACT = 1 << 53


@dataclass
class Node:
    """A box of entries: a leaf with their indexes, ascending, or two children."""

    low: np.ndarray
    high: np.ndarray
    index: np.ndarray
    children: tuple[Node, Node] | None


def kd_tree(entries: np.ndarray, index: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Entries split at the median of their widest component until a node holds ``leaf`` of them or only equal ones."""
    index = np.arange(len(entries)) if index is None else index
    own = entries[index]
    low, high = (own.min(axis=0), own.max(axis=0)) if own.size else (np.zeros(entries.shape[1], np.int64),) * 2
    if len(index) <= leaf or (low == high).all():
        return Node(low, high, np.sort(index), None)
    order = index[np.argsort(own[:, np.argmax(high - low)], kind="stable")]
    middle = len(order) // 2
    return Node(low, high, np.sort(index), (kd_tree(entries, order[:middle], leaf), kd_tree(entries, order[middle:], leaf)))


def _bound(points: np.ndarray, node: Node) -> np.ndarray:
    """Squared distances of points to the box of a node."""
    off = np.maximum(np.maximum(node.low - points, points - node.high), 0)
    return (off * off).sum(axis=1)


class Search:
    """Nearest entries of batches of points, the lower index of equals."""

    def __init__(self, entries: np.ndarray, tree: Node | None = None, leaf: int = LEAF) -> None:
        self.entries, self.tree = entries, tree or kd_tree(entries, leaf=leaf)
        self.most = float(np.abs(entries).max(initial=0))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each point."""
        # Twice the largest term of a difference, squared, bounds every product and sum below.
        reach = self.most + float(np.abs(points).max(initial=0))
        kind = np.float64 if 4 * reach * reach * max(points.shape[1], 1) < _EXACT else object
        points, entries = points.astype(kind), self.entries.astype(kind)
        best = np.full(len(points), np.inf) if kind is np.float64 else np.full(len(points), 1 << 200, object)
        found = np.full(len(points), len(entries), np.int64)
        norms = (points * points).sum(axis=1), (entries * entries).sum(axis=1)

        def visit(node: Node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if node.children is None:
                away = norms[0][rows][:, None] + norms[1][node.index][None, :] - 2 * (points[rows] @ entries[node.index].T)
                first = np.argmin(away, axis=1)
                near, at = away[np.arange(len(rows)), first], node.index[first]
                closer = (near < best[rows]) | ((near == best[rows]) & (at < found[rows]))
                best[rows[closer]], found[rows[closer]] = near[closer], at[closer]
                return
            bounds = [_bound(points[rows], child) for child in node.children]
            left_first = bounds[0] <= bounds[1]
            # The nearer child first; the other only where its box is no farther than the best found by then.
            for first, second, own in ((0, 1, left_first), (1, 0, ~left_first)):
                mine = np.flatnonzero(own)
                if not len(mine):
                    continue
                open_ = mine[bounds[first][mine] <= best[rows[mine]]]
                visit(node.children[first], rows[open_])
                open_ = mine[bounds[second][mine] <= best[rows[mine]]]
                visit(node.children[second], rows[open_])

        visit(self.tree, np.arange(len(points)))
        return found, best


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, ended by zeros."""
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    flat = np.asarray(lists.flatten())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _sums(batches: Iterator[pa.RecordBatch], trees: Broadcast, width: int) -> Iterator[pa.RecordBatch]:
    """One row an entry that a task's rows chose: how many did, and the sums of their parts."""
    searches: list[Search] = trees.value
    parts, entries, size = len(searches), len(searches[0].entries), width // len(searches)
    counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, 2 * size), np.int64)
    for b in batches:
        vectors = _matrix(b.column(0), width).reshape(b.num_rows, parts, size)
        for p, search in enumerate(searches):
            found, _ = search.nearest(vectors[:, p])
            counts[p] += np.bincount(found, minlength=entries)
            # Rows in order of their entry, so that each entry's run is added up at once.
            order = np.argsort(found, kind="stable")
            first = np.flatnonzero(np.diff(found[order], prepend=-1))
            ordered = vectors[order, p]
            split = np.concatenate((ordered >> _LOW_BITS, ordered & ((1 << _LOW_BITS) - 1)), axis=1)
            sums[p][found[order][first]] += np.add.reduceat(split, first, axis=0) if len(first) else 0
    at = np.argwhere(counts)
    if len(at):
        chosen = sums[at[:, 0], at[:, 1]]
        yield _sum_rows(at[:, 0] * entries + at[:, 1], counts[at[:, 0], at[:, 1]], chosen)


def _sum_rows(keys: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * sums.shape[1]
    return batch(entry=pa.array(keys.astype(np.int32)), n=pa.array(counts), sums=pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(sums).reshape(-1))))


def _totals(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows of equal entries added up; every row of an entry comes to one task, one row a task before."""
    held: dict[int, list] = {}
    for b in batches:
        keys, counts, sums = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(2), width)
        for i, key in enumerate(keys.tolist()):
            own = held.setdefault(key, [0, np.zeros(width, np.int64)])
            own[0] += int(counts[i])
            own[1] += sums[i]
    if held:
        yield _sum_rows(np.array(list(held)), np.array([n for n, _ in held.values()], np.int64), np.array([s for _, s in held.values()]))


def _codes(batches: Iterator[pa.RecordBatch], trees: Broadcast, width: int) -> Iterator[pa.RecordBatch]:
    searches: list[Search] = trees.value
    parts, size = len(searches), width // len(searches)
    digits = max(2, len(f"{len(searches[0].entries) - 1:x}"))
    for b in batches:
        vectors = _matrix(b.column(b.schema.get_field_index("vector")), width).reshape(b.num_rows, parts, size)
        found = [search.nearest(vectors[:, p]) for p, search in enumerate(searches)]
        error = [min(sum(map(int, each)), _LONG) for each in zip(*(away.tolist() for _, away in found), strict=True)]
        code = ["".join(f"{i:0{digits}x}" for i in each) for each in zip(*(at.tolist() for at, _ in found), strict=True)]
        yield batch(row=b.column(b.schema.get_field_index("row")), code=pa.array(code, pa.string()), error=pa.array(error, pa.int64()))


def _updated(books: list[np.ndarray], totals: list, size: int) -> list[np.ndarray]:
    """Entries as the floors of their means; entries that nothing chose stay."""
    out, entries = [b.copy() for b in books], len(books[0])
    for r in totals:
        sums = [(high << _LOW_BITS) + low for high, low in zip(r["sums"][:size], r["sums"][size:], strict=True)]
        out[r["entry"] // entries][r["entry"] % entries] = [s // r["n"] for s in sums]
    return out


def books_digest(books: list[np.ndarray]) -> str:
    """Hex sha256 of all components by part, entry and position, with commas between them."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def _whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform("vector", lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-float(_TOP))), F.lit(float(_TOP)))).cast("long"))
    return vectors.where(F.col("vector").isNotNull() & finite).withColumn("vector", held)


def fit_codebooks(whole: DataFrame, width: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebooks of the long vectors in ``whole`` (id, vector) after all rounds."""
    spark = whole.sparkSession
    first = whole.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    seeds = _matrix(first.column(0).combine_chunks(), width).reshape(first.num_rows, parts, width // parts)
    books = [np.ascontiguousarray(seeds[:, p]) for p in range(parts)]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([Search(book) for book in books])
        partial_sums = arrow_map(whole.select("vector"), partial(_sums, trees=trees, width=width), "entry int, n long, sums array<long>")
        dealt = partial_sums.repartition(min(tasks, parts * entries), "entry")
        totals = arrow_map(dealt, partial(_totals, width=2 * width // parts), "entry int, n long, sums array<long>").collect()
        books = _updated(books, totals, width // parts)
        trees.unpersist()
    return books


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (vec_id, label, code, error) of the vectors, and the codebooks."""
    spark = vectors.sparkSession
    named = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(label_col).alias("label"), quoted(vector_col).cast("array<double>").alias("vector"))
    whole = stage(_whole_numbers(named, scale), "vectors")
    longest = whole.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return whole.select(F.col("id").alias("vec_id"), "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), [np.zeros((0, 0), np.int64)] * parts
    width = -(-longest // parts) * parts
    books = fit_codebooks(whole, width, parts, entries, rounds)
    trees = spark.sparkContext.broadcast([Search(book) for book in books])
    row = F.struct("id", "label")
    coded = arrow_map(whole.select(row.alias("row"), "vector"), partial(_codes, trees=trees, width=width), f"row {whole.select(row.alias('row')).schema['row'].dataType.simpleString()}, code string, error long")
    return coded.select(F.col("row.id").alias("vec_id"), F.col("row.label").alias("label"), "code", "error"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(read(spark, sf_dir, "embeddings"))
    coded = stage(coded, "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    per_label, _ = small(stage(coded.groupBy("label").agg(total.alias("label_error")), "label-errors"))
    rows = coded.join(per_label.withColumnRenamed("label", "name"), F.col("label").eqNullSafe(F.col("name")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _op11_sql() -> str:
    """The same rounds as common table expressions, one of codes and one of entries each."""
    steps = [
        """v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
)""",
        """x AS MATERIALIZED (
  SELECT vec_id, label, p, e[p * len(e) // 4 + 1:(p + 1) * len(e) // 4] AS part FROM v, (SELECT unnest(range(4)) AS p) q
)""",
        """b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, part AS entry
  FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)
)""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""c{k} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, x.p, any_value(part) AS part,
    min(256 * CAST(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) + i) AS best
  FROM x JOIN b{k} b ON x.p = b.p GROUP BY vec_id, x.p
)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""s{k} AS (
  SELECT p, best % 256 AS i, j, CAST(sum(part[j + 1]) AS BIGINT) AS total, count(*) AS n
  FROM c{k}, (SELECT unnest(range((SELECT max(len(part)) FROM x))) AS j) w GROUP BY ALL
), m{k} AS (
  SELECT p, i, list((total - ((total % n) + n) % n) // n ORDER BY j) AS entry FROM s{k} GROUP BY p, i
), b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.i, coalesce(m.entry, b.entry) AS entry FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.i = m.i
)"""
            )
    steps.append(
        f"""r AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM c{ROUNDS} GROUP BY vec_id
)"""
    )
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, i)) FROM b{ROUNDS}) AS codebooks_sha256
FROM r
"""
    )


OP11_SQL = _op11_sql()
