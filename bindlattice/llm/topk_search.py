"""Exact top-k search by tiled integer matrix products.

Vectors are turned into integers floor(256 * x) and packed: each input partition
becomes shards of at most SHARD rows, the queries become blocks of at most BLOCK
rows, both written to the shared folder and numbered.  A tile is a block, of which
there are far fewer, sent to a shard; GROUP blocks share a key with one copy of the
shard.  A tile is one matrix product, of which the k best candidates a query are kept by
partial selection.  The tiles' lists of a block are merged by a tree, FAN lists a node,
level by level.  A task holds one tile, or two
lists of one block, at a time; nothing is broadcast.

Defined results: a vector that is null, or holds a null, nan or infinity, takes no
part; vectors meet those of the same length only; a row never meets rows with its
own id; ties go to the smaller id; repeated candidates count as often as they
occur, repeated queries once; null ids take no part; no queries give no rows;
other columns are not read.
Components beyond the range of a long are held at its ends, and so are scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindlattice.llm.common import arrow_map, batch, quoted, read, stage

SHARD, BLOCK, GROUP = 8192, 2048, 16
SCALE = 256
_TOP = float(1 << 62)
#: Lists that one node of the merging tree takes in.
FAN = 8
_PACKED = "width int, n int, ids binary, vectors binary"
_LISTS = "block long, query binary, ids binary, scores binary"


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) to packed rows of at most ``most`` vectors of one length."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def put(width: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        return batch(
            width=pa.array([width], pa.int32()), n=pa.array([len(ids)], pa.int32()),
            ids=pa.array([ids[order].tobytes()], pa.binary()), vectors=pa.array([vectors[order].tobytes()], pa.binary()),
        )

    for b in batches:
        ids = np.asarray(b.column(0))
        lists = b.column(1)
        sizes = np.asarray(lists.value_lengths())
        flat = np.asarray(lists.flatten().cast(pa.float64()))
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        for width in np.unique(sizes):
            rows = np.flatnonzero(sizes == width)
            values = flat[first[rows][:, None] + np.arange(width)] if width else np.zeros((len(rows), 0))
            whole = np.clip(np.floor(values * SCALE), -_TOP, _TOP).astype(np.int64)
            kept = held.setdefault(int(width), [])
            kept.append((ids[rows], whole))
            if sum(len(x) for x, _ in kept) >= most:
                ids_now, vectors = np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept])
                full = len(ids_now) // most * most
                for i in range(0, full, most):
                    yield put(int(width), ids_now[i : i + most], vectors[i : i + most])
                held[int(width)] = [(ids_now[full:], vectors[full:])]
    for width, kept in held.items():
        if sum(len(x) for x, _ in kept):
            yield put(width, np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products, exact; in double precision while every partial sum is an exact integer."""
    width = q.shape[1]
    if not width:
        return np.zeros((len(q), len(c)), np.int64)
    most = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(c).max(initial=0)), 1.0) * width
    if most < 2**52:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best allowed columns of each row; ids ascend, so of equal scores the first columns win."""
    n = scores.shape[1]
    if n > k:
        # The k-th best score of each row by partial selection; columns above it, and ties in order as far as they go.
        lowest = np.iinfo(np.int64).min
        shown = np.where(allowed, scores, lowest)
        cut = np.partition(shown, n - k, axis=1)[:, n - k]
        above = (shown > cut[:, None]) & allowed
        level = (shown == cut[:, None]) & allowed
        level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1)[:, None]
        allowed = above | level
    row, column = np.nonzero(allowed)
    return row, ids[column], scores[row, column]


def merged(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query; equal scores by id."""
    order = np.lexsort((ids, ~scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], ids[kept], scores[kept]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Top lists of tiles, a row a tile: its block, and queries, ids and scores."""
    for b in batches:
        for width, block, q_ids, q_raw, c_ids, c_raw in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            qi, ci = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
            q, c = np.frombuffer(q_raw, np.int64).reshape(len(qi), width), np.frombuffer(c_raw, np.int64).reshape(len(ci), width)
            found = []
            for i in range(0, len(qi), 256):
                part = qi[i : i + 256]
                row, ids, scores = _best(_scores(q[i : i + 256], c), ci, part[:, None] != ci[None, :], k)
                found.append((part[row], ids, scores))
            yield _list_row(block, *merged(*(np.concatenate(x) for x in zip(*found, strict=True)), k))


def _list_row(block: int, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return batch(block=pa.array([block], pa.int64()), query=pa.array([query.tobytes()], pa.binary()), ids=pa.array([ids.tobytes()], pa.binary()), scores=pa.array([scores.tobytes()], pa.binary()))


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Lists come by block and node; those of a node are merged as they come, so a task holds one block's lists."""
    at: tuple[int, int] | None = None
    own: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for b in batches:
        for block, node, *blobs in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            lists = tuple(np.frombuffer(x, np.int64) for x in blobs)
            if (block, node) != at:
                if own is not None:
                    yield _list_row(at[0], *own)
                at, own = (block, node), lists
            else:
                own = merged(*(np.concatenate(x) for x in zip(own, lists, strict=True)), k)
    if own is not None:
        yield _list_row(at[0], *own)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for query, ids, scores in zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True):
            query = np.frombuffer(query, np.int64)
            rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
            yield batch(query_id=pa.array(query), rank=pa.array(rank.astype(np.int32)), vec_id=pa.array(np.frombuffer(ids, np.int64)), score=pa.array(np.frombuffer(scores, np.int64)))


def _numbered(packed: DataFrame, name: str) -> tuple[DataFrame, dict[int, int]]:
    """Packed rows with numbers from 0 within each width, and how many each width has; the table has one row for many vectors."""
    packed = stage(packed.withColumn("key", F.monotonically_increasing_id()), f"{name}-packed")
    number = F.row_number().over(Window.partitionBy("width").orderBy("key")) - 1
    keys = packed.select("width", "key").withColumn("number", number.cast("long"))
    numbered = stage(packed.join(keys.select("key", "number"), "key").drop("key"), name)
    return numbered, {r["width"]: r["n"] for r in numbered.groupBy("width").agg(F.count("*").alias("n")).collect()}


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query."""
    sound = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = sound.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite)
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards, _ = _numbered(arrow_map(sound.select("id", "vector"), partial(_pack, most=SHARD), _PACKED), "shards")
    asked = sound.where("asks").select("id", "vector").dropDuplicates(["id"])
    blocks, counts = _numbered(arrow_map(asked, partial(_pack, most=BLOCK), _PACKED), "blocks")
    sizes = {r["width"]: r["n"] for r in shards.groupBy("width").agg(F.count("*").alias("n")).collect()}
    # Every block is sent to every shard of its width, and a shard once to each GROUP of blocks, so a key holds GROUP tiles at most.
    of_width = lambda counts: F.coalesce(*(F.when(F.col("width") == w, F.lit(n)) for w, n in counts.items()), F.lit(0))
    each = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    sent = shards.select("width", F.col("number").alias("shard"), each(F.ceil(of_width(counts) / GROUP)).alias("group"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"))
    asks = blocks.select("width", each(of_width(sizes)).alias("shard"), F.floor(F.col("number") / GROUP).alias("group"), F.col("number").alias("block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    tiles = asks.join(sent.hint("merge"), ["width", "shard", "group"])
    block_key = F.xxhash64("width", "block")
    lists = arrow_map(tiles.select("width", block_key.alias("block"), "q_ids", "q_vectors", "c_ids", "c_vectors"), partial(_search, k=k), _LISTS)
    lists = stage(lists.withColumn("place", F.monotonically_increasing_id()), "lists")
    most = lists.groupBy("block").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    # The tree: FAN lists of a block become one, level by level.
    while most > 1:
        rank = (F.row_number().over(Window.partitionBy("block").orderBy("place")) - 1) / FAN
        keys = lists.select("block", "place").withColumn("node", F.floor(rank))
        dealt = lists.join(keys.select("place", "node"), "place").repartition(tasks, "block", "node").sortWithinPartitions("block", "node")
        merged_lists = arrow_map(dealt.select("block", "node", "query", "ids", "scores"), partial(_merge, k=k), _LISTS)
        lists = stage(merged_lists.withColumn("place", F.monotonically_increasing_id()), f"lists{most}")
        most = -(-most // FAN)
    return arrow_map(lists.select("block", "query", "ids", "scores"), _listed, "query_id long, rank int, vec_id long, score long")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5
"""
