"""Token ids as binary files: frequency ranks in byte-aligned variable-length coding.

Plan
----
1. One pass over the texts encodes them.  A tokenizer that splits at white space
   gives a text the ids of its words in a row, so each distinct word of a slice is
   encoded once, and any other tokenizer is given whole texts; ids are written to the shared folder, compressed.
2. Id counts are summed over all documents; ids are ranked by falling count, then
   by id.  The table has one row an id of the vocabulary.
3. Documents are range-partitioned by doc_id and sorted; each partition is written
   as blocks: a control byte holds the lengths (1 to 4 bytes) of four ranks, the
   data bytes follow little-endian in a second stream.  Blocks travel in Parquet
   files, which any file system that Spark knows can hold; a directory
   ``dictionary`` keeps the ranks.
4. Reading decodes whole blocks with table lookups: control bytes to lengths,
   lengths to masks, ranks to ids.  Sums by partition give each document's start.

Defined results: a null or empty text has the end id alone; null doc_ids come
first; rows that share a doc_id lie side by side, ordered by their ids' bytes; an
empty table gives no rows; texts of any length are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindlattice.llm import textkit
from bindlattice.llm.common import arrow_map, batch, new_folder, quoted, read, stage

END_ID = 2
BLOCK_IDS = 1 << 16
#: Words whose ids a Python worker keeps at hand, about 60 bytes each.
CACHE_WORDS = 600_000
SLICE_BYTES = 2 << 20
_BLOCKS = "part int, block int, before long, n_ids long, doc_ids binary, nulls binary, lengths binary, control binary, data binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts, word by word, for tokenizers that split at white space; whole texts for others.

    Probes show whether the tokenizer splits, and where it sets a full stop or comma
    at a word's end apart, and lower-cases, words are looked up without either.
    Known words lie in sorted arrays: hash, place and number of their ids, place and
    number of their bytes.  Each occurrence of a word is held against the bytes of
    the known one; a text in which one differs is encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        probes = ("a", "on", "word", "thstring", "qzxv", "it's", "Été.", "<|x|>")
        self._splits = all(self._ids(p + gap + q) == self._ids(p) + self._ids(q) and self._ids(gap + p + gap) == self._ids(p) for p in probes for q in probes for gap in (" ", "  ", "\n", "\t", "\r\n", "\x0b\x0c"))
        self._parts = all(self._ids(p + x) == self._ids(p) + self._ids(x) for p in probes[:5] for x in ".,")
        self._lower = all(self._ids(p.upper()) == self._ids(p) == self._ids(p.title()) for p in probes[:5])
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self._encode([text], add_special_tokens=False)[0].ids

    def _clear(self) -> None:
        self._known = np.zeros(0, np.uint64)
        self._place, self._size, self._at, self._length = (np.zeros(0, np.int64) for _ in range(4))
        self._flat, self._bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _learn(self, raw: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encode the words that are not known yet; hashes ascend."""
        if len(self._known) > CACHE_WORDS:
            self._clear()
        spot = np.searchsorted(self._known, hashes)
        there = np.zeros(len(hashes), bool)
        inside = spot < len(self._known)
        there[inside] = self._known[spot[inside]] == hashes[inside]
        new = np.flatnonzero(~there)
        if not len(new):
            return
        data = raw.tobytes()
        pieces = [data[i:j] for i, j in zip(start[new].tolist(), end[new].tolist(), strict=True)]
        found = [e.ids for e in self._encode([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]
        sizes, lengths = np.fromiter(map(len, found), np.int64, len(found)), end[new] - start[new]
        columns = ((self._known, hashes[new]), (self._place, len(self._flat) + np.cumsum(sizes) - sizes), (self._size, sizes), (self._at, len(self._bytes) + np.cumsum(lengths) - lengths), (self._length, lengths))
        self._known, self._place, self._size, self._at, self._length = (np.insert(x, spot[new], y) for x, y in columns)
        self._flat = np.concatenate((self._flat, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))))
        self._bytes = np.concatenate((self._bytes, np.frombuffer(b"".join(pieces), np.uint8)))

    def _words(self, part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end, before = textkit.words(part, at)
        if not self._parts or not len(start):
            return start, end, before
        last, ahead = part[end - 1], part[np.maximum(end - 2, 0)] | 32
        cut = (end - start > 1) & ((last == 46) | (last == 44)) & (ahead >= 97) & (ahead <= 122)
        shift = np.concatenate(([0], np.cumsum(cut)))
        starts, ends = np.concatenate((start, end[cut] - 1)), np.concatenate((end - cut, end[cut]))
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order], before + shift[before]

    def _differing(self, part: np.ndarray, start: np.ndarray, end: np.ndarray, known: np.ndarray, exact: np.ndarray) -> np.ndarray:
        """Words whose bytes, or lower-cased bytes where that is enough, are not those of the known word with their hash."""
        size = end - start
        differ = size != self._length[known]
        same = np.flatnonzero(~differ)
        size = size[same]
        till = np.cumsum(size)
        inner = np.arange(till[-1] if len(till) else 0) - np.repeat(till - size, size)
        mine, its = part[np.repeat(start[same], size) + inner], self._bytes[np.repeat(self._at[known[same]], size) + inner]
        unequal = mine != its
        if self._lower and unequal.any():
            unequal &= np.repeat(exact[same], size) | (textkit.lower_bytes(mine) != textkit.lower_bytes(its))
        if unequal.any():
            differ[same[np.searchsorted(till, np.flatnonzero(unequal), "right")]] = True
        return np.flatnonzero(differ)

    def encode(self, column: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        raw, offsets = textkit.buffers(column)
        for i, j in textkit.slices(offsets, SLICE_BYTES):
            part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            whole = lambda k, part=part, at=at: np.array([*self._ids(part[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace")), end_id], np.uint32)
            if not self._splits:
                yield from map(whole, range(j - i))
                continue
            start, end, before = self._words(part, at)
            keys = textkit.word_hashes(part, start, end, lower=self._lower)
            exact = np.zeros(len(start), bool)
            if self._lower and (part == 60).any():
                # Control strings are told apart by case.
                held = np.concatenate(([0], np.cumsum(part == 60)))
                exact = held[end] > held[start]
                odd = np.flatnonzero(exact)
                keys[odd] = textkit.mix(textkit.word_hashes(part, start[odd], end[odd], lower=False) + np.uint64(1))
            hashes, first, which = np.unique(keys, return_index=True, return_inverse=True)
            self._learn(part, hashes, start[first], end[first])
            spot = np.searchsorted(self._known, hashes)
            sizes, origin = self._size[spot], self._place[spot]
            per_word = sizes[which]
            till = np.concatenate(([0], np.cumsum(per_word)))
            found = self._flat[np.repeat(origin[which] - till[:-1], per_word) + np.arange(till[-1])]
            odd = set(np.searchsorted(before, self._differing(part, start, end, spot[which], exact), "right") - 1)
            for k in range(j - i):
                yield whole(k) if k in odd else np.append(found[till[before[k]] : till[before[k + 1]]], np.uint32(end_id))


_ENCODERS: dict[str, WordEncoder] = {}


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        ids = [x for x in _ENCODERS[path].encode(b.column(1), end_id)]
        # Two planes of bytes compress better than whole ids.
        packed = [pack(x.view(np.uint8).reshape(-1, 4).T.tobytes()) for x in ids]
        yield batch(doc_id=b.column(0), ids=pa.array(packed, pa.binary()))


def _unpacked(column: pa.Array) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    for x in column.to_pylist():
        planes = np.frombuffer(unpack(x), np.uint8).reshape(4, -1)
        yield np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        for ids in _unpacked(b.column(0)):
            n = np.bincount(ids)
            if len(n) > len(total):
                total = np.concatenate((total, np.zeros(2 * len(n) - len(total), np.int64)))
            total[: len(n)] += n
    seen = np.flatnonzero(total)
    yield batch(id=pa.array(seen), n=pa.array(total[seen]))


_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])[None, :] & 3).astype(np.uint8) + np.uint8(1)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype(np.uint32)
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4)[None, :] <= code[:, None]
    return control.tobytes(), np.ascontiguousarray(ranks).view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = raw[start] if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        out = out | raw[start + k] << np.uint32(8 * k)
    return out & _MASKS[lengths]


def _write(batches: Iterator[pa.RecordBatch], rank_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    part, block, before = TaskContext.get().partitionId(), 0, 0
    docs: list[int | None] = []
    runs: list[np.ndarray] = []
    held = 0

    def put() -> pa.RecordBatch:
        control, data = encode_ranks(rank_of[np.concatenate(runs)])
        return batch(
            part=pa.array([part], pa.int32()), block=pa.array([block], pa.int32()), before=pa.array([before]), n_ids=pa.array([held]),
            doc_ids=pa.array([np.array([d or 0 for d in docs], np.int64).tobytes()]), nulls=pa.array([np.array([d is None for d in docs]).tobytes()]),
            lengths=pa.array([np.fromiter(map(len, runs), np.int64, len(runs)).tobytes()]), control=pa.array([control]), data=pa.array([data]),
        )

    for b in batches:
        for doc, ids in zip(b.column(0).to_pylist(), _unpacked(b.column(1)), strict=True):
            docs.append(doc), runs.append(ids)
            held += len(ids)
            if held >= BLOCK_IDS:
                yield put()
                block, before, docs, runs, held = block + 1, before + held, [], [], 0
    if runs:
        yield put()


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every text and write the blocks and the dictionary under ``path``."""
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    encoded = stage(arrow_map(rows, partial(_tokenize, path=tokenizer or default_tokenizer(), end_id=end_id), "doc_id long, ids binary"), "ids")
    counts = arrow_map(encoded.select("ids"), _count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))  # one row an id of the vocabulary
    rank_of = np.zeros(max((r["id"] for r in ranked), default=0) + 1, np.uint32)
    for rank, r in enumerate(ranked):
        rank_of[r["id"]] = rank
    spark = docs.sparkSession
    table = pa.table({"rank": pa.array(range(len(ranked)), pa.int64()), "id": pa.array([r["id"] for r in ranked], pa.int64()), "n": pa.array([r["n"] for r in ranked], pa.int64())})
    spark.createDataFrame(table.to_pandas(), "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/dictionary")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(tasks, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    arrow_map(ordered, partial(_write, rank_of=rank_of), _BLOCKS).write.parquet(f"{path}/blocks")


def _decode(batches: Iterator[pa.RecordBatch], id_of: np.ndarray, digest: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, before, n, docs, nulls, lengths, control, data in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
            ids = id_of[decode_ranks(control, data, n)]
            sizes = np.frombuffer(lengths, np.int64)
            till = np.cumsum(sizes)
            columns = {
                "part": pa.array(np.full(len(sizes), part, np.int32)), "doc_id": pa.array(np.frombuffer(docs, np.int64), mask=np.frombuffer(nulls, np.bool_)),
                "before": pa.array(till - sizes + before), "n_tokens": pa.array(sizes),
            }
            runs = np.split(ids, till[:-1])
            if digest:
                columns["ids_crc32"] = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in runs], pa.int64())
            else:
                columns["ids"] = pa.array([x.astype(np.int64) for x in runs], pa.list_(pa.int64()))
            yield batch(**columns)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids of each document (with ``digest`` their crc32) from files."""
    dictionary = spark.read.parquet(f"{path}/dictionary").select("rank", "id").toArrow()
    id_of = np.zeros(max(dictionary.num_rows, 1), np.uint32)
    id_of[dictionary.column("rank").to_numpy()] = dictionary.column("id").to_numpy()
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # One row a partition of the files.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    last = "ids_crc32 long" if digest else "ids array<long>"
    rows = arrow_map(
        blocks.select("part", "before", "n_ids", "doc_ids", "nulls", "lengths", "control", "data"), partial(_decode, id_of=id_of, digest=digest),
        f"part int, doc_id long, before long, n_tokens long, {last}",
    )
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32" if digest else "ids")


def tokens_of(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from files in the shared folder."""
    spark = docs.sparkSession
    path = new_folder(spark)
    write_token_files(docs, f"{path}/tokens")
    return read_token_files(spark, f"{path}/tokens", digest=True)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(read(spark, sf_dir, "documents"))
