"""Quality scores: histogram gradient-boosted trees over document statistics.

One pass over the texts computes the statistics of every document and writes them,
a few hundred bytes a document, to the shared folder.  The trees are fitted on the
driver from at most SAMPLE_DOCS labelled rows: features are cut into quantile bins,
each level of each tree adds up gradients per (node, feature, bin), and the trees
are complete, so they lie in flat arrays (feature, threshold, leaf value).  Scoring
reads the statistics and walks all trees level by level with numpy indexing.

Defined results: null, empty and wordless texts have all-zero statistics and a
score like any other; a sample with one class only scores all by its label,
without any label 0.5; a null doc_id is not held out and never trains; every row
gives one row; texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindlattice.llm import textkit
from bindlattice.llm.common import arrow_map, batch, crc_mod, quoted, read, stage
from bindlattice.llm.fit import Constant, labelled_sample

SAMPLE_DOCS = 10_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 80, 4, 64, 0.15, 1.0, 1.0

STATISTICS = (
    "log_bytes log_words mean_word std_word distinct_words top_word repeated_next distinct_shingles upper digit punctuation exclamation bar space "
    "non_ascii symbol log_lines distinct_lines mean_line short_lines top_byte byte_entropy url_bytes control brackets quotes"
).split()

_KIND = np.zeros((6, 256), np.float64)
_KIND[0, 0x41:0x5B] = 1
_KIND[1, 0x30:0x3A] = 1
_KIND[2, [ord(c) for c in ".,;:!?"]] = 1
_KIND[3, 0x80:] = 1
_KIND[4, [ord(c) for c in "#$%&*+-/<=>@\\^_`|~"]] = 1
_KIND[5, [c for c in range(32) if c not in (9, 10, 13)]] = 1


def statistics(raw: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """STATISTICS of one text: its bytes, its words' hashes and byte lengths."""
    out = np.zeros(len(STATISTICS))
    n, w = len(raw), len(hashes)
    if not w:
        return out
    seen = np.bincount(raw, minlength=256)
    share = seen / n
    _, counts = np.unique(hashes, return_counts=True)
    ends = np.flatnonzero(raw == 10)
    lines = np.diff(np.concatenate(([-1], ends, [n])))
    used = share[share > 0]
    upper, digit, marks, wide, symbols, control = _KIND @ share
    # Lines by length and byte sum: equal lines agree, most others do not.
    sums = np.concatenate(([0], np.cumsum(raw, dtype=np.int64)))
    bounds = np.concatenate(([0], ends + 1, [n]))
    keys = (sums[bounds[1:]] - sums[bounds[:-1]]) * 1_000_003 + lines
    out[:] = (
        np.log1p(n), np.log1p(w), sizes.mean(), sizes.std(), len(counts) / w, counts.max() / w,
        (hashes[1:] == hashes[:-1]).mean() if w > 1 else 0.0, len(textkit.shingles(hashes, 3)) / w, upper, digit, marks, share[33], share[124], share[32],
        wide, symbols, np.log1p(len(lines)), len(np.unique(keys)) / len(lines), np.log1p(lines.mean()), (lines < 30).mean(), share.max(),
        -(used * np.log2(used)).sum(), share[47], control, share[40] + share[41] + share[91] + share[93], share[34] + share[39],
    )
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offsets = textkit.buffers(b.column(2))
        rows = []
        for i, j in textkit.slices(offsets):
            part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            start, end, before = textkit.words(part, at)
            hashes, sizes = textkit.word_hashes(part, start, end), end - start
            rows += [statistics(part[at[k] : at[k + 1]], hashes[before[k] : before[k + 1]], sizes[before[k] : before[k + 1]]) for k in range(j - i)]
        yield batch(doc_id=b.column(0), held_out=b.column(1), x=pa.array([r.astype(np.float32) for r in rows], pa.list_(pa.float32())))


class Trees:
    """Complete trees of DEPTH levels in flat arrays; logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.column_stack([np.searchsorted(edges[f], x[:, f], "right") for f in range(width)])
        spread = 2**DEPTH - 1
        self.feature = np.zeros((TREES, spread), np.int64)
        self.threshold = np.full((TREES, spread), np.inf)
        self.value = np.zeros((TREES, spread + 1))
        share = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(n, self.base)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = weight * (p - y), weight * p * (1 - p) + 1e-12
            node = np.zeros(n, np.int64)
            for level in range(DEPTH):
                here, first = 2**level, 2**level - 1
                best = np.full(here, 1e-6)
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    cells = node * (BINS + 1) + binned[:, f]
                    g = np.bincount(cells, grad, here * (BINS + 1)).reshape(here, -1).cumsum(axis=1)
                    h = np.bincount(cells, hess, here * (BINS + 1)).reshape(here, -1).cumsum(axis=1)
                    total_g, total_h = g[:, -1:], h[:, -1:]
                    right_g, right_h = total_g - g, total_h - h
                    gain = g**2 / (h + RIDGE) + right_g**2 / (right_h + RIDGE) - total_g**2 / (total_h + RIDGE)
                    gain = np.where((h >= LEAST_WEIGHT) & (right_h >= LEAST_WEIGHT), gain, 0.0)[:, : len(edges[f])]
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(here), at]
                    better = np.flatnonzero(top > best)
                    best[better] = top[better]
                    self.feature[t, first + better] = f
                    self.threshold[t, first + better] = edges[f][at[better]]
                chosen = first + node
                node = 2 * node + (x[np.arange(n), self.feature[t, chosen]] >= self.threshold[t, chosen])
            g, h = np.bincount(node, grad, spread + 1), np.bincount(node, hess, spread + 1)
            self.value[t] = -RATE * g / (h + RIDGE)
            margin += self.value[t][node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for level in range(DEPTH):
            at = node + (2**level - 1)
            node = 2 * node + (x[rows, self.feature[trees, at]] >= self.threshold[trees, at])
        margin = self.base + self.value[trees, node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _score(batches: Iterator[pa.RecordBatch], model: object) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        x = np.asarray(b.column(2).flatten(), np.float64).reshape(-1, len(STATISTICS))
        score = np.concatenate([model.predict(x[i : i + 4096]) for i in range(0, len(x), 4096)])
        yield batch(doc_id=b.column(0), held_out=b.column(1), score=pa.array(score), predicted=pa.array((score >= THRESHOLD).astype(np.int32)))


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; held_out is an expression of doc_id."""
    held = crc_mod(F.col("doc_id"), 5) == 0 if held_out is None else held_out
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    rows = rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    described = stage(arrow_map(rows, _describe, "doc_id long, held_out boolean, x array<float>"), "statistics")
    known, totals = labelled_sample(described, labels, "quality", held, sample)
    got = known.select("label", "x").toArrow()
    y = np.asarray(got.column("label").to_numpy(), np.float64)
    if 0 < y.sum() < len(y):
        x = np.array(got.column("x").to_pylist(), np.float32).astype(np.float64)
        weight = np.where(y > 0, totals[1] / y.sum(), totals[0] / (len(y) - y.sum()))
        model: object = Trees(x, y, weight * len(y) / weight.sum())
    else:
        model = Constant(float(y[0]) if len(y) else 0.5)
    return arrow_map(described, partial(_score, model=model), "doc_id long, held_out boolean, score double, predicted int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
