"""Toxicity by compression distance: two zstandard dictionaries, window lengths, calibration.

Texts are lower-cased, and the first START bytes of every word are written in capitals,
so that a compressor tells how a word starts from what it holds.  A window is WINDOW
words, a new one every STEP words.

Fit (tasks, from at most SAMPLE_DOCS labelled rows of each class, of texts of at most
SAMPLE_BYTES bytes)
    Both dictionaries hold the language that the classes share, that is windows of one
    half of the ordinary texts, and end in a part that is trained on their own class by
    zstandard's trainer: the ordinary part on windows of the other half of the ordinary
    texts, the toxic part on windows of the toxic ones.  Both parts start from the words
    that the language compresses worst, and are trained anew in rounds on what the
    compressors tell apart.  A round takes the windows of each toxic text whose difference
    of compressed lengths is beyond almost all ordinary ones, and, for the other part, the
    ordinary windows that look most toxic; of each window it keeps the words without which
    the difference shrinks most.  Rounds alternate between two halves of the texts: what
    one half taught is tried on the other, so what only one text has, goes.  The two
    neighbouring rounds that tell unseen texts apart best make the parts.  Toxic texts that
    still look like most ordinary ones get another turn of their own, which is kept if it
    leaves fewer of them.  RESTARTS tasks do this, each from another draw of the halves;
    the one that tells unseen texts apart best is the model.
Score (executors, every text whole)
    Each window is compressed with either dictionary.  A document is described by how many
    of its windows reach each difference of the two lengths, plain and as a share of its
    windows.  The thresholds on these counts are calibrated on the sample by boosted trees
    and a logistic model, whose mean is the score.

``Bounds`` holds what bounds the fit besides the sample: bytes of the dictionaries, windows
that train, rounds and turns.  None of them bounds what is scored.

Defined results: null, empty and wordless texts get the score of a text without
windows; a text of fewer than WINDOW words is one window; a sample with one class
only scores all by its label, without any label 0.5; few toxic texts train like many, a
single one on all that there is; a null doc_id is not held out
and never trains; every row gives one row, repeats included; of a doc_id on several
rows one text trains; columns other than id and text are not read; texts of any
length are scored whole, a slice at a time.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindlattice.llm import textkit
from bindlattice.llm.common import arrow_map, batch, give_back, quoted, read, stage
from bindlattice.llm.fit import Constant, Logistic, Mean, held_out_third, labelled_sample
from bindlattice.llm.quality import Trees

SAMPLE_DOCS, SAMPLE_BYTES = 3000, 20_000
THRESHOLD = 0.7
WINDOW, STEP, START = 8, 4, 4
RESTARTS = 3


@dataclass(frozen=True)
class Bounds:
    """What bounds the fit besides the sample."""

    #: Bytes of the shared language, and of each class's part at the start and later.
    language_bytes: int = 1 << 19
    first_bytes: int = 4096
    part_bytes: int = 2048
    #: Bytes of a later part to each toxic text of the sample, so that few texts are not learnt by heart, and the least.
    bytes_to_text: int = 4
    least_bytes: int = 512
    rounds: int = 6
    turns: int = 3
    #: Share of ordinary texts that a toxic text must look more toxic than.
    untold: float = 0.97
    #: Share of ordinary windows below the difference beyond which a round takes windows, for its first rounds and the later ones.
    beyond: tuple[float, ...] = (0.98, 0.98, 0.99)
    #: Bytes by which the difference must shrink without a word.
    least_drop: int = 3
    #: Bytes of the words that the first parts are trained on, at least; shorter ones no compressor finds.
    least_word: int = 5
    #: Windows of the language and of the ordinary half at most, windows that the first parts take words from, and of one text there and in a round.
    language_windows: int = 100_000
    first_windows: int = 20_000
    text_windows: int = 64
    telling_windows: int = 4


#: Matches are sought up to eight bytes before a window's end.
STRATEGY = zstandard.STRATEGY_BTLAZY2
#: Differences that are told apart.
LEAST, MOST = -4, 20
_SHARES = slice(1 - LEAST, 8 - LEAST)
_CAPITAL = np.arange(256, dtype=np.uint8)
_CAPITAL[0x61:0x7B] -= 32


def prepared(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of some texts in lower case with word starts in capitals, (offset, length) of their windows, and windows before each text."""
    raw = textkit.lower_bytes(raw)
    start, end, before = textkit.words(raw, offsets)
    for k in range(START):
        at = start + k
        at = at[at < end]
        raw[at] = _CAPITAL[raw[at]]
    return raw, *windows(start, end, before)


def windows(start: np.ndarray, end: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offset, length) of the windows of some texts, given their words, and windows before each text."""
    n = np.diff(before)
    counts = np.where(n > 0, -(-np.maximum(n - WINDOW + STEP, 1) // STEP), 0)
    till = np.concatenate(([0], np.cumsum(counts)))
    first = np.repeat(before[:-1] - till[:-1] * STEP, counts) + np.arange(till[-1]) * STEP
    last = np.minimum(first + WINDOW, np.repeat(before[1:], counts)) - 1
    return np.stack((start[first], end[last] - start[first]), axis=1), till


def _trained(samples: list[bytes], size: int, segment: int = 16) -> bytes:
    """The last ``size`` bytes of a dictionary trained on samples, without its header; plain text where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size + 512, samples, d=6, k=segment).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


class Compressor:
    """Compressed lengths of windows under one dictionary."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        self._ready: zstandard.ZstdCompressor | None = None

    def __reduce__(self) -> tuple:
        return Compressor, (self.content,)

    def lengths(self, raw: bytes, spans: np.ndarray) -> np.ndarray:
        if self._ready is None:
            tables = 17 if len(self.content) > 1 << 16 else 14
            parameters = zstandard.ZstdCompressionParameters(
                window_log=20, chain_log=tables, hash_log=tables, search_log=5, min_match=6, target_length=64, strategy=STRATEGY, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            kept = zstandard.ZstdCompressionDict(self.content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(compression_params=parameters)
            self._ready = zstandard.ZstdCompressor(dict_data=kept, compression_params=parameters)
        out = np.zeros(len(spans), np.int64)
        for i in range(0, len(spans), 50_000):
            part = np.ascontiguousarray(spans[i : i + 50_000], "<u8")
            out[i : i + len(part)] = [len(x) for x in self._ready.multi_compress_to_buffer(zstandard.BufferWithSegments(raw, part.tobytes()))]
        return out


class Windows:
    """Distinct windows of some texts in one buffer."""

    def __init__(self, texts: list[str | None]) -> None:
        raw, spans, till = prepared(*textkit.buffers(pa.array(texts, pa.string())))
        self.raw = raw.tobytes()
        self.names = textkit.word_hashes(raw, spans[:, 0], spans.sum(axis=1), lower=False)
        self.names, first = np.unique(self.names, return_index=True)
        self.spans, self.text = spans[first], np.searchsorted(till, first, "right")

    def some(self, rows: np.ndarray) -> list[bytes]:
        return [self.raw[i : i + n] for i, n in self.spans[rows].tolist()]

    def keep(self, rows: np.ndarray) -> None:
        self.names, self.spans, self.text = self.names[rows], self.spans[rows], self.text[rows]

    def part(self, chosen: np.ndarray) -> "Windows":
        out = copy.copy(self)
        out.keep(np.flatnonzero(chosen))
        return out

    def foremost(self, rows: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` of these rows of each text."""
        order = np.argsort(self.text[rows], kind="stable")
        texts = self.text[rows][order]
        rank = np.arange(len(order)) - np.searchsorted(texts, texts)
        return rows[np.sort(order[rank < most])]


class Dictionaries:
    """Ordinary and toxic compressor; differences are ordinary less toxic lengths."""

    def __init__(self, language: bytes, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = Compressor(language + ordinary), Compressor(language + toxic)

    def differences(self, raw: bytes, spans: np.ndarray) -> np.ndarray:
        return self.ordinary.lengths(raw, spans) - self.toxic.lengths(raw, spans)

    def telling(self, held: Windows, rows: np.ndarray, differences: np.ndarray, least: int) -> list[bytes]:
        """The words of windows without which the difference shrinks most, by ``least`` bytes or more."""
        words, drop, first, sizes = _without_each_word(held.some(rows), self.differences, differences[rows])
        if not words:
            return []
        most = np.repeat(np.maximum.reduceat(drop, first), sizes)
        return [words[i] for i in np.flatnonzero((drop == most) & (drop >= least))]

    def features(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For each difference how many windows reach it, as a logarithm, whether any does, and for some their share."""
        raw, offsets = textkit.buffers(column)
        for i, j in textkit.slices(offsets):
            part, spans, till = prepared(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            value = np.clip(self.differences(part.tobytes(), spans), LEAST, MOST) - LEAST
            for k in range(j - i):
                n = till[k + 1] - till[k]
                seen = np.bincount(value[till[k] : till[k + 1]], minlength=MOST - LEAST + 1)
                reached = np.cumsum(seen[::-1])[::-1]
                size, some = np.log1p(n), reached[_SHARES]
                yield np.concatenate((np.log1p(reached), np.minimum(reached, 1), [size], np.log1p(some) * size / 8, some / max(n, 1) * 10))


def _without_each_word(found: list[bytes], measure: Callable[[bytes, np.ndarray], np.ndarray], whole: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words of windows, by how much each window's measure shrinks without the word, and each window's first word and number of words."""
    without, words_of, sizes = [], [], []
    for window in found:
        words = window.split()
        words_of += words
        sizes.append(len(words))
        without += [b" ".join(words[:i] + words[i + 1 :]) for i in range(len(words))]
    lengths = np.fromiter(map(len, without), np.int64, len(without))
    left = measure(b"".join(without), np.stack((np.cumsum(lengths) - lengths, lengths), axis=1)) if without else np.zeros(0, np.int64)
    sizes = np.array(sizes, np.int64)
    return words_of, np.repeat(whole, sizes) - left, np.cumsum(sizes) - sizes, sizes


def _unheard(language: Compressor, held: Windows, rows: np.ndarray, least_word: int) -> list[bytes]:
    """Words that cost the language's compressor as many bytes as they have, or more."""
    words, cost, _, _ = _without_each_word(held.some(rows), language.lengths, language.lengths(held.raw, held.spans[rows]))
    return [w for w, c in zip(words, cost.tolist(), strict=True) if c >= len(w) >= least_word]


def _joined(pieces: list[bytes], order: np.random.Generator) -> list[bytes]:
    shuffled = [pieces[i] for i in order.permutation(len(pieces))]
    return [b" " + b" ".join(shuffled[i : i + WINDOW]) + b" " for i in range(0, len(shuffled), WINDOW)]


def _means(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have windows, and the mean of each one's positive differences."""
    size = np.bincount(text)
    there = np.flatnonzero(size)
    return there, (np.bincount(text, np.clip(value, 0, 8).astype(np.float64)) / np.maximum(size, 1))[there]


def _taught(language: bytes, held: list[bytes], plain: Windows, odd: Windows, rng: np.random.Generator, bounds: Bounds) -> tuple[list[bytes], float]:
    """Parts (ordinary, toxic) that go before what is held, those of the two neighbouring rounds that tell unseen texts apart best, and how well: the mean share of ordinary texts that a toxic one looks more toxic than."""
    halves = [[w.part(w.text % 2 == k) for k in (0, 1)] for w in (plain, odd)]
    # Where a class has one text, both halves are all of it.
    halves = [pair if all(len(h.names) for h in pair) else [w, w] for pair, w in zip(halves, (plain, odd), strict=True)]
    later = min(bounds.part_bytes, max(bounds.least_bytes, bounds.bytes_to_text * len(np.unique(odd.text))))
    known = Compressor(language + held[1])
    parts = []
    for w in halves:
        rows = w[1].foremost(rng.permutation(len(w[1].names)), bounds.text_windows)[: bounds.first_windows]
        parts.append(_trained(_joined(_unheard(known, w[1], rows, bounds.least_word), rng), bounds.first_bytes))
    best, most, before = parts, -1.0, [b"", b""]
    for r in range(bounds.rounds + 1):
        here, there = halves[1][r % 2], halves[0][r % 2]
        found = Dictionaries(language, *(p + h for p, h in zip(parts, held, strict=True)))
        own, other = found.differences(here.raw, here.spans), found.differences(there.raw, there.spans)
        if not len(own) or not len(other):
            break
        low = np.sort(_means(other, there.text)[1])
        apart = float(np.searchsorted(low, _means(own, here.text)[1]).mean() / len(low))
        if apart > most and r > 0:
            best, most = [a + b for a, b in zip(before, parts, strict=True)] if r > 1 else parts, apart
        if r == bounds.rounds:
            break
        least = np.quantile(other, bounds.beyond[min(r, len(bounds.beyond) - 1)])
        ranked = np.argsort(-own, kind="stable")
        beyond = here.foremost(ranked[own[ranked] > least], bounds.telling_windows)
        likest = there.foremost(np.argsort(-other, kind="stable"), bounds.telling_windows)[: max(len(beyond), 200)]
        pieces = found.telling(here, beyond, own, bounds.least_drop)
        if not pieces:
            break
        before, parts = parts, [_trained(_joined(p, rng), later) for p in (found.telling(there, likest, other, bounds.least_drop), pieces)]
    return best, most


def train(toxic: list[str | None], ordinary: list[str | None], seed: int = 1, bounds: Bounds = Bounds()) -> tuple[Dictionaries, float]:
    """Dictionaries from one draw of the halves, and how well they tell unseen texts apart."""
    rng = np.random.default_rng(seed)
    plain, odd = Windows(ordinary), Windows(toxic)
    odd.keep(np.flatnonzero(~np.isin(odd.names, plain.names)))
    order = rng.permutation(len(plain.names))
    half = min(bounds.language_windows, len(order) // 2)
    language = b" ".join(plain.some(order[:half]))[: bounds.language_bytes]
    plain.keep(np.sort(order[half : 2 * half]))
    held, apart, left, untold = [b"", b""], -1.0, odd, len(toxic) + 1
    for _ in range(bounds.turns):
        if not len(left.names):
            break
        parts, told = _taught(language, held, plain, left, rng, bounds)
        tried = [p + h for p, h in zip(parts, held, strict=True)]
        found = Dictionaries(language, *tried)
        plain_means = _means(found.differences(plain.raw, plain.spans), plain.text)[1]
        texts, means = _means(found.differences(odd.raw, odd.spans), odd.text)
        still = texts[means <= (np.quantile(plain_means, bounds.untold) if len(plain_means) else 0.0)]
        if len(still) >= untold:
            break
        held, apart, untold = tried, max(apart, told), len(still)
        left = odd.part(np.isin(odd.text, still))
    return Dictionaries(language, *held), apart


def fit(toxic: list[str | None], ordinary: list[str | None], seed: int = 1, bounds: Bounds = Bounds()) -> tuple[Dictionaries, object, float]:
    """Dictionaries, the models that turn a text's differences into its score, and how well the dictionaries tell unseen texts apart; each text of the sample counts once."""
    if not len(toxic) or not len(ordinary):
        return Dictionaries(b"", b"", b""), Constant(1.0 if len(toxic) else 0.0 if len(ordinary) else 0.5), 0.0
    found, apart = train(toxic, ordinary, seed, bounds)
    x = np.array(list(found.features(pa.array([*ordinary, *toxic], pa.string()))))
    y = np.repeat([0.0, 1.0], [len(ordinary), len(toxic)])
    same = np.ones(len(y))
    return found, Mean([Logistic(x, y, same), Trees(x, y, same)]), apart


def _fit_group(sample: pa.Table, bounds: Bounds) -> pa.Table:
    """One restart: the sample's texts in, the pickled model out."""
    sample = sample.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    seed = sample.column("restart")[0].as_py()
    texts, label = sample.column("text").to_pylist(), sample.column("label").to_pylist()
    *model, apart = fit([t for t, y in zip(texts, label, strict=True) if y == 1], [t for t, y in zip(texts, label, strict=True) if y == 0], seed, bounds)
    del texts
    give_back()
    return pa.table({"restart": pa.array([seed], pa.int32()), "apart": pa.array([apart]), "model": pa.array([pickle.dumps(tuple(model))], pa.binary())})


def _scores(texts: pa.Array, found: Dictionaries, model: object) -> np.ndarray:
    if isinstance(model, Constant):
        return model.predict(np.zeros(len(texts)))
    return model.predict(np.array(list(found.features(texts))))


def _score(batches: Iterator[pa.RecordBatch], found: Dictionaries, model: object) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            score = _scores(b.column(2), found, model)
            yield batch(doc_id=b.column(0), held_out=b.column(1), score=pa.array(score), predicted=pa.array((score >= THRESHOLD).astype(np.int32)))


def _ordinary_rows(batches: Iterator[pa.RecordBatch], text: int, found: Dictionaries, model: object) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield b.filter(pa.array(_scores(b.column(text), found, model) < THRESHOLD))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, restarts: int = RESTARTS, bounds: Bounds = Bounds()) -> tuple[Dictionaries, object]:
    """Dictionaries and model of the labelled rows that are not held out.

    At most ``sample`` labelled rows of each class train, of texts of at most ``sample_bytes``
    bytes each, so each of the ``restarts`` tasks gets at most 2 * sample * sample_bytes bytes;
    the driver gets models only, of about a megabyte each.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    short = rows.where(F.octet_length(F.coalesce("text", F.lit(""))) <= sample_bytes)
    known, _ = labelled_sample(short, labels, "toxic", held_out_third(F.col("doc_id")), sample)
    known = stage(known.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")), "sample")
    each = known.withColumn("restart", F.explode(F.sequence(F.lit(1), F.lit(restarts))))

    def fitted(group: pa.Table) -> pa.Table:
        return _fit_group(group, bounds)

    tried = each.groupBy("restart").applyInArrow(fitted, "restart int, apart double, model binary")
    found = sorted(tried.collect(), key=lambda r: (-r["apart"], r["restart"]))
    if not found:
        return fit([], [])[:2]
    return pickle.loads(found[0]["model"])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: object) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; ``bounds`` are those of ``learned``."""
    found, model = learned(docs, labels, id_col, text_col, **bounds)
    doc_id = quoted(id_col).cast("long")
    asked = docs.select(doc_id.alias("doc_id"), F.coalesce(held_out_third(doc_id), F.lit(False)).alias("held_out"), quoted(text_col).alias("text"))
    return arrow_map(asked, partial(_score, found=found, model=model), "doc_id long, held_out boolean, score double, predicted int")


def ordinary_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: object) -> DataFrame:
    """The rows of docs, with all their columns, that are not called toxic; ids play no part in the decision."""
    found, model = learned(docs, labels, id_col, text_col, **bounds)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    kept = arrow_map(plain, partial(_ordinary_rows, text=docs.columns.index(text_col), found=found, model=model), plain.schema)
    return kept.toDF(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
