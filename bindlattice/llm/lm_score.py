"""Language-model scores from a weighted backoff automaton over smoothed n-grams.

Plan
----
1. One pass over the texts packs documents into bundles of about BUNDLE_BYTES of
   text: the distinct tokens of the bundle (64-bit hashes) and every document as a
   run of positions in that list.  Bundles are written to the shared folder; texts
   are not read again.
2. Each bundle deals its distinct bigrams, with their counts in its training
   documents, over buckets by the hash of the history; a bucket gets about
   BUCKET_PAIRS bigrams at any size of the input.  The successors of the STATES
   most frequent histories are dealt by the hash of the bigram instead, so that no
   bucket gets all of a frequent history.  This list balances load and has no effect
   on results.
3. A bucket sums the counts of all bundles exactly and answers each bundle with the
   arcs it asked for: the count of every bigram, and of every history its count and
   its number of distinct successors.  As each token is followed by another one or
   by the end token, counts of histories are the token counts.
4. Interpolated absolute discounting makes them a backoff automaton: a state for
   every history seen in training with arcs for all its seen successors, and a
   failure arc, weighted with the discounted mass, to the state of the empty
   history.  Discounted unigram mass is spread over V + 1 tokens, so an unseen
   token has a probability, too.
5. Documents of a bundle run left to right in lockstep through the part of the
   automaton that they reach: one state per document is carried, one token a step
   is consumed.

Defined results: a null text is empty and has the end token alone; a null doc_id
is not held out (its remainder is null) and trains; every row gives one row; no
training documents give N = 0, V = 0 and the uniform distribution over one token;
an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindlattice.llm import textkit
from bindlattice.llm.common import arrow_map, batch, crc_mod, quoted, read, stage

BUNDLE_BYTES = 4 << 20
#: Tokens to a bucket, which bounds its bigrams.
BUCKET_PAIRS = 2_000_000
#: Histories whose successors are dealt over all buckets.
STATES = 1024
DISCOUNT = 0.75
#: The end token's hash; words hash to it with a chance of 2**-64.
END = np.uint64(0xE4D0E4D0E4D0E4D1)

_BUNDLE = "bundle long, size long, trained long, top array<long>, often array<long>, vocabulary binary, ids binary, nulls binary, held binary, lengths binary, tokens binary"
_ASKED = "bundle long, bucket int, past binary, fan binary, now binary, n binary"
_ANSWER = "bundle long, bucket int, arcs binary, past binary, total binary, kinds binary, known long"


def _pack(batches: Iterator[pa.RecordBatch], states: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) to bundles."""
    ids: list[int] = []
    nulls: list[bool] = []
    held: list[bool] = []
    runs: list[np.ndarray] = []
    size = 0

    def put() -> pa.RecordBatch:
        flat = np.concatenate(runs)
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        vocabulary, tokens = np.unique(flat, return_inverse=True)
        often = np.bincount(tokens)
        top = np.argsort(-often, kind="stable")[:states]
        return batch(
            bundle=pa.array([uuid.uuid4().int >> 65]), size=pa.array([len(flat)]), trained=pa.array([int(lengths[~np.array(held)].sum())]),
            top=pa.array([vocabulary[top].view(np.int64)], pa.list_(pa.int64())), often=pa.array([often[top]], pa.list_(pa.int64())), vocabulary=pa.array([vocabulary.tobytes()]),
            ids=pa.array([np.array(ids, np.int64).tobytes()]), nulls=pa.array([np.array(nulls).tobytes()]), held=pa.array([np.array(held).tobytes()]),
            lengths=pa.array([lengths.tobytes()]), tokens=pa.array([textkit.packed(tokens)]),
        )

    for b in batches:
        doc, out = b.column(0).to_pylist(), b.column(1).to_pylist()
        raw, offsets = textkit.buffers(b.column(2))
        for i, j in textkit.slices(offsets):
            part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            start, end, before = textkit.words(part, at)
            hashes = textkit.word_hashes(part, start, end)
            for k in range(i, j):
                runs.append(np.append(hashes[before[k - i] : before[k - i + 1]], END))
                ids.append(doc[k] or 0), nulls.append(doc[k] is None), held.append(bool(out[k]))
            size += len(part) + (j - i)
            if size >= BUNDLE_BYTES:
                yield put()
                ids, nulls, held, runs, size = [], [], [], [], 0
    if runs:
        yield put()


def _squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers, compressed plane by plane of their bytes."""
    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expanded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


class Pairs:
    """Distinct bigrams of a bundle in the order in which they are dealt: by bucket, history and successor.

    ``past`` and ``now`` are positions in the vocabulary; the history of a first
    token is the end token.  ``ends`` and ``heads`` bound the bigrams and the
    histories of each bucket; ``first`` has the first bigram of each history.
    """

    def __init__(self, vocabulary: np.ndarray, held: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, heavy: np.ndarray, buckets: int) -> None:
        tokens = tokens.astype(np.int64)
        past = np.empty_like(tokens)
        past[1:] = tokens[:-1]
        past[np.cumsum(lengths) - lengths] = np.searchsorted(vocabulary, END)
        keys, which = np.unique(past * len(vocabulary) + tokens, return_inverse=True)
        n = np.bincount(which[np.repeat(~held, lengths)], minlength=len(keys))
        past, now = np.divmod(keys, len(vocabulary))
        own = textkit.mix(vocabulary + np.uint64(1))
        spread = np.isin(vocabulary, heavy)[past]
        at = np.where(spread, textkit.mix(own[past] * np.uint64(3) + vocabulary[now]), own[past]) % np.uint64(buckets)
        order = np.argsort(at, kind="stable")
        at, self.past, self.now, self.n = at[order], past[order], now[order], n[order]
        new = np.ones(len(at), bool)
        new[1:] = (self.past[1:] != self.past[:-1]) | (at[1:] != at[:-1])
        self.first = np.flatnonzero(new)
        self.ends = np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))
        self.heads = np.searchsorted(self.first, self.ends)


def _bundle(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """vocabulary, held, lengths and tokens of row i."""
    blob = lambda name, kind: np.frombuffer(b.column(name)[i].as_py(), kind)
    return blob("vocabulary", np.uint64), blob("held", np.bool_), blob("lengths", np.int64), textkit.unpacked(b.column("tokens")[i].as_py())


def _ask(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The bigrams of each bundle, a row to each bucket that gets some."""
    for b in batches:
        for i in range(b.num_rows):
            bundle = _bundle(b, i)
            pairs, vocabulary = Pairs(*bundle, heavy, buckets), bundle[0]
            fan = np.diff(np.append(pairs.first, len(pairs.past)))
            used = np.flatnonzero(np.diff(pairs.ends))
            for some in np.array_split(used, len(used) // 256 + 1):
                spans = [(slice(pairs.ends[k], pairs.ends[k + 1]), slice(pairs.heads[k], pairs.heads[k + 1])) for k in some]
                yield batch(
                    bundle=pa.array([b.column("bundle")[i].as_py()] * len(some), pa.int64()), bucket=pa.array(some.astype(np.int32)),
                    past=pa.array([vocabulary[pairs.past[pairs.first[h]]].tobytes() for _, h in spans], pa.binary()), fan=pa.array([_squeezed(fan[h]) for _, h in spans], pa.binary()),
                    now=pa.array([vocabulary[pairs.now[p]].tobytes() for p, _ in spans], pa.binary()), n=pa.array([_squeezed(pairs.n[p]) for p, _ in spans], pa.binary()),
                )


def _answer(asked: pa.Table, heavy: np.ndarray) -> pa.Table:
    """Sums of one bucket for every bundle that asked, and a row without bundle: parts of the spread histories and the number of other known tokens."""
    bundles, bucket = asked.column("bundle").to_pylist(), asked.column("bucket")[0].as_py()
    heads = [np.frombuffer(x, np.uint64) for x in asked.column("past").to_pylist()]
    fans = [_expanded(x) for x in asked.column("fan").to_pylist()]
    names, past = np.unique(np.concatenate(heads), return_inverse=True)
    successors, now = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in asked.column("now").to_pylist()]), return_inverse=True)
    keys, which = np.unique(np.repeat(past, np.concatenate(fans)) * len(successors) + now, return_inverse=True)
    # Sums of whole numbers under 2**53 are exact.
    arcs = np.bincount(which, np.concatenate([_expanded(x) for x in asked.column("n").to_pylist()])).astype(np.int64)
    total = np.bincount(keys // len(successors), arcs, len(names)).astype(np.int64)
    kinds = np.bincount((keys // len(successors))[arcs > 0], minlength=len(names))
    spread = np.isin(names, heavy)
    out: dict[str, list] = {k: [] for k in ("arcs", "total", "kinds")}
    p = h = 0
    for head, fan in zip(heads, fans, strict=True):
        mine = past[h : h + len(head)]
        out["arcs"].append(_squeezed(arcs[which[p : p + fan.sum()]])), out["total"].append(_squeezed(total[mine])), out["kinds"].append(_squeezed(kinds[mine]))
        p, h = p + fan.sum(), h + len(head)
    return pa.table(
        {
            "bundle": pa.array([*bundles, None], pa.int64()), "bucket": pa.array([bucket] * (len(bundles) + 1), pa.int32()), "arcs": pa.array([*out["arcs"], None], pa.binary()),
            "past": pa.array([None] * len(bundles) + [names[spread].tobytes()], pa.binary()), "total": pa.array([*out["total"], _squeezed(total[spread])], pa.binary()),
            "kinds": pa.array([*out["kinds"], _squeezed(kinds[spread])], pa.binary()), "known": pa.array([0] * len(bundles) + [int((total[~spread] > 0).sum())], pa.int64()),
        }
    )


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What buckets hold of the spread histories."""
    for b in batches:
        for past, total, kinds in zip(*(b.column(k).to_pylist() for k in ("past", "total", "kinds")), strict=True):
            yield batch(token=pa.array(np.frombuffer(past, np.int64)), total=pa.array(_expanded(total)), kinds=pa.array(_expanded(kinds)))


class Automaton:
    """States are histories (a class, or the start) and, last, the empty history.

    Arc k leads from state ``key // width`` on class ``key % width`` to the state
    of that class with log10 weight ``weight[k]``; where a state lacks an arc, its
    failure arc leads to the empty history with weight ``fail[state]``.
    """

    def __init__(
        self, arcs: np.ndarray, counts: np.ndarray, n: int, distinct: int, discount: float = DISCOUNT,
        unigram: np.ndarray | None = None, histories: np.ndarray | None = None, kinds: np.ndarray | None = None,
    ) -> None:
        """Counts of classes and histories, and successors of histories, are those of ``arcs`` where they are not given."""
        self.width, self.distinct, self.discount, self.start = n + 1, distinct, discount, n + 1
        past, now = arcs // self.width, arcs % self.width
        if unigram is None:
            unigram = np.bincount(now, counts, self.width)
        self.total = float(unigram.sum())
        #: Mass of each class in the empty history; that of the last class is its tokens' sum.
        self.spread = discount * distinct / self.total if self.total else 1.0
        single = self.spread / (distinct + 1)
        self.empty = (unigram - discount) / self.total + single if self.total else np.zeros(self.width)
        self.empty[n] = 1.0 - self.empty[:n].sum()
        if histories is None:
            histories = np.bincount(past, counts, n + 2)
        if kinds is None:
            kinds = np.bincount(past, minlength=n + 2)
        left = np.where(histories > 0, discount * kinds / np.maximum(histories, 1), 1.0)
        self.fail = np.log10(left)
        mass = (counts - discount) / histories[past] + left[past] * self.empty[now]
        order = np.argsort(arcs)
        self.arcs, self.weight = arcs[order], np.log10(mass[order])
        self.log_empty = np.log10(np.maximum(self.empty, 1e-300))

    def emission(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of each token's share of its class."""
        out = np.zeros(len(classes))
        other = classes == self.width - 1
        single = self.spread / (self.distinct + 1)
        own = np.where(counts[other] > 0, (counts[other] - self.discount) / max(self.total, 1.0), 0.0) + single
        out[other] = np.log10(own / max(self.empty[-1], 1e-300))
        return out

    def step(self, state: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of one move of each document, and the states they lead to."""
        key = state * self.width + now
        spot = np.searchsorted(self.arcs, key)
        spot[spot == len(self.arcs)] = 0
        if not len(self.arcs):
            return self.fail[state] + self.log_empty[now], now
        return np.where(self.arcs[spot] == key, self.weight[spot], self.fail[state] + self.log_empty[now]), now


def traverse(automaton: Automaton, classes: np.ndarray, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each document; documents lie end to end."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    size, score = lengths[order], np.zeros(len(lengths))
    state = np.full(len(lengths), automaton.start)
    live = len(lengths)
    for t in range(int(size[0]) if len(size) else 0):
        while live and size[live - 1] <= t:
            live -= 1
        at = first[:live] + t
        weight, state[:live] = automaton.step(state[:live], classes[at])
        score[:live] += weight + emission[at]
    out = np.empty(len(lengths))
    out[order] = score
    return out


def _score(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, often: np.ndarray, buckets: int, total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """Scores of bundles; rows of ``often`` have count and number of successors of the tokens of ``heavy``, which ascend."""
    for b in batches:
        for i in range(b.num_rows):
            vocabulary, held, lengths, tokens = _bundle(b, i)
            pairs = Pairs(vocabulary, held, lengths, tokens, heavy, buckets)
            counts, kinds, n = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64), np.zeros(len(pairs.past), np.int64)
            for answer in b.column("answers")[i].as_py():
                k = answer["bucket"]
                mine = pairs.past[pairs.first[pairs.heads[k] : pairs.heads[k + 1]]]
                n[pairs.ends[k] : pairs.ends[k + 1]] = _expanded(answer["arcs"])
                counts[mine], kinds[mine] = _expanded(answer["total"]), _expanded(answer["kinds"])
            spread = np.isin(vocabulary, heavy)
            counts[spread], kinds[spread] = often[np.searchsorted(heavy, vocabulary[spread])].T
            base = np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1)))
            # Tokens known from training are classes; all others, whether in the bundle or not, are the last one.
            known, width = counts > 0, int((counts > 0).sum())
            classes = np.where(known, np.cumsum(known) - 1, width)
            end = np.searchsorted(vocabulary, END)
            seen = n > 0
            past = np.where(pairs.past == end, width + 1, classes[pairs.past])[seen]
            automaton = Automaton(
                past * (width + 1) + classes[pairs.now[seen]], n[seen], width, distinct, unigram=np.append(counts[known], total - counts.sum()),
                histories=np.concatenate((counts[known], [0, counts[end]])), kinds=np.concatenate((kinds[known], [0, kinds[end]])),
            )
            emission = automaton.emission(classes, counts)
            first = np.cumsum(lengths) - lengths
            ids, nulls = np.frombuffer(b.column("ids")[i].as_py(), np.int64), np.frombuffer(b.column("nulls")[i].as_py(), np.bool_)
            yield batch(
                doc_id=pa.array(ids, mask=nulls), held_out=pa.array(held), n_tokens=pa.array(lengths),
                n_known=pa.array(np.add.reduceat(known.astype(np.int64)[tokens], first)), train_tokens=pa.array(np.full(len(ids), total)),
                base_score=pa.array(np.add.reduceat(base[tokens], first)), score=pa.array(traverse(automaton, classes[tokens], emission[tokens], lengths)),
            )


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The successors of the ``states`` most frequent histories are dealt over all
    buckets; results are the same for any number.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), quoted(text_col).alias("text"))
    bundles = stage(arrow_map(rows, partial(_pack, states=states), _BUNDLE), "bundles")
    size, total = bundles.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    buckets = max(1, -(-size // BUCKET_PAIRS))
    often = bundles.select(F.explode(F.arrays_zip("top", "often")).alias("e")).groupBy(F.col("e.top").alias("token")).agg(F.sum("e.often").alias("n"))
    heavy = np.sort(np.array([r["token"] for r in often.orderBy(F.col("n").desc(), "token").limit(states).collect()], np.int64).view(np.uint64))
    asked = arrow_map(bundles.select("bundle", "vocabulary", "held", "lengths", "tokens"), partial(_ask, heavy=heavy, buckets=buckets), _ASKED)
    answers = stage(asked.groupBy("bucket").applyInArrow(lambda t: _answer(t, heavy), _ANSWER), "answers")
    # At most ``states`` rows.
    parts = arrow_map(answers.where("bundle is null").select("past", "total", "kinds"), _parts, "token long, total long, kinds long")
    found = {r["token"]: (r["total"], r["kinds"]) for r in parts.groupBy("token").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).collect()}
    sums = np.array([found[t] for t in heavy.view(np.int64).tolist()], np.int64).reshape(-1, 2)
    distinct = answers.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0] + int((sums[:, 0] > 0).sum())
    back = answers.where("bundle is not null").groupBy("bundle").agg(F.collect_list(F.struct("bucket", "arcs", "total", "kinds")).alias("answers"))
    ready = bundles.join(back, "bundle").select("vocabulary", "held", "lengths", "tokens", "ids", "nulls", "answers")
    return arrow_map(
        ready, partial(_score, heavy=heavy, often=sums, buckets=buckets, total=total, distinct=distinct),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) == 0)
