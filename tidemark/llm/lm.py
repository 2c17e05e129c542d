"""N-gram language-model scores by deleted interpolation.

The probability of a token after its context mixes maximum-likelihood
estimates of all orders::

    P_0 = 1 / (V + 1)
    P_k = w_k(b) * count_k / context_k + (1 - w_k(b)) * P_(k-1)

b is the bucket of the context's frequency, by powers of two.  A part of the
training documents, the held-out fold, is deleted from the counts, and the
weights of each bucket are those that expectation-maximisation finds on the
fold's counts.  Scores then use the counts of all training documents.

*How counts travel.*  Documents become blocks of about BLOCK tokens, written
once as a table that is bucketed by block: a dictionary of word hashes and
codes.  A block asks for each distinct n-gram once, however often it has it,
by a sorted, packed list of hashes for each range of hashes, with its own
counts.  A range's lists are merged, and every block gets the totals back in
the order in which it asked: no hash travels back and no block is shuffled.
A very frequent n-gram is one entry a block, so no range is hot.

*What reaches the driver* are totals and histograms by bucket and by bins of
the ratio of an order's estimate to the order below, from which EM works: some
ten thousand rows at most, counted over the whole fold.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .scratch import Scratch, small_batches

U = np.uint64
ORDER = 2
BLOCK = 1 << 20
RANGE = 1 << 19  # entries of a range of hashes, about
START, END = H.seeded(101), H.seeded(102)
BINS = 16  # of ratios, to a factor of two
UNSEEN = -(1 << 20)  # the bin of ratio 0
EDGE = 1e-6
SCORED, LEARNT, FOLD = 0, 1, 2  # roles of documents: scored alone, learnt from, and learnt from as held-out fold


def pack(x: np.ndarray) -> bytes:
    """An integer array byte plane by byte plane, compressed."""
    width = x.dtype.itemsize
    planes = x.view(np.uint8).reshape(-1, width).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(b: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(b[8:], n * width, "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(kind).reshape(n)


BLOCK_ROW = "block bigint, uid array<bigint>, doc_id array<{kind}>, role array<int>, size array<int>, skip array<int>, words binary, codes binary"


def _blocker(order: int):
    """Documents (doc_id, text, role, task) into blocks of pieces: context tokens, then scored ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple] = []
        held = made = row = task = 0
        kind = None

        def close() -> pa.RecordBatch:
            nonlocal held, made
            tokens = np.concatenate([p[4] for p in pieces])
            words, code, count = np.unique(tokens, return_inverse=True, return_counts=True)
            rank = np.empty(len(words), np.uint32)
            by = np.argsort(-count, kind="stable")
            rank[by] = np.arange(len(words), dtype=np.uint32)
            cols = [pa.array([[p[k] for p in pieces]], pa.list_(t)) for k, t in ((0, pa.int64()), (1, kind), (2, pa.int32()))]
            cols += [pa.array([[len(p[4]) for p in pieces]], pa.list_(pa.int32())), pa.array([[p[3] for p in pieces]], pa.list_(pa.int32()))]
            out = pa.RecordBatch.from_arrays([pa.array([(task << 32) + made]), *cols, pa.array([pack(words[by])]), pa.array([pack(rank[code])])], names=["block", "uid", "doc_id", "role", "size", "skip", "words", "codes"])
            pieces.clear()
            held, made = 0, made + 1
            return out

        before = np.full(order - 1, START)
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, roles = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            if len(ids):
                task = batch.column(3)[0].as_py()
            off, data = H.text_buffers(batch.column(1))
            at = 0
            for w, wo in H.word_runs(data, off):
                for k in range(len(wo) - 1):
                    tokens = np.concatenate((before, w[wo[k] : wo[k + 1]], [END]))
                    n = len(tokens) - len(before)
                    if held and held + n > BLOCK:
                        yield close()
                    # only a document longer than a block is cut
                    for i in range(0, n, BLOCK):
                        part = tokens[i : min(i + BLOCK, n) + len(before)]
                        pieces.append(((task << 40) + row, ids[at], roles[at], i, part))
                        held += len(part)
                        if held >= BLOCK:
                            yield close()
                    at, row = at + 1, row + 1
        if pieces:
            yield close()

    return run


@dataclass
class Block:
    """The tokens of a block's pieces, and where they stand."""

    tokens: np.ndarray
    size: np.ndarray
    role: np.ndarray
    later: np.ndarray  # pieces that go on with a document
    order: int
    keys: list = field(default_factory=list)

    def __post_init__(self):
        self.piece = np.repeat(np.arange(len(self.size)), self.size)
        start = np.cumsum(self.size) - self.size
        self.place = np.arange(len(self.tokens)) - start[self.piece] - (self.order - 1)  # below 0: context
        self.scored = self.place >= 0
        self.own = self.scored | ((self.place == -1) & self.later[self.piece])

    @classmethod
    def of(cls, row: dict, order: int) -> Block:
        return cls(unpack(row["words"], U)[unpack(row["codes"], np.uint32)], np.array(row["size"], np.int64), np.array(row["role"], np.int64), np.array(row["skip"]) > 0, order)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the k-grams that end at each place."""
        x = self.tokens
        for i in range(1, k):
            y = np.zeros_like(x)
            y[1:] = H.mix(x[:-1] * H._K + self.tokens[1:] + H.seeded(110 + i))
            x = y
        return x

    def entries(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct k-grams that the block asks for, sorted, and for each place that asks the number of its own."""
        return np.unique(self.grams(k)[self.own], return_inverse=True)


def ranges_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range, of n, of each hash; in order of hashes."""
    return ((hashes >> U(32)) * U(n) >> U(32)).astype(np.int64)


ASKED = "range bigint, level int, block bigint, hashes binary, train binary, fold binary"


def _asker(order: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row, order)
                role, scored = block.role[block.piece][block.own], block.scored[block.own]
                for k in range(1, order + 1):
                    hashes, number = block.entries(k)
                    train = np.bincount(number, weights=scored & (role != SCORED), minlength=len(hashes)).astype(np.uint32)
                    fold = np.bincount(number, weights=scored & (role == FOLD), minlength=len(hashes)).astype(np.uint32)
                    to = ranges_of(hashes, n)
                    cuts = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)]))
                    parts = [(int(to[i]), k, row["block"], pack(np.diff(hashes[i:j], prepend=U(0))), pack(train[i:j]), pack(fold[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*parts, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["range", "level", "block", "hashes", "train", "fold"])

    return run


ANSWER = "block bigint, level int, range bigint, train binary, fold binary, types bigint, total bigint, held bigint, bins array<int>, weights array<double>, logs array<double>"


def binned(ratio: np.ndarray, weights: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Rows (by, bin, weight, weighted sum of log2 of the ratio): ratios whose logs round to the same, UNSEEN for 0."""
    with np.errstate(divide="ignore"):
        log = np.where(ratio > 0, np.log2(ratio), 0.0)
    bins = np.where(ratio > 0, np.round(log * BINS), UNSEEN).astype(np.int64)
    key, place = np.unique(np.stack((*by, bins)), axis=1, return_inverse=True)
    return np.stack((*key, np.bincount(place, weights), np.bincount(place, weights * log)))


def _answerer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge what blocks ask for in a range: totals in the order asked; of single words also how many there are and a histogram of their counts."""
    at: tuple | None = None
    rows: list[tuple] = []

    def merge() -> Iterator[pa.RecordBatch]:
        asked = [np.cumsum(unpack(r[1], U), dtype=U) for r in rows]
        size = np.cumsum([0, *map(len, asked)])
        hashes, number = np.unique(np.concatenate(asked), return_inverse=True)
        total = {c: np.bincount(number, weights=np.concatenate([unpack(r[k], np.uint32) for r in rows]), minlength=len(hashes)).astype(np.uint64) for c, k in (("train", 2), ("fold", 3))}
        out = [(r[0], at[1], at[0], pack(total["train"][number[i:j]]), pack(total["fold"][number[i:j]]), None, None, None, None, None, None) for r, i, j in zip(rows, size[:-1], size[1:], strict=True)]
        if at[1] == 1:
            bins, weights, logs = binned((total["train"] - total["fold"]).astype(float), total["fold"].astype(float))
            out.append((None, 1, at[0], None, None, int((total["train"] > 0).sum()), int(total["train"].sum()), int(total["fold"].sum()), bins.astype(int).tolist(), weights.tolist(), logs.tolist()))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))
        names = [f.split()[0] for f in ANSWER.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for span, level, *row in zip(*(batch.column(c).to_pylist() for c in ("range", "level", "block", "hashes", "train", "fold")), strict=True):
            if (span, level) != at:
                if rows:
                    yield from merge()
                at, rows = (span, level), []
            rows.append(tuple(row))
    if rows:
        yield from merge()


def em(ratio: np.ndarray, weights: np.ndarray, rounds: int = 5000) -> float:
    """The weight w that makes counts with these ratios r likeliest: the maximum of the sum of log(w r + 1 - w)."""
    w, total = 0.5, weights.sum()
    if not total:
        return 0.0
    for _ in range(rounds):
        was, w = w, float((weights * (w * ratio / (w * ratio + 1 - w))).sum() / total)
        w = min(1 - EDGE, max(EDGE, w))
        if abs(w - was) < 1e-13:
            break
    return w


def em_of(rows: list[tuple[int, float, float]], factor: float = 1.0) -> float:
    """``em`` of (bin, weight, weighted sum of logs): a bin counts with its mean ratio, times ``factor``."""
    b, n, log = np.array(rows, float).reshape(-1, 3).T
    return em(np.where((b == UNSEEN) | (n == 0), 0.0, factor * np.exp2(np.clip(log / np.maximum(n, 1e-300), -1000, 1000))), n)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Buckets of context frequencies by powers of two; 0 has none."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))), -1).astype(np.int64)


BUCKETS = 64


@dataclass
class Model:
    """Totals of the training documents and of the fold, and the weights learnt so far."""

    order: int
    types: int
    tokens: int
    documents: int
    fold_tokens: int
    fold_documents: int
    single: float = 0.0  # weight of the estimate from single words
    weights: dict[int, list[float]] = field(default_factory=dict)  # by order, for each bucket

    def probabilities(self, counts: list[np.ndarray], contexts: list[np.ndarray], tokens: int, upto: int) -> np.ndarray:
        """P_upto of each token from its counts and those of its contexts, by order."""
        p = np.full(len(counts[0]), 1 / (self.types + 1))
        if tokens and upto >= 1:
            p = self.single * counts[0] / tokens + (1 - self.single) * p
        for k in range(2, upto + 1):
            c = contexts[k - 1]
            w = np.where(c > 0, np.array(self.weights[k])[bucket_of(c)], 0.0)
            p = w * counts[k - 1] / np.maximum(c, 1) + (1 - w) * p
        return p


def learn_weights(rows: list[tuple[int, int, float, float]]) -> list[float]:
    """A weight for each bucket from (bucket, bin, weight, sum of logs); buckets without counts take their neighbour's."""
    got: dict[int, list] = {}
    for bucket, *rest in rows:
        got.setdefault(bucket, []).append(rest)
    known = {b: em_of(v) for b, v in got.items() if b >= 0}
    return [known[min(known, key=lambda k: (abs(k - b), k))] if known else 0.0 for b in range(BUCKETS)]


def _counts(block: Block, answers: list[dict], order: int, held: bool) -> tuple[list, list]:
    """Counts of each scored token's n-grams, and of their contexts (None at a document's start), by order; ``held``: without the fold's, of the fold's tokens."""
    use = block.scored & ((block.role[block.piece] == FOLD) | (not held))
    counts, contexts, was = [], [], None
    for k in range(1, order + 1):
        _, number = block.entries(k)
        mine = sorted((a for a in answers if a["level"] == k), key=lambda a: a["range"])
        total = np.concatenate([unpack(a["train"], U) for a in mine]).astype(np.int64)
        if held:
            total = total - np.concatenate([unpack(a["fold"], U) for a in mine]).astype(np.int64)
        here = np.zeros(len(block.tokens), np.int64)
        here[block.own] = total[number]
        counts.append(here[use])
        contexts.append(None if was is None else was[np.flatnonzero(use) - 1])
        was = here
    return counts, contexts, use


def _fold_counter(model: Model, level: int):
    """Ratios of an order's estimates to the order below, over the fold's tokens: counts by bucket and bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if FOLD not in row["role"]:
                    continue
                block = Block.of(row, model.order)
                counts, contexts, use = _counts(block, row["answers"], level, True)
                first = block.place[use] == 0
                first &= ~block.later[block.piece][use]
                contexts = [c if c is None else np.where(first, model.documents - model.fold_documents, c) for c in contexts]
                below = model.probabilities(counts, contexts, model.tokens - model.fold_tokens, level - 1)
                c = contexts[level - 1]
                ratio = counts[level - 1] / np.maximum(c, 1) / below
                bucket, bins, n, log = binned(ratio, np.ones(len(ratio)), bucket_of(c))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(bins.astype(np.int32)), pa.array(n), pa.array(log)], names=["bucket", "bin", "n", "log"])

    return run


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.schema.field("doc_id").type.value_type
            for row in batch.to_pylist():
                block = Block.of(row, model.order)
                counts, contexts, use = _counts(block, row["answers"], model.order, False)
                first = (block.place[use] == 0) & ~block.later[block.piece][use]
                contexts = [c if c is None else np.where(first, model.documents, c) for c in contexts]
                base = np.log10((counts[0] + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
                score = np.log10(model.probabilities(counts, contexts, model.tokens, model.order))
                of, m = block.piece[use], len(row["size"])
                sums = [np.bincount(of, weights=x, minlength=m) for x in (np.ones(len(of)), counts[0] > 0, base, score)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["uid"], pa.int64()), pa.array(row["doc_id"], ids), pa.array(row["role"], pa.int32()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3])],
                    names=["uid", "doc_id", "role", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def fit_and_score(spark: SparkSession, docs: DataFrame, role: Column, order: int = ORDER) -> DataFrame:
    """(doc_id, role, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``role`` is SCORED, LEARNT or FOLD (learnt from; the weights are found on
    it); null is SCORED.  Tokens are the A-Z-lowered words and one end a
    document; words are told by 64-bit hashes.  ``base_score`` is the add-half
    unigram's log10 probability, ``score`` the model's.

    Null and empty texts, and those of white space, are the end token alone.
    Repeated rows are scored each.  With nothing to learn from, every token
    has probability 1; without a fold the weights are 0, which leaves the
    uniform distribution.  Texts longer than a block are cut into pieces that
    know the words before them, and whose scores are summed.
    """
    s = Scratch(spark, "lm")
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(role, F.lit(SCORED)).cast("int").alias("role"), F.spark_partition_id().cast("long").alias("task"))
    kind = own.schema["doc_id"].dataType.simpleString()
    name = f"lm_blocks_{uuid.uuid4().hex}"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark):
        made = own.mapInArrow(_blocker(order), BLOCK_ROW.format(kind=kind))
        made.write.bucketBy(tasks, "block").option("path", s.path("blocks")).saveAsTable(name)
    s.names.add("blocks")
    blocks = spark.table(name)
    tokens = blocks.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    n = max(4 * tasks, math.ceil(order * tokens / RANGE))
    begun = F.expr("filter(arrays_zip(role, skip), x -> x.skip = 0)")
    documents = blocks.select(F.explode(begun).alias("x")).groupBy("x.role").count().collect()
    documents = {r["role"]: r["count"] for r in documents}

    asked = blocks.mapInArrow(_asker(order, n), ASKED)
    answers = s.table(asked.repartition(tasks, "range").sortWithinPartitions("range", "level").mapInArrow(_answerer, ANSWER), "answers")
    whole = answers.where("block is null")
    t = whole.agg(F.sum("types"), F.sum("total"), F.sum("held")).first()
    model = Model(order, t[0] or 0, t[1] or 0, documents.get(LEARNT, 0) + documents.get(FOLD, 0), t[2] or 0, documents.get(FOLD, 0))
    bins = whole.select(F.explode(F.arrays_zip("bins", "weights", "logs")).alias("x")).groupBy("x.bins").agg(F.sum("x.weights"), F.sum("x.logs")).collect()
    rest = model.tokens - model.fold_tokens
    if rest and bins:
        model.single = em_of([tuple(r) for r in bins], (model.types + 1) / rest)

    got = answers.where("block is not null").select("block", F.struct("level", "range", "train", "fold").alias("a"))
    ready = blocks.join(got.groupBy("block").agg(F.collect_list("a").alias("answers")), "block")
    for level in range(2, order + 1):
        with small_batches(spark):
            rows = ready.mapInArrow(_fold_counter(model, level), "bucket int, bin int, n double, log double").groupBy("bucket", "bin").agg(F.sum("n"), F.sum("log")).collect()
        model.weights[level] = learn_weights([tuple(r) for r in rows])
    pieces = ready.mapInArrow(_scorer(model), f"uid bigint, doc_id {kind}, role int, n_tokens bigint, n_known bigint, base_score double, score double")
    out = pieces.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("role").alias("role"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    out = s.table(out.select("doc_id", "role", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"), "out")
    spark.sql(f"drop table {name}")
    s.close("out")
    return out
