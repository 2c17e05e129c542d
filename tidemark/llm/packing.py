"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum
of squared lengths).  Pieces are taken longest first, and each goes to the open
sequence that fits every capacity and scores best: by the weighted norm of
what would be left over, or by the weighted dot product of piece and room.

All pieces of a length are alike to that rule, so the choice is made for
counts: the histogram of lengths, at most ``tokens`` numbers however large the
corpus, is packed on the driver into runs (length, ranks, first sequence,
offset), and Spark finds each piece's run by its rank among its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ranges import pick
from .scratch import Scratch

END = 2
MOST_RUNS = 500_000  # that are broadcast


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds; the defaults for documents and cost are the most that its tokens allow."""

    tokens: int = 1024
    documents: int | None = None
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    rule: str = "norm"  # or "dot"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.cost or self.tokens**2], float)


def plan(histogram: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset) that pack a histogram of lengths."""
    limit = capacity.limits()
    w = np.array(capacity.weights)
    states: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    runs, opened = [], 0
    for length in sorted(histogram, reverse=True):
        item = np.array([length, 1, length * length], float)
        if (item > limit).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        rank, count = 0, histogram[length]
        while rank < count:
            used = np.array(list(states), float).reshape(-1, 3)
            fits = np.flatnonzero((used + item <= limit).all(axis=1))
            if len(fits):
                room = (limit - used[fits]) / limit
                score = ((room - item / limit) ** 2 @ w) if capacity.rule == "norm" else -(room * (item / limit) @ w)
                state = tuple(int(x) for x in used[fits[np.argmin(score)]])
                a, b = states[state].pop()
                n = min(b - a, count - rank)
                if a + n < b:
                    states[state].append((a + n, b))
                if not states[state]:
                    del states[state]
                runs.append((length, rank, rank + n, a, state[0]))
                states.setdefault((state[0] + length, state[1] + 1, state[2] + length * length), []).append((a, a + n))
                rank += n
                continue
            each = int((limit // item).min())  # of this length in a sequence of its own
            rest = count - rank
            for many, k in ((rest // each, each), (1, rest % each)):
                if not many or not k:
                    continue
                for t in range(k):
                    runs.append((length, rank, rank + many, opened, t * length))
                    rank += many
                states.setdefault((k * length, k, k * length * length), []).append((opened, opened + many))
                opened += many
    return runs


def _pieces(ranks_path: str, json_path: str, tokens: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc = encoder(ranks_path, json_path)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                rows, ids_of = [], []
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    n = len(ids) + 1
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    edge = [0, *range(n - (n - 1) // tokens * tokens, n + 1, tokens)]
                    for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                        rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                        if with_ids:
                            ids_of.append(ids[a:b].astype(np.int32))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                out = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                if with_ids:
                    out.append(pa.array(ids_of, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
        enc.clear()

    return run


def token_pieces(docs: DataFrame, ranks_path: str, json_path: str, tokens: int = 1024, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of whole texts, each ended by id 2.

    A document of more than ``tokens`` ids is cut so that every piece but the
    first is full.  A null or empty text is the end id alone.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(ranks_path, json_path, tokens, with_ids), schema)


def pack(spark: SparkSession, pieces: DataFrame, capacity: Capacity = Capacity(), rows_per_bucket: int = 1000) -> DataFrame:
    """``pieces`` (at least doc_id, piece, start, length) with sequence_id and offset.

    Offsets are gapless from 0 in each sequence.  Pieces longer than the
    capacity raise ValueError.  Repeated rows are packed each on its own.
    """
    s = Scratch(spark, "packing")
    pieces = s.table(pieces, "pieces")
    histogram = {int(r[0]): r[1] for r in pieces.groupBy("length").count().collect()}
    runs = plan(histogram, capacity)
    buckets = [-(-histogram.get(i, 0) // rows_per_bucket) or 1 for i in range(capacity.tokens + 1)]
    p = pieces.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", "start"), pick(buckets, "length")))
    sizes = p.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "start")
    p = p.withColumn("__r", F.row_number().over(inside) - 1).join(sizes, ["length", "__b"]).withColumn("__rank", F.col("__before") + F.col("__r"))
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "l long, lo long, hi long, first long, offset long")
    # runs split where a length meets another room, not with the number of pieces; their number is looked at all the same
    q = p.join(F.broadcast(table) if len(runs) <= MOST_RUNS else table, (F.col("length") == F.col("l")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")))
    out = s.table(q.select(*pieces.columns, (F.col("first") + F.col("__rank") - F.col("lo")).alias("sequence_id"), F.col("offset")), "out")
    s.close("out")
    return out


def sequences(packed: DataFrame, tokens: int = 1024) -> DataFrame:
    """(sequence_id, ids): the packed token sequences, from pieces that carry ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
