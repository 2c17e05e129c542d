"""Nearest neighbours by a hierarchical k-means tree, best bin first.

The upper tree is fitted to a bounded sample.  The tree grows with the data:
leaves of more than about the square root of all vectors are split by subtrees
fitted on executors, each to a bounded sample of its own leaf's vectors.  Every
vector is then indexed under the leaf that greedy descent reaches.  A query
walks the tree through a priority queue of node distances and meets the leaves
best first.  How many leaves it visits is calibrated: for a set of sample
queries the true neighbours among all vectors are found by brute force, and
visits are widened until the wanted recall is reached.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ranges import pick
from .scratch import Scratch

SAMPLE = 20_000  # vectors that the upper tree, and each subtree, is fitted to
BYTES = 64 << 20  # of a sample on the driver, and of all centers, which every task holds
LEAF = 256  # vectors below which no leaf is split
QUERIES = 256  # of them, for the calibration
CHUNK = 4096  # vectors of a leaf, or queries at a leaf, in one task


@dataclass(frozen=True)
class Tree:
    centers: np.ndarray  # of all nodes; node 0 is the root
    children: list[list[int]]
    leaf: list[int]  # the number of a node as a leaf, -1 for inner nodes

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by greedy descent."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            best = distances(x[rows], self.centers[kids]).argmin(axis=1)
            todo += [(kid, rows[best == k]) for k, kid in enumerate(kids) if (best == k).any()]
        return out

    def order(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield self.leaf[node]
                continue
            for kid, d in zip(kids, ((self.centers[kids] - q) ** 2).sum(axis=1), strict=True):
                heapq.heappush(queue, (float(d), kid))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)


def fit_tree(x: np.ndarray, branch: int = 12, leaf_size: int = 48, rounds: int = 8, seed: int = 5) -> Tree:
    rng = np.random.default_rng(seed)
    centers, children, leaf = [x.mean(axis=0) if len(x) else np.zeros(1)], [[]], [-1]
    todo, n = [(0, x)], 0
    while todo:
        node, rows = todo.pop()
        distinct = np.unique(rows, axis=0) if len(rows) > leaf_size else rows[:1]
        k = min(branch, len(distinct) if len(rows) > leaf_size else 1, max(2, len(rows) // leaf_size))
        if k < 2:
            leaf[node], n = n, n + 1
            continue
        c = distinct[rng.choice(len(distinct), k, replace=False)]
        for _ in range(rounds):
            best = distances(rows, c).argmin(axis=1)
            c = np.stack([rows[best == i].mean(axis=0) if (best == i).any() else c[i] for i in range(k)])
        best = distances(rows, c).argmin(axis=1)
        held = [i for i in range(k) if (best == i).any()]
        if len(held) < 2:
            leaf[node], n = n, n + 1
            continue
        for i in held:
            children[node].append(len(centers))
            centers.append(c[i])
            children.append([])
            leaf.append(-1)
            todo.append((len(centers) - 1, rows[best == i]))
    return Tree(np.array(centers), children, leaf)


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of finite components that are not all zero, as doubles.

    Null vectors, ones that hold null or non-finite components, all-zero ones,
    and those of another length than most take no part; neither do rows
    without vec_id.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform({vec}, x -> cast(x as double))").alias("v"))
    v = v.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("v") == (sizes[0] if sizes else 0))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _assigner(tree: Tree):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.assign(_matrix(b.column(1))))], names=["vec_id", "v", "leaf"])

    return run


def nearest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the k nearest to q and their distances, ties to the smaller id."""
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    if len(d) > k:
        rows = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        rows = np.arange(len(d))
    rows = rows[np.isfinite(d[rows])]
    rows = rows[np.lexsort((ids[rows], d[rows]))][:k]
    return rows, d[rows]


def _truth(q: np.ndarray, k: int):
    """The nearest of a task's rows to each calibration query, itself included."""

    def run(batches):
        best: list[list[tuple[float, int, int]]] = [[] for _ in q]
        for b in batches:
            ids, x, leaf = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy()
            for i, v in enumerate(q):
                rows, d = nearest(ids, x, v, k + 1) if len(ids) else ([], [])
                best[i] = heapq.nsmallest(k + 1, best[i] + [(float(s), int(ids[r]), int(leaf[r])) for r, s in zip(rows, d, strict=True)])
        flat = [(i, *t) for i, ts in enumerate(best) for t in ts]
        kinds = [pa.int32(), pa.float64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in flat], t) for j, t in enumerate(kinds)], names=["q", "d", "vec_id", "leaf"])

    return run


def calibrate(index: DataFrame, tree: Tree, q: np.ndarray, k: int, recall: float) -> int:
    """The fewest leaf visits by which the sample queries reach the recall, against all vectors."""
    near = index.mapInArrow(_truth(q, k), "q int, d double, vec_id long, leaf int")
    best = Window.partitionBy("q").orderBy("d", "vec_id")
    # each query's first is itself
    truth = near.withColumn("r", F.row_number().over(best)).where(F.col("r").between(2, k + 1)).select("q", "leaf").collect()
    at = {i: {leaf: n for n, leaf in enumerate(tree.order(v))} for i, v in enumerate(q)}
    met = np.sort([at[i][leaf] + 1 for i, leaf in truth])
    return int(met[min(len(met) - 1, int(np.ceil(recall * len(met))) - 1)]) if len(met) else tree.leaves


def _visitor(tree: Tree, visits: int, held: list[int], enough: int):
    def run(batches):
        for b in batches:
            q_ids, q, leaves = [], [], []
            for q_id, v, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _matrix(b.column(1)), strict=True):
                seen = 0
                for n, leaf in enumerate(tree.order(x)):
                    if n >= visits and seen >= enough:
                        break
                    seen += held[leaf]
                    if held[leaf]:
                        q_ids.append(q_id)
                        q.append(v)
                        leaves.append(leaf)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids, pa.int64()), pa.array(q, pa.list_(pa.float64())), pa.array(leaves, pa.int32())], names=["query_id", "q", "leaf"])

    return run


def _compare(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            ids, x = vectors["vec_id"].to_numpy(), np.stack(vectors["v"].to_numpy())
            for q_id, q in zip(queries["query_id"].to_numpy(), queries["q"], strict=True):
                rows, d = nearest(ids, x, np.asarray(q), k + 1)
                out += [(q_id, int(ids[r]), float(s)) for r, s in zip(rows, d, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def sample(v: DataFrame, n: int, most: int, seed: int) -> np.ndarray:
    """About ``most`` of the ``n`` vectors (vec_id, v), by a hash of vec_id; in the hash's order, so it is the same each time."""
    share = min(1.0, most / max(n, 1))
    drawn = v.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(2**31)) < int(share * 2**31) + 1)
    return _matrix(drawn.orderBy(F.xxhash64("vec_id", F.lit(seed + 1)), "vec_id", "v").limit(2 * most).select("v").toArrow()["v"].combine_chunks())


def _splitter(goal: int):
    """A leaf's subtree as (leaf, centers, children), with leaves of about ``goal`` of the leaf's vectors."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, held = np.stack(rows["v"].to_numpy()), rows["held"].iloc[0]
        sub = fit_tree(x, leaf_size=max(8, int(len(x) * goal / held)))
        return pd.DataFrame({"leaf": [rows["leaf"].iloc[0]], "centers": [sub.centers.tobytes()], "children": [[list(map(int, c)) for c in sub.children]]})

    return run


def grow(index: DataFrame, tree: Tree, held: list[int], goal: int, most: int) -> Tree:
    """``tree`` with every leaf of more than twice ``goal`` vectors split by a subtree, as long as all centers number ``most`` at most.

    A subtree is fitted to at most about ``SAMPLE`` of its leaf's vectors, taken by a hash.
    """
    room = most - len(tree.centers)
    big = []
    for leaf, n in sorted(enumerate(held), key=lambda x: -x[1]):
        room -= 2 * n // goal
        if n <= 2 * goal or room < 0:
            break
        big.append(leaf)
    if not big:
        return tree
    share = [min(2**31, int(SAMPLE / max(n, 1) * 2**31) + 1) for n in held]
    own = index.where(F.col("leaf").isin(big)).where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(2**31)) < pick(share, "leaf"))
    own = own.select("leaf", "v", pick(held, "leaf").alias("held"))
    subs = own.groupBy("leaf").applyInPandas(_splitter(goal), "leaf int, centers binary, children array<array<int>>").collect()
    centers, children = [tree.centers], [list(c) for c in tree.children]
    at = {leaf: node for node, leaf in enumerate(tree.leaf) if leaf >= 0}
    for leaf, flat, kids in sorted(subs):
        base, node = len(children), at[leaf]
        # the subtree's root is the leaf itself; its other nodes follow
        children[node] = [base + c - 1 for c in kids[0]]
        children += [[base + c - 1 for c in k] for k in kids[1:]]
        centers.append(np.frombuffer(flat).reshape(len(kids), -1)[1:])
    number = iter(range(len(children)))
    return Tree(np.concatenate(centers), children, [-1 if c else next(number) for c in children])


def search(spark: SparkSession, vectors: DataFrame, is_query: str, k: int = 10, recall: float = 0.97, vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest found, by Euclidean distance in double precision.

    ``is_query`` is an SQL condition on vec_id.  Rows that share a query's
    vec_id are one query, by the least of their vectors; all of them but that
    row itself are candidates.  Repeated rows are candidates each, ties go to
    the smaller vec_id.  With k candidates or fewer, all are returned.
    """
    s = Scratch(spark, "ann")
    v = s.table(usable(vectors, vec), "vectors")
    n = v.count()
    size = len(v.first()[1]) if n else 1
    x = sample(v, n, min(SAMPLE, BYTES // (16 * size)), 3)
    tree = fit_tree(x)

    def counts(df: DataFrame, leaves: int) -> list[int]:
        out = [0] * leaves
        for leaf, count in df.groupBy("leaf").count().collect():  # leaves are bounded by BYTES
            out[leaf] = count
        return out

    for turn in range(3):  # a leaf that came out too large because its sample was uneven is split again
        index = s.table(v.mapInArrow(_assigner(tree), "vec_id long, v array<double>, leaf int"), f"index{turn}")
        held = counts(index, tree.leaves)
        grown = grow(index, tree, held, max(LEAF, math.isqrt(n)), BYTES // (8 * size)) if turn < 2 else tree
        if grown is tree:
            break
        tree = grown
    visits = calibrate(index, tree, x[:QUERIES], k, recall)
    queries = v.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = s.table(queries.mapInArrow(_visitor(tree, visits, held, k + 1), "query_id long, q array<double>, leaf int"), "asked")
    at_leaf = counts(asked, tree.leaves)
    parts, q_parts = ([-(-c // CHUNK) or 1 for c in c_] for c_ in (held, at_leaf))
    deal = lambda df, key, own, other: (
        df.withColumn(own[0], F.pmod(F.xxhash64(key, F.lit(9)), pick(own[1], "leaf")).cast("int"))
        .withColumn(other[0], F.explode(F.sequence(F.lit(0), (pick(other[1], "leaf") - 1).cast("int"))))
    )
    left = deal(asked, "query_id", ("qc", q_parts), ("vc", parts)).groupBy("leaf", "qc", "vc")
    right = deal(index, "vec_id", ("vc", parts), ("qc", q_parts)).groupBy("leaf", "qc", "vc")
    found = left.cogroup(right).applyInPandas(_compare(k), "query_id long, vec_id long, score double")
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)
    found = found.withColumn("own", own).withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "own").orderBy("score", "vec_id")))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = found.where(~(F.col("own") & (F.col("nth") == 1))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = s.table(out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "out")
    s.close("out")
    return out
