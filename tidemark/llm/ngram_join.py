"""N-gram Jaccard join by parity sketches.

Every document is the set of its distinct word shingles.  Two documents link
when ``den * |A & B| >= num * |A | B|``.

*Sketch.*  A shingle flips one bit of a parity sketch, so the Hamming distance
of two sketches never exceeds the symmetric difference of the sets.  A link
allows a symmetric difference of at most ``(den-num)/(den+num) * (|A|+|B|)``.

*Pigeonhole per size band.*  Sizes fall into bands; a band's bound T on the
difference splits its sketches into T + 1 blocks and some to spare, so that
linked sets agree in one whole block more than there are to spare.  The blocks
are virtual: each is 2**32 bits wide and travels as the XOR of its flipped
bits' codes, 64 bits long.  Each set leaves out as many blocks as there are to
spare, those with the fewest shingles, ties by key.  This order is the same for
all sets, so of the blocks that two linked sets agree in, one remains in both.
Sets with more empty blocks than that take part in a further layout with other
hashes, and the last layout keeps its empty blocks, so no link is lost.

*Verify.*  Blocks that several sets share are compared pair by pair inside
bounded cells.  Of blocks shared by the same sets one is enough, and a pair
counts only at the least block that its sets share, so every link is found and
counted once.  Size, then the Hamming distance of short dense sketches, then
the exact sets decide.  A cell returns sums per set and a spanning forest,
never its pairs.

Equal sets are merged before blocks are formed, so thousands of copies cost a
row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import hashing as H
from .components import connected_components
from .scratch import Scratch, Sieve, if_small

U = np.uint64
LAYOUTS = 4
CELL = 512
ELEMENTS = 1 << 20  # of the sets of a cell that are compared at once
LEAST = 8  # keys of a set that the first look at its cells knows
SHARE, HOT = 32, 16  # of the sets one in SHARE is drawn, and a block that HOT of them share is hot
MOST_HOT = 500_000


class Bands:
    """Size bands with their bound on the difference and number of blocks."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        step = max(1.25, den / num)
        b = [1]
        while b[-1] <= largest:
            b.append(max(b[-1] + 1, math.ceil(b[-1] * step)))
        self.low = np.array(b, np.int64)
        n = self.low[1:] - 1
        self.most = n * den // num
        t = (den - num) * (n + self.most) // (den + num)
        self.spare = np.where(t >= 8, np.ceil(0.25 * (t + 1)).astype(np.int64), np.where(t >= 1, 1, 0))
        self.blocks = t + 1 + self.spare

    def entries(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, band) for every band that a set of each size takes part in."""
        rows = np.flatnonzero(sizes > 0)
        band = np.searchsorted(self.low, sizes[rows], "right") - 1
        out = [(rows, band)]
        while True:
            band = band - 1
            keep = band >= 0
            keep[keep] = self.most[band[keep]] >= sizes[rows[keep]]
            rows, band = rows[keep], band[keep]
            if not len(rows):
                break
            out.append((rows, band))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def block_keys(x: np.ndarray, off: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Block keys of each row's set and the rows' offsets."""
    sizes = np.diff(off)
    rows, band = bands.entries(sizes)
    got_row, got_key = [], []
    for layout in range(LAYOUTS):
        if not len(rows):
            break
        last = layout == LAYOUTS - 1
        n, k = sizes[rows], bands.blocks[band]
        entry = np.repeat(np.arange(len(rows)), n)
        first = np.cumsum(n) - n
        at = np.arange(len(entry)) - first[entry] + off[rows][entry]
        z = H.mix(x[at] ^ H.seeded(11 + layout))
        base = np.cumsum(k) - k
        block = base[entry] + (((z >> U(32)) * k[entry].astype(U)) >> U(32)).astype(np.int64)
        content = np.zeros(int(k.sum()), U)
        np.bitwise_xor.at(content, block, H.mix(z ^ H.seeded(21)))
        held = np.bincount(block, minlength=len(content))
        of = np.repeat(np.arange(len(rows)), k)
        number = np.arange(len(content)) - base[of]
        salt = H.mix(band[of].astype(U) * U(0x9E3779B97F4A7C15) + number.astype(U) * U(LAYOUTS) + U(layout))
        key = H.mix(content ^ salt)
        order = np.lexsort((key, held, of))
        use = number >= bands.spare[band][of]  # places in that order
        if not last:
            use &= held[order] > 0
        got_key.append(key[order][use])
        got_row.append(rows[of][use])
        few = np.bincount(of, weights=held == 0, minlength=len(rows)) > bands.spare[band]
        rows, band = rows[few], band[few]
    row = np.concatenate(got_row) if got_row else np.zeros(0, np.int64)
    key = np.concatenate(got_key) if got_key else np.zeros(0, U)
    order = np.argsort(row, kind="stable")
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=len(sizes)), out=out[1:])
    return key[order], out


def dense_sketches(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of a power of two of bits, at least a bit a shingle."""
    sizes = np.diff(off)
    bits = np.where(sizes > 0, np.maximum(256, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)), 0)
    base = np.cumsum(bits) - bits
    row = H.rows_of(off)
    at = base[row] + (H.mix(x ^ H.seeded(31)) & (bits[row] - 1).astype(U)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8)
    words = np.packbits(odd, bitorder="little").view(U)
    o = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(bits // 64, out=o[1:])
    return words, o


SKETCH = "doc_id long, n int, fp1 long, fp2 long, keys array<long>, sketch array<long>"


def _sketcher(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den, 1 << 16)
        for batch in batches:
            off, data = H.text_buffers(batch.column(1))
            for i, j in H.slices(off):
                x, o = H.shingle_sets(*H.word_hashes(data, off[i : j + 1]), width)
                n = np.diff(o)
                if len(n) and n.max() > bands.low[-2]:
                    bands = Bands(num, den, int(n.max()) * 2)
                fp = np.zeros((2, len(n)), U)
                for k in range(2):
                    np.bitwise_xor.at(fp[k], H.rows_of(o), H.mix(x ^ H.seeded(41 + k)))
                keys, sketch = block_keys(x, o, bands), dense_sketches(x, o)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int32)), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), H.lists(*keys), H.lists(*sketch)],
                    names=["doc_id", "n", "fp1", "fp2", "keys", "sketch"],
                )

    return run


def _set_maker(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = H.text_buffers(batch.column(1))
            for i, j in H.slices(off):
                x, o = H.shingle_sets(*H.word_hashes(data, off[i : j + 1]), width)
                fp = np.zeros(len(o) - 1, U)
                np.bitwise_xor.at(fp, H.rows_of(o), H.mix(x ^ H.seeded(41)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fp.view(np.int64)), H.lists(x, o)], names=["id", "fp1", "words"])

    return run


def shingle_table(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, fp1, words): sorted shingle hashes of the documents whose id and set are in the written table ``ids``, a row for each.

    A sieve of bounded size leaves out nearly all other texts where they
    stand; only what it lets through is joined, so few texts are shuffled.
    """
    maybe, _ = Sieve(ids, "id").split(docs.select("doc_id", "text"), F.col("doc_id"))
    wanted = maybe.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    sets = wanted.select("doc_id", "text").mapInArrow(_set_maker(width), "id long, fp1 long, words array<long>")
    return sets.join(ids, ["id", "fp1"], "left_semi").dropDuplicates(["id", "fp1"])


def close_pairs(n: np.ndarray, sketches: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that sizes and sketches allow."""
    order = np.argsort(n, kind="stable")
    n = n[order]
    length = np.array([len(sketches[i]) for i in order])
    out = [np.zeros((2, 0), np.int64)]
    for size in np.unique(length):
        mine = np.flatnonzero(length == size)
        other = np.flatnonzero((length == size) | (length == 2 * size))
        m = np.stack([s if len(s) == size else s[:size] ^ s[size:] for s in (sketches[order[i]] for i in other)])
        where = {int(v): k for k, v in enumerate(other)}
        for i in mine:
            k = where[int(i)]
            end = np.searchsorted(n[other], n[i] * den // num, "right")
            if end <= k + 1:
                continue
            d = np.bitwise_count(m[k + 1 : end] ^ m[k]).sum(axis=1, dtype=np.int64)
            j = other[k + 1 : end]
            j = j[d * (den + num) <= (den - num) * (n[i] + n[j])]
            out.append(np.stack((np.full(len(j), order[i]), order[j])))
    i, j = np.concatenate(out, axis=1)
    return i, j


def shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[i] and sets[j], pair by pair.

    Large sets are compared by ranges of their elements, which bounds the memory.
    """
    if len(i) <= len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    parts = -(-sum(map(len, sets)) // ELEMENTS)
    if parts > 1:
        of = [((x.view(U) >> U(32)) * U(parts)) >> U(32) for x in sets]
        return sum(_shared([x[p == k] for x, p in zip(sets, of, strict=True)], i, j) for k in range(parts))
    return _shared(sets, i, j)


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = held > 1  # what one set alone holds is in no intersection
    row, code = row[twice[code]], (np.cumsum(twice) - 1)[code[twice[code]]]
    bits = np.zeros((len(sets), (int(twice.sum()) + 63) // 64), U)
    np.bitwise_or.at(bits, (row, code >> 6), U(1) << (code & 63).astype(U))
    step = max(1, (1 << 21) // max(1, bits.shape[1]))
    return np.concatenate([np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step)])


def spanning(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of 0..m-1 that the pairs lead to, for each of them."""
    up = np.arange(m)
    while True:
        was = up.copy()
        np.minimum.at(up, i, was[j])
        np.minimum.at(up, j, was[i])
        up = up[up]
        if (up == was).all():
            return up


CELLS = "id long, fp1 long, key long, ci int, cj int, links long, up long"


def _cells(num: int, den: int, verify: bool):
    """Runs of equal (key, ci, cj): which members may link there, or their numbers of links and a member that these lead to."""

    def cell(rows: list[dict]) -> list[tuple]:
        n = np.array([r["n"] for r in rows], np.int64)
        i, j = close_pairs(n, [r["sketch"].view(U) for r in rows], num, den)
        if rows[0]["ci"] != rows[0]["cj"]:
            chunk = np.array([r["chunk"] for r in rows])
            apart = chunk[i] != chunk[j]
            i, j = i[apart], j[apart]
        if len(i):
            first = shared([r["lesser"] for r in rows], i, j) == 0  # others count at a lesser key
            i, j = i[first], j[first]
        if len(i) and verify:
            both = shared([r["words"] for r in rows], i, j)
            linked = den * both >= num * (n[i] + n[j] - both)
            i, j = i[linked], j[linked]
        links = np.bincount(np.concatenate((i, j)), minlength=len(rows))
        up = spanning(len(rows), i, j) if verify else np.arange(len(rows))
        return [(rows[k]["id"], rows[k]["fp1"], int(links[k]), rows[up[k]]["id"]) for k in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def flush():
            got = cell(rows) if len(rows) > 1 else []
            v = [[g[k] for g in got] for k in range(4)]
            here = [[x] * len(got) for x in at]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([v[0], v[1], *here, v[2], v[3]], types, strict=True)], names=["id", "fp1", "key", "ci", "cj", "links", "up"])

        for batch in batches:
            plain = batch.select(["key", "ci", "cj", "chunk", "id", "fp1", "n"]).to_pylist()
            for k, r in enumerate(plain):
                for name in ("sketch", "lesser", "words") if verify else ("sketch", "lesser"):
                    r[name] = batch.column(name)[k].values.to_numpy(zero_copy_only=False)
                here = (r["key"], r["ci"], r["cj"])
                if here != at and rows:
                    yield flush()
                    rows = []
                at = here
                rows.append(r)
        if rows:
            yield flush()

    return run


def jaccard_components(spark: SparkSession, docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, links) for every row of ``docs``.

    ``component_id`` is the least doc_id that links lead to, the own one
    included; ``links`` counts the other classes of equal sets that the row's
    class links with, all of them.

    Null and empty texts, and texts of white space only, have no shingle and
    link with nothing: ``n_shingles`` 0, own doc_id.  Rows with a null doc_id
    link with nothing and keep a null component.  Rows that share a doc_id
    count as versions of one document.  Other columns of ``docs`` are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    s = Scratch(spark, "ngram")
    sketches = s.table(docs.mapInArrow(_sketcher(width, num, den), SKETCH), "sketches")
    member = sketches.where("n > 0 and doc_id is not null")
    classes = member.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"))
    groups = s.table(_groups(s, member, classes), "groups")
    rep = s.table(member.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("id")), "classes")
    found = s.table(_links(s, docs, groups, sketches, rep, width, num, den), "found")
    s.drop("cells", "own", "maybe", "wanted", "sets")
    labels = connected_components(found.where("id <> up").select(F.col("id").alias("a"), F.col("up").alias("b")).distinct(), s)
    links = found.groupBy("id", "fp1").agg(F.sum("links").alias("links"))
    rep = rep.join(labels, "id", "left").join(links, ["id", "fp1"], "left")
    rep = rep.select("n", "fp1", "fp2", F.coalesce("label", "id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    out = sketches.select("doc_id", "n", "fp1", "fp2").join(rep, ["n", "fp1", "fp2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
    out = s.table(out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))), "out")
    s.close("out")
    return out


def _groups(s: Scratch, member: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, id, size, h1, h2): the sets of each block that several share, their number, and two hashes of them all.

    Blocks that very many sets share are found in a sample of the sets; they
    are summed up before their rows are shuffled, and all others by a window.
    Whatever the sample finds, the result is the same.
    """
    drawn = member.where(F.pmod(F.xxhash64("fp1", F.lit(5)), F.lit(SHARE)) == 0).dropDuplicates(["n", "fp1", "fp2"])
    hot = drawn.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= HOT)
    hot = s.table(hot, "hot")
    least = HOT
    while hot.where(F.col("seen") >= least).count() > MOST_HOT:  # what is broadcast stays bounded
        least *= 2
    hot = F.broadcast(hot.where(F.col("seen") >= least).select("key"))
    rows = classes.select("id", F.explode("keys").alias("key"))
    told = {"size": F.count(F.lit(1)), "h1": F.bit_xor(F.xxhash64("id")), "h2": F.sum(F.xxhash64("id", F.lit(1)).bitwiseAND(F.lit(2**40 - 1)))}
    at = Window.partitionBy("key")
    cold = rows.join(hot, "key", "left_anti").select("key", "id", *(v.over(at).alias(k) for k, v in told.items())).where("size > 1")
    whole = rows.join(hot, "key").groupBy("key").agg(*(v.alias(k) for k, v in told.items())).where("size > 1")
    return cold.unionByName(rows.join(F.broadcast(whole), "key").select("key", "id", *told))  # at most MOST_HOT rows


def _links(s: Scratch, docs: DataFrame, groups: DataFrame, sketches: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(id, fp1, links, up) of each cell: a class's links counted there, and a document that they lead to."""
    # blocks shared by the same members give the same comparisons: one of them is enough
    keys = s.table(groups.groupBy("size", "h1", "h2").agg(F.min("key").alias("key")).select("key"), "open")
    held = s.table(groups.join(if_small(keys, 48), "key").select("key", "id", "size").repartition("key", "id").distinct(), "held")
    s.drop("groups", "hot", "open")  # what is written from them stands by itself
    own = held.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("own"))
    own = classes.join(own, "id").join(sketches.select(F.col("doc_id").alias("id"), "n", "fp1", "fp2", "sketch"), ["id", "n", "fp1", "fp2"])
    own = s.table(own.dropDuplicates(["id", "fp1", "fp2"]).select("id", "n", "fp1", "sketch", "own"), "own")
    parts = F.ceil(F.col("size") / F.lit(CELL)).cast("int")
    cells = (
        held.join(own, "id")
        .withColumn("lesser", F.expr(f"filter(slice(own, 1, {LEAST}), x -> x < key)"))
        .withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("key", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "chunk", "id", "fp1", "n", "sketch", "lesser")
    )
    cells = s.table(cells, "cells")
    s.drop("held")
    # two sets that share one of their few least keys count there; whether others share a lesser key is seen where the sets are
    dealt = lambda df: df.repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj")
    maybe = s.table(dealt(cells).mapInArrow(_cells(num, den, False), CELLS).select("id", "fp1", "key", "ci", "cj"), "maybe")
    wanted = s.table(maybe.select("id", "fp1").distinct(), "wanted")
    sets = s.table(shingle_table(docs, wanted, width), "sets")
    full = cells.drop("lesser").join(maybe, ["id", "fp1", "key", "ci", "cj"]).join(sets, ["id", "fp1"]).join(own.select("id", "fp1", "own"), ["id", "fp1"])
    full = full.withColumn("lesser", F.expr("filter(own, x -> x < key)")).select("key", "ci", "cj", "chunk", "id", "fp1", "n", "sketch", "lesser", "words")
    return dealt(full).mapInArrow(_cells(num, den, True), CELLS).select("id", "fp1", "links", "up")
