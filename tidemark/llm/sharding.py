"""Shards of nearly equal bytes by sampled splitters.

Records are ordered by a key that keeps equal texts together and can still cut
between them.  A sample in which a record's chance grows with its size gives
the splitters, at quantiles of the sampled keys; exact sums per range follow,
and a range that came out overfull is sampled again and subdivided.  With the
ranges' exact offsets every record's place among all bytes is known from its
own range alone, which fixes its shard and its slot.  Only DataFrame and SQL
functions run here.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ranges import pick, range_index
from .scratch import Scratch

SAMPLE = 10_000  # keys drawn in a round, about
LARGE = 64  # a record of more than 1/LARGE of a shard is placed on its own


def record_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key) of documents; size counts UTF-8 bytes plus 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(F.lit(-(2**24))).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit(2**24 - 1))).alias("key"),
    )


def _draw(records: DataFrame, total: int, seed: int, quantiles: int) -> list[int]:
    """Splitters at quantiles of a sample of about SAMPLE keys, chosen by size."""
    u = F.pmod(F.xxhash64("key", "doc_id", F.lit(seed)), F.lit(2**31)) / float(2**31)
    keys = records.where(u * total < F.col("size") * SAMPLE).agg(F.sort_array(F.collect_list("key"))).first()[0]
    return sorted({keys[len(keys) * q // quantiles] for q in range(1, quantiles)}) if keys else []


def _sums(records: DataFrame, splitters: list[int]) -> list[tuple[int, int, int]]:
    rows = records.groupBy(range_index("key", splitters).alias("r")).agg(F.sum("size"), F.count(F.lit(1))).collect()
    return sorted(tuple(r) for r in rows)


def splitters(records: DataFrame, total: int, ranges: int, rounds: int = 3) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Splitters, and (range, bytes, rows) of each range that has rows."""
    found = _draw(records, total, 0, ranges)
    sums = _sums(records, found)
    for turn in range(1, rounds + 1):
        full = [r for r, size, _ in sums if size > 2 * total / ranges]
        if not full:
            break
        inside = records.where(range_index("key", found).isin(full))
        size = sum(s for r, s, _ in sums if r in full)
        more = _draw(inside, size, turn, max(2, 2 * ranges * size // total))
        if not set(more) - set(found):
            break
        found = sorted({*found, *more})
        sums = _sums(records, found)
    return found, sums


def place_large(sizes: list[int], total: int, shards: int) -> tuple[list[int], list[int], list[float]]:
    """Shard and slot of each large record, and each shard's part of the rest."""
    heap, shard, slot = [(0, i) for i in range(shards)], [], []
    held, count = [0] * shards, [0] * shards
    for x in sizes:
        load, i = heapq.heappop(heap)
        shard.append(i)
        slot.append(count[i])
        held[i], count[i] = load + x, count[i] + 1
        heapq.heappush(heap, (load + x, i))
    left = total - sum(sizes)
    room = sorted(range(shards), key=lambda i: held[i])
    level, filled = 0.0, 0
    for k, i in enumerate(room, 1):  # pour the rest over the lowest shards
        filled += held[i]
        level = (left + filled) / k
        if k == shards or level <= held[room[k]]:
            break
    return shard, slot, [max(0.0, level - h) for h in held]


def shard_by_bytes(spark: SparkSession, records: DataFrame, shards: int = 16, rows_per_range: int = 200_000) -> DataFrame:
    """``records`` (doc_id, size, text_crc32, key) with shard, slot and range_id.

    Shards hold nearly the same bytes: a shard is off by less than one record
    of 1/64 of a shard, larger records being dealt first, largest to emptiest.
    Slots count from 0 without gaps in each shard.  Repeated rows are told
    apart by any order between them.  Null doc_ids sort first.
    """
    s = Scratch(spark, "shards")
    records = s.table(records, "records")
    total, rows = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    limit = max(1, total // (shards * LARGE))
    large = records.where(F.col("size") > limit)
    # fewer than shards * LARGE records can be this large
    order = Window.orderBy(F.desc("size"), "key", "doc_id")
    sizes = [r[0] for r in large.select("size").orderBy(F.desc("size")).collect()]
    shard, slot, part = place_large(sizes, total, shards)
    small = records.where(F.col("size") <= limit)
    left = total - sum(sizes)
    found, sums = splitters(small, max(left, 1), max(4 * shards, min(100_000, rows // rows_per_range)))
    index = [0] * (len(found) + 1)
    at = {r: (b, n) for r, b, n in sums}
    before_b, before_n = [0, *accumulate(at.get(r, (0, 0))[0] for r in range(len(index)))], [0, *accumulate(at.get(r, (0, 0))[1] for r in range(len(index)))]
    inside = Window.partitionBy("range_id").orderBy("key", "doc_id", "size")
    cuts = [round(x) for x in accumulate(part)][:-1]
    ranked = (
        small.withColumn("range_id", range_index("key", found))
        .withColumn("middle", 2 * (pick(before_b, "range_id") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size"))
        .withColumn("position", pick(before_n, "range_id") + F.row_number().over(inside) - 1)
        .withColumn("shard", range_index("middle", [2 * c for c in cuts]))
    )
    ranked = s.table(ranked, "ranked")
    starts = {r[0]: r[1] for r in ranked.groupBy("shard").agg(F.min("position")).collect()}
    extra = [shard.count(i) for i in range(shards)]
    shift = [extra[i] - starts.get(i, 0) for i in range(shards)]
    columns = ["doc_id", "size", "text_crc32", "shard", "slot", "range_id"]
    out = ranked.withColumn("slot", F.col("position") + pick(shift, "shard")).select(*columns)
    if sizes:
        nth = large.withColumn("i", F.row_number().over(order) - 1)
        own = nth.withColumn("shard", pick(shard, "i")).withColumn("slot", pick(slot, "i")).withColumn("range_id", F.lit(-1))
        out = out.unionByName(own.select(*columns))
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("range_id").cast("int").alias("range_id"))
