"""Periodic runs in texts: the same few words again and again.

A run is a stretch of words that equal those ``period`` words on, with the
least such period, that no neighbouring word extends.

*Harmonic grid.*  A run of period p and length L has L - p places whose word
recurs p words on.  As L is at least ``times`` p, every such stretch contains
a multiple of the least L less p.  So for each period the multiples of that
step are looked at, about n log n pairs (period, grid point) for n words.

*Longest common extension.*  Prefix hashes modulo two primes tell whether the
stretches before or after a pair agree.  All pairs gallop and then halve at
once, in NumPy, over many documents together.

*Verify, deduplicate.*  Pairs of one run, and multiples of its period, give
the same ends: the least period stays.  Every run is compared word by word; if
hashes ever lied, the slice is done again with other bases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIMES = (2_147_483_647, 2_147_483_629)
PAIRS = 1 << 18
SLICE = 500_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"
WORD = r"[\x20\x09-\x0D]+"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts, one after another, and the texts' offsets; nulls have none."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    words, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not real.all():  # white space at an end leaves an empty one
        before = np.concatenate(([0], np.cumsum(real)))
        words, off = words.filter(pa.array(real)), before[off - off[0]]
    return words, off - off[0]


class Prefixes:
    """Hashes of all prefixes of a sequence of codes, modulo two primes."""

    def __init__(self, codes: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        n = len(codes)
        self.parts = []
        for prime in PRIMES:
            p, base = np.uint64(prime), int(rng.integers(1 << 20, prime - 1))
            value = rng.integers(1, prime, int(codes.max(initial=0)) + 1, dtype=np.uint64)
            power = np.ones(n + 1, np.uint64)
            k = 1
            while k <= n:
                m = min(k, n + 1 - k)
                power[k : k + m] = power[:m] * np.uint64(pow(base, k, prime)) % p
                k += m
            sums = np.zeros(n + 1, np.uint64)
            # terms are below 2**31, so 2**32 of them fit
            np.cumsum(value[codes] * power[:n] % p, out=sums[1:])
            self.parts.append(((sums % p).astype(np.uint32), power.astype(np.uint32), p))

    def equal(self, x: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from x equal those ``period`` words on."""
        out = np.ones(len(x), bool)
        for sums, power, p in self.parts:
            y = x + period
            first = (sums[x + length].astype(np.uint64) + p - sums[x]) * power[period] % p
            out &= first == (sums[y + length].astype(np.uint64) + p - sums[y]) % p
        return out


def extend(equal: Callable[[np.ndarray, np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """The largest length up to ``most`` for which ``equal(pairs, lengths)`` holds, for all pairs at once."""
    low, high = np.zeros_like(most), most + 1
    live = np.flatnonzero(most > 0)
    while len(live):
        to = np.minimum(np.maximum(2 * low[live], 1), most[live])
        ok = equal(live, to)
        low[live[ok]], high[live[~ok]] = to[ok], to[~ok]
        live = live[ok & (to < most[live])]
    live = np.flatnonzero(high - low > 1)
    while len(live):
        mid = (low[live] + high[live]) // 2
        ok = equal(live, mid)
        low[live[ok]], high[live[~ok]] = mid[ok], mid[~ok]
        live = live[high[live] - low[live] > 1]
    return low


def find_runs(codes: np.ndarray, off: np.ndarray, least: int = 6, times: int = 4, seed: int = 1) -> np.ndarray:
    """Rows (text, start, end, period) of all runs of at least ``least`` words and ``times`` periods, in order of text, start and period.

    ``codes`` has the words of all texts one after another; starts and ends are
    places in it.
    """
    if times < 2:
        raise ValueError("a run has at least two periods")
    hashes = Prefixes(codes, seed)
    n = np.diff(off)
    periods = np.where(n >= least, n // times, 0)
    text = np.repeat(np.arange(len(n)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(least, times * period) - period
    points = (n[text] - period - 1) // step + 1
    upto = np.cumsum(points)
    found = [np.zeros((0, 4), np.int64)]
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        for at, p, t in _grid(text[a:b], period[a:b], step[a:b], points[a:b], off):
            same = codes[at] == codes[at + p]
            at, p, t = at[same], p[same], t[same]
            ahead = 1 + extend(lambda i, k, at=at, p=p: hashes.equal(at[i] + 1, p[i], k), off[t + 1] - at - p - 1)
            back = extend(lambda i, k, at=at, p=p: hashes.equal(at[i] - k, p[i], k), at - off[t])
            long = back + ahead + p >= np.maximum(least, times * p)
            found.append(np.stack((t, at - back, at + ahead + p, p), 1)[long])
        a = b
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.concatenate(([True], (runs[1:, :3] != runs[:-1, :3]).any(1)))[: len(runs)]]
    if not all(np.array_equal(codes[s : e - p], codes[s + p : e]) for _, s, e, p in runs):
        return find_runs(codes, off, least, times, seed + 1)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _grid(text: np.ndarray, period: np.ndarray, step: np.ndarray, points: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grid points with their period and text, about PAIRS at a time even where a single period has more."""
    for k in range(0, max(1, int(points.max())), PAIRS):
        here = np.clip(points - k, 0, PAIRS)
        i = np.repeat(np.arange(len(text)), here)
        number = k + np.arange(len(i)) - np.repeat(np.cumsum(here) - here, here)
        yield off[text[i]] + number * step[i], period[i], text[i]


def _finder(least: int, times: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column(kept).cast(pa.large_string()).fill_null("")).to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)] if len(size) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                words, off = split_words(batch.column(kept).slice(i, j - i))
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                runs = find_runs(codes, off, least, times)
                t, s, e, p = runs.T
                marks = np.zeros(len(words) + 1, np.int64)
                np.add.at(marks, s + p, 1)
                np.add.at(marks, e, -1)
                keep = np.cumsum(marks[:-1]) == 0
                left = np.concatenate(([0], np.cumsum(keep)))[off]
                lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(keep)))
                rows = pa.StructArray.from_arrays([pa.array(s - off[t]), pa.array(e - s), pa.array(p)], names=["start", "length", "period"])
                held = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=j - i))))
                plain = [batch.column(k).slice(i, j - i) for k in range(kept)]
                yield pa.RecordBatch.from_arrays([*plain, pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), rows), pc.binary_join(lists, pa.scalar(" ", words.type)).cast(pa.string())], names=[*batch.schema.names[:kept], "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """The columns ``keep`` with n_words, runs (start, length, period in words, by start and period) and the collapsed text.

    In the collapsed text a word goes if a run contains it beyond the run's
    first period; the others are joined by one space.  Null and empty texts,
    and those of white space, have no word, no run and an empty collapsed
    text.  Every row counts by itself: repeated rows and null keys stay.
    Nothing is shuffled.
    """
    own = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(_finder(least, times, len(keep)), f"{fields}, n_words bigint, runs array<{RUN}>, collapsed string")


def with_loops(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in which one text of ten, by crc32 of its id, runs into a loop.

    With h that checksum and g = h div 10, the text's n words from word
    a = g mod n on repeat the first 1 + (n - a) div (3 + g mod 8) of them to
    the text's end.  Rows without id, or without a word, stay.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.filter(F.split(F.when(chosen, F.coalesce(text, F.lit(""))), WORD), lambda w: w != "")
    n, g = F.size("__words").cast("long"), F.col("__g")
    df = docs.withColumn("__words", words).withColumn("__g", F.floor(h / 10))
    df = df.withColumn("__a", F.when(n > 0, g % n)).withColumn("__p", 1 + F.expr("(cast(size(__words) as bigint) - __a) div (3 + __g % 8)"))
    looped = F.array_join(F.transform("__words", lambda w, i: F.when(i < F.col("__a"), w).otherwise(F.get("__words", (F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int")))), " ")
    return df.withColumn(text, F.when(F.col("__a").isNotNull(), looped).otherwise(F.col(text))).drop("__words", "__g", "__a", "__p")


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest exact length by period; of equal ones the first."""
    none = f"cast(null as {RUN})"
    return F.expr(f"aggregate({runs}, {none}, (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the strongest, and checksums of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.withColumn("__best", strongest())
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"__best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * __best.length) div __best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
