"""Repair of conversations: the cheapest edits that give each one a sound shape.

A sound conversation has the role initials ``(s?(ua)+)?``.  Rows are kept (K,
cost 0), get the role that is due (R, 1), are deleted (D, 2; blank and
repeated ones have to be) or an empty row of the role that is due is inserted
(I, 5); a truncated row that stays costs 5 more.  Of equally cheap edits those
with the ASCII-least initials, the audit, are made.

*Signatures.*  A row is one letter: its role initial, in capitals if it is
truncated, or ``d`` where it must go.  A conversation is its letters in order,
in blocks of BLOCK rows, so that no task needs a whole long one.  Conversations
share signatures, so each distinct block is solved once, by memoised recursion
over its suffixes, for every state before and after it.

*Long conversations.*  Blocks are joined up by costs and ranks of audits alone,
a slim row for each block: inserted rows belong to the row that follows, so two
equally cheap audits of a block differ before either ends, and the choices of
the blocks do not hang on each other's audits.

*Replay.*  Audits are joined back and replayed over the rows in order, as a
stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .scratch import Scratch

BLOCK = 256
START, SYSTEM, USER, ASSISTANT = range(4)  # what the last role was
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # what completes a conversation that ends there
NEVER = 1 << 40
LEGAL = ("su", "ua", "au")
#: The order of a turn's rows: by role, the text's beginning, and hashes of both.
ORDER = {"role": "role", "start": "substring(text, 1, 32)", "h1": "xxhash64(role, text)", "h2": "xxhash64(text, 7, role)"}
SOLVED = "signature string, cost array<bigint>, rank array<int>, audit array<string>"


def keeps(letter: str, state: int) -> int | None:
    """The state after a row that is kept as it is; None where it does not fit."""
    if letter == "s" and state == START:
        return SYSTEM
    to = {"u": USER, "a": ASSISTANT}.get(letter)
    return to if to is not None and DUE[state] == to else None


@lru_cache(maxsize=1 << 15)
def solve(letters: str, state: int, end: int) -> tuple[int, str]:
    """Cost and audit of the best edits of ``letters`` from one state to another; NEVER where there are none."""
    if not letters:
        return (0, "") if state == end else (NEVER, "")
    row, rest = letters[0], letters[1:]
    options = []
    for inserted in range(3):  # a third would only lead back
        steps = [("D", DELETE, state)]
        if row != "d":
            more = TRUNCATED if row.isupper() else 0
            to = keeps(row.lower(), state)
            steps += [("K", KEEP + more, to)] if to is not None else []
            steps.append(("R", REROLE + more, DUE[state]))
        for name, cost, to in steps:
            after, audit = solve(rest, to, end)
            options.append((inserted * INSERT + cost + after, "I" * inserted + name + audit))
        state = DUE[state]
    return min((o for o in options if o[0] < NEVER), default=(NEVER, ""))


def solve_block(signature: str) -> tuple[list[int], list[int], list[str]]:
    """Costs, ranks among the audits from the same state, and audits, by 4 * state before + state after."""
    cost, rank, audit = [], [], []
    for state in range(4):
        got = [solve(signature, state, end) for end in range(4)]
        order = sorted(range(4), key=lambda e: got[e][1])
        cost += [g[0] for g in got]
        rank += [order.index(e) for e in range(4)]
        audit += [g[1] for g in got]
    return cost, rank, audit


def _solver(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [solve_block(s) for s in b["signature"]]
        yield pd.DataFrame({"signature": b["signature"], "cost": [g[0] for g in got], "rank": [g[1] for g in got], "audit": [g[2] for g in got]})


def join_up(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[int]]:
    """The least cost of a whole conversation, and each block's choice (4 * state before + state after)."""
    togo = [[INSERT * len(TAIL[q]) for q in range(4)]]
    for c in reversed(costs):
        togo.append([min(c[4 * q + e] + togo[-1][e] for e in range(4)) for q in range(4)])
    togo.reverse()
    state, choices = START, []
    for c, r, after, now in zip(costs, ranks, togo[1:], togo, strict=False):
        end = min((e for e in range(4) if c[4 * state + e] + after[e] == now[state]), key=lambda e: r[4 * state + e])
        choices.append(4 * state + end)
        state = end
    return togo[0][START], choices


PIECE = "conv_id bigint, piece bigint, signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of conversation and turn: a row for each block of a conversation, with what it has of faults, roles and turns."""
    names, kinds = zip(*(f.split() for f in PIECE.split(", ")), strict=True)
    now: dict | None = None
    made = 0
    out: list[dict] = []

    def close(task: int) -> None:
        nonlocal made
        out.append(now | {"piece": (task << 40) + made, "signature": "".join(now["signature"])})
        made += 1

    def flush() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], pa.int64() if kind == "bigint" else pa.string()) for n, kind in zip(names, kinds, strict=True)], names=names)
        out.clear()
        return got

    task = 0
    for b in batches:
        for conv, turn, initial, blank, cut, again, n, task in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "blank", "cut", "again", "n", "task")), strict=True):
            for k in range(n):
                fault = "blank" if blank else "duplicate" if again or k else "truncated" if cut else None
                if now is None or now["conv_id"] != conv or len(now["signature"]) == BLOCK:
                    if now is not None:
                        close(task)
                    now = {"conv_id": conv, "signature": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": initial, "last": None, "low": None, "high": None, "turns": 0}
                if now["last"] is not None:
                    now["illegal"] += now["last"] + initial not in LEGAL
                now["last"] = initial
                letter = initial if initial in ("s", "u", "a") else "x"
                now["signature"].append("d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
                if fault:
                    now[fault] += 1
                if turn is not None:
                    now["turns"] += turn != now["high"]
                    now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
                if len(out) >= 4096:
                    yield flush()
    if now is not None:
        close(task)
    yield flush()


def _joiner(one: pd.DataFrame) -> pd.DataFrame:
    one = one.sort_values("piece")
    cost, choices = join_up([list(c) for c in one["cost"]], [list(r) for r in one["rank"]])
    return pd.DataFrame({"conv_id": one["conv_id"], "piece": one["piece"], "signature": one["signature"], "choice": choices, "total": cost})


def _replayer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each conversation's audits (in order) and then its rows: the checksum of the repaired conversation."""
    now, state = None, None
    got: list[tuple] = []

    class Replay:
        def __init__(self):
            self.audit: list[str] = []
            self.ops: Iterator[str] | None = None
            self.sum, self.last, self.any = hashlib.sha256(), START, False

        def put(self, role: str, text: str) -> None:
            self.sum.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.any = True

        def due(self, text: str) -> None:
            self.last = DUE[self.last]
            self.put(ROLES[self.last], text)

        def row(self, role: str, text: str) -> None:
            if self.ops is None:
                self.ops = iter("".join(self.audit))
            op = next(self.ops)
            while op == "I":
                self.due("")
                op = next(self.ops)
            if op == "K":
                self.last = SYSTEM if self.last == START and role[:1] == "s" else DUE[self.last]
                self.put(role, text)
            elif op == "R":
                self.due(text)

        def end(self) -> str:
            for _ in self.ops if self.ops is not None else ():
                self.due("")
            return self.sum.hexdigest()

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], names=["conv_id", "audit", "repaired_sha256"])
        got.clear()
        return out

    begun = False
    for b in batches:
        for conv, kind, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "kind", "role", "text")), strict=True):
            if not begun or conv != now:
                if begun:
                    got.append((now, "".join(state.audit), state.end()))
                now, state, begun = conv, Replay(), True
            if kind == 0:
                state.audit.append(text)
            else:
                state.row(role, text)
        if len(got) >= 4096:
            yield batch()
    if begun:
        got.append((now, "".join(state.audit), state.end()))
    yield batch()


def ordering() -> list[Column]:
    return [F.expr(x).alias(c) for c, x in ORDER.items()]


def damaged(talks: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): ``talks`` with faults put in by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats
    it, 4 makes its role user.  A null role or text is one space, and so is a
    null in the checked string.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    df = talks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), k.alias("__k")).where("__k <> 0")
    text = F.when(F.col("__k") == 1, "").when(F.col("__k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__k") == 4, "user").otherwise(F.col("role"))
    df = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), "__k")
    return df.withColumn("__twice", F.explode(F.sequence(F.lit(1), F.when(F.col("__k") == 3, 2).otherwise(1)))).drop("__k", "__twice")


def _slim(s: Scratch, rows: DataFrame) -> DataFrame:
    """A row for each distinct row of a turn, with how often it is there, what it lacks, and whether an earlier turn has its role and text.

    Contents are told by 128 bits of hashes.  Both counts are made before the
    shuffle, so a row or a content that fills a conversation is one row there.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    slim = rows.select("conv_id", "turn", *ordering(), F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("cut"))
    slim = s.table(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("n")), "slim")
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    several = slim.where(~F.col("blank")).groupBy("conv_id", "h1", "h2").agg(F.count(F.lit(1)).alias("turns"), F.min(turn).alias("since")).where("turns > 1")
    several = several.select(F.col("conv_id").alias("__c"), F.col("h1").alias("__1"), F.col("h2").alias("__2"), "since")
    same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("h1") == F.col("__1")) & (F.col("h2") == F.col("__2"))
    return slim.join(several, same, "left").withColumn("again", F.coalesce(F.col("since") < turn, F.lit(False))).drop("__c", "__1", "__2", "since")


def repair(spark: SparkSession, talks: DataFrame) -> DataFrame:
    """A row for each conv_id of ``talks`` (conv_id, turn, role, text): its faults, the cheapest edits and the repaired text's checksum.

    Columns: gaps (turns that are missing between the least and the largest),
    blank, duplicate, truncated (rows by their first fault), illegal
    (neighbours whose role initials are none of su, ua, au), cost, audit,
    repaired_sha256 (of ``role:text``, joined by newlines).

    Rows are taken by turn, nulls first; rows of one turn by role, then by
    the text's first 32 characters and by hashes, so repeated rows stand
    together.  Rows without a
    conv_id are a conversation of their own.  A null role or text counts as
    an empty one.  A conversation without rows does not appear: the caller
    knows which there were.  The checksum of one conversation is made by one
    task, a stream over its rows; nothing else needs a whole conversation.
    """
    rows = talks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    s = Scratch(spark, "repair")
    order = ["conv_id", "turn", *ORDER]
    slim = _slim(s, rows).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = slim.select("conv_id", "turn", "initial", "blank", "cut", "again", "n", F.spark_partition_id().cast("long").alias("task"))
    pieces = s.table(pieces.mapInArrow(_pieces, PIECE), "pieces")
    solved = s.table(pieces.select("signature").distinct().mapInPandas(_solver, SOLVED), "solved")
    # a conversation of one block has its answer at once
    met = pieces.select("conv_id", "piece", "signature").join(solved, "signature")
    many = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select(F.col("conv_id").alias("__c"))
    many = s.table(many, "many")
    long = F.col("conv_id").eqNullSafe(F.col("__c"))
    tail = [INSERT * len(TAIL[q]) for q in range(4)]
    ends = F.array(*(F.struct((F.col("cost")[q] + tail[q]).alias("total"), F.col("rank")[q].alias("r"), F.lit(q).alias("choice")) for q in range(4)))
    one = met.join(many, long, "left_anti").withColumn("__end", F.array_min(ends)).select("conv_id", "piece", "audit", F.col("__end.choice").alias("choice"), F.col("__end.total").alias("total"))
    chained = met.join(many, long, "left_semi").select("conv_id", "piece", "signature", "cost", "rank")
    chained = chained.groupBy("conv_id").applyInPandas(_joiner, "conv_id bigint, piece bigint, signature string, choice int, total bigint")
    chained = chained.join(solved.select("signature", "audit"), "signature")
    last = F.col("piece") == F.max("piece").over(Window.partitionBy("conv_id"))
    chosen = one.unionByName(chained.select(*one.columns)).withColumn("__last", last)
    tails = F.element_at(F.array(*(F.lit(TAIL[q]) for q in range(4))), F.col("choice") % 4 + 1)
    audit = F.concat(F.get("audit", F.col("choice")), F.when(F.col("__last"), tails).otherwise(""))
    chosen = s.table(chosen.select("conv_id", "piece", "total", audit.alias("audit")), "chosen")

    nothing = {c: F.lit(None).cast("long" if c.startswith("h") else "string").alias(c) for c in ORDER}
    head = chosen.select("conv_id", F.lit(0).alias("kind"), F.col("piece").alias("turn"), *nothing.values(), F.col("audit").alias("text"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", *ordering(), "text")
    stream = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", *ORDER)
    sums = stream.select("conv_id", "kind", "role", "text").mapInArrow(_replayer, "conv_id bigint, audit string, repaired_sha256 string")

    w = Window.partitionBy("conv_id").orderBy("piece")
    border = pieces.withColumns({"__was": F.lag("last").over(w), "__high": F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    bad = F.when(F.col("__was").isNotNull() & ~F.concat("__was", "first").isin(*LEGAL), 1).otherwise(0)
    counts = border.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.when(F.col("__high") == F.col("low"), 1).otherwise(0)), F.lit(0)).alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + bad).alias("illegal"),
    )
    costs = chosen.groupBy("conv_id").agg(F.max("total").alias("cost"))
    same = lambda x: F.col("conv_id").eqNullSafe(F.col(x))
    out = counts.join(costs.withColumnRenamed("conv_id", "__a"), same("__a")).join(sums.withColumnRenamed("conv_id", "__b"), same("__b"))
    out = s.table(out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), "out")
    s.close("out")
    return out


def repaired_report(spark: SparkSession, talks: DataFrame) -> DataFrame:
    """``repair`` of the damaged conversations, a row for every conv_id that ``talks`` has; those without rows have zeros and an empty text's checksum."""
    done = repair(spark, damaged(talks)).withColumnRenamed("conv_id", "__c")
    ids = talks.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(done, F.col("conv_id").eqNullSafe(F.col("__c")), "left").drop("__c")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))})
