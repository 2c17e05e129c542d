"""Language-model scores, conversation repair and periodic runs against plain versions."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, SMALL
from pyspark.sql import functions as F
from tidemark.llm import lm, repair, runs
from tidemark.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- language-model scores --------------------------------------------------


def plain_scores(docs, order=2):
    """docs: id to (text, role). Base figures and interpolated scores with weights from exact ratios."""
    tokens = {i: [*WORD.findall(lowered(t)), "</s>"] for i, (t, _) in docs.items()}
    count, fold = Counter(), Counter()
    context, fold_context = Counter(), Counter()

    def grams(i):
        seq = ["<s>"] * (order - 1) + tokens[i]
        for j in range(order - 1, len(seq)):
            for k in range(1, order + 1):
                yield tuple(seq[j - k + 1 : j + 1])

    for i, (_, role) in docs.items():
        for g in grams(i):
            if role != lm.SCORED:
                count[g] += 1
                context[g[:-1]] += 1
            if role == lm.FOLD:
                fold[g] += 1
                fold_context[g[:-1]] += 1
    n, types = context[()], sum(1 for g in count if len(g) == 1)

    def em(pairs):
        r, w = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
        x = 0.5
        for _ in range(5000):
            x = min(1 - lm.EDGE, max(lm.EDGE, float((w * (x * r / (x * r + 1 - x))).sum() / w.sum())))
        return x

    weights = {}

    def weight(k, c):
        if k == 1:
            return weights.get((1, 0), 0.0)
        mine = [b for kk, b in weights if kk == k]
        b = int(math.log2(c))
        return weights[k, min(mine, key=lambda x: (abs(x - b), x))] if mine else 0.0

    def probability(g, c, d, upto):
        p = 1 / (types + 1)
        for k in range(1, upto + 1):
            own = g[len(g) - k :]
            if d[own[:-1]]:
                w = weight(k, d[own[:-1]])
                p = w * c[own] / d[own[:-1]] + (1 - w) * p
        return p

    est, est_context = count - fold, context - fold_context
    for k in range(1, order + 1):
        by = defaultdict(list)
        for g, m in fold.items():
            d = est_context[g[:-1]]
            if len(g) == k and d:
                by[0 if k == 1 else int(math.log2(d))].append((est[g] / d / probability(g, est, est_context, k - 1), m))
        weights |= {(k, b): em(v) for b, v in by.items()}
    out = {}
    for i in docs:
        base = sum(math.log10((count[(t,)] + 0.5) / (n + 0.5 * (types + 1))) for t in tokens[i])
        score = sum(math.log10(probability(g, count, context, order)) for g in grams(i) if len(g) == order)
        out[i] = (len(tokens[i]), sum(count[(t,)] > 0 for t in tokens[i]), n, base, score)
    return out


def compare_scores(got, want, rel=1e-3):
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:3] == w[:3], i
        assert got[i][3] == pytest.approx(w[3], rel=1e-9, abs=1e-9)
        assert got[i][4] == pytest.approx(w[4], rel=rel, abs=1e-9)


def scored(spark, docs, order=2, block=None, monkeypatch=None):
    df = spark.createDataFrame([(i, t, r) for i, (t, r) in docs.items()], "doc_id long, text string, role int").repartition(3)
    out = lm.fit_and_score(spark, df, F.col("role"), order)
    return {r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out.collect()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    out = {}
    for i in range(120):
        seq = [rng.choice(words[: rng.choice([5, 40])]) for _ in range(rng.choice([1, 8, 60]))]
        out[i] = (rng.choice([" ", "\n", "\t "]).join(seq).replace("w1 ", "W1 "), rng.choice([0, 1, 1, 2]))
    out |= {200: (None, 0), 201: ("", 1), 202: (" \n\x0b", 2), 203: ("never seen words", 0), 204: out[3], 205: ("ßtraße 日本語 w3", 1)}
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_plain_counts(spark, texts, order):
    compare_scores(scored(spark, texts, order), plain_scores(texts, order))


def test_scores_do_not_depend_on_blocks(spark, texts, monkeypatch):
    """Documents longer than a block are cut, and texts of many slices hashed in parts."""
    long = {**texts, 300: (" ".join(f"w{i * i % 37}" for i in range(900)), 1)}
    from pyspark import cloudpickle

    monkeypatch.setattr(lm, "BLOCK", 50)  # read where blocks are made: the functions travel with their module's values
    cloudpickle.register_pickle_by_value(lm)
    try:
        got = scored(spark, long, 3)
    finally:
        cloudpickle.unregister_pickle_by_value(lm)
    compare_scores(got, plain_scores(long, 3))


def test_nothing_to_learn_from(spark, texts):
    alone = {i: (t, 0) for i, (t, _) in list(texts.items())[:20]}
    assert all(v[1:] == (0, 0, 0.0, 0.0) for v in scored(spark, alone).values())
    empty = lm.fit_and_score(spark, spark.createDataFrame([], DOC), F.lit(1))
    assert empty.count() == 0
    without_fold = {i: (t, min(r, 1)) for i, (t, r) in texts.items()}
    compare_scores(scored(spark, without_fold), plain_scores(without_fold))


def test_repeated_rows_null_ids_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b a", 1, 0), (1, "a b a", 1, 0), (None, "b", 1, 0), (2, "c", 2, 0)], "doc_id long, text string, role int, task int").withColumn("block", F.lit(1))
    rows = lm.fit_and_score(spark, df, F.col("role")).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows) == [(-1, 2), (1, 4), (1, 4), (2, 2)]
    assert {r["train_tokens"] for r in rows} == {12}


def test_lm_query(spark):
    rows = {r["doc_id"]: r for r in Q.QUERIES["op11_lm_scores"](spark, SMALL).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    k = {i: zlib.crc32(str(i).encode()) % 5 for i in docs}
    want = plain_scores({i: (t, {1: 0, 2: 2}.get(k[i], 1)) for i, t in docs.items()})
    compare_scores({i: tuple(rows[i][c] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")) for i in rows}, want)
    assert all(rows[i]["held_out"] == (k[i] == 1) for i in docs)
    held = [i for i in docs if k[i] == 1]
    assert sum(rows[i]["score"] for i in held) > sum(rows[i]["base_score"] for i in held)


# --- sets of cells, and sieves -----------------------------------------------


def test_large_sets_are_compared_by_ranges(monkeypatch):
    from tidemark.llm import ngram_join

    rng = np.random.default_rng(0)
    pool = rng.integers(-(2**63), 2**63 - 1, 3000)
    sets = [np.sort(rng.choice(pool, rng.integers(0, 2000), replace=False).view(np.uint64)).view(np.int64) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    for most in (1 << 20, 1000, 100):
        monkeypatch.setattr(ngram_join, "ELEMENTS", most)
        assert ngram_join.shared(sets, i, j).tolist() == want


@pytest.mark.parametrize("words", [1 << 19, 4])
def test_a_sieve_loses_no_key_and_no_row(spark, monkeypatch, words):
    """Also when it is far too small for its keys, and with null and repeated ones."""
    from tidemark.llm import scratch

    monkeypatch.setattr(scratch, "WORDS", words)
    s = scratch.Scratch(spark, "sieve")
    keys = s.table(spark.range(0, 3000, 3).select("id", F.when(F.col("id") % 2 == 0, "x").alias("kind")))
    df = spark.range(3000).select(F.when(F.col("id") != 5, F.col("id")).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"), F.lit(1).alias("id"))
    df = df.unionByName(df.where("a = 6"))
    maybe, none = scratch.Sieve(keys, "id", "kind").split(df, F.col("a"), F.col("b"))
    assert maybe.count() + none.count() == 3001 and maybe.columns == df.columns
    assert none.where("a % 3 = 0").count() == 0 and maybe.where("a = 6").count() == 2
    if words > 4:
        assert maybe.count() < 1300
    s.close()


# --- conversation repair ----------------------------------------------------

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def plain_repair(rows):
    """rows (turn, role, text) in order: the figures of a repair, by a search for the cheapest path."""
    seen, faults = set(), []
    for _, r, x in rows:
        ends = re.sub(r"[\x20\x09-\x0D]+\Z", "", x)
        faults.append("b" if not WORD.search(x) else "d" if (r, x) in seen else "t" if ends[-1] not in ".!?" else None)
        seen.add((r, x))
    heap, done, n = [(0, "", 0, 0)], set(), len(rows)
    while True:
        c, a, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n and q in (0, 3):
            break
        heapq.heappush(heap, (c + 5, a + "I", i, NEXT[q]))
        if i < n:
            heapq.heappush(heap, (c + 2, a + "D", i + 1, q))
            if faults[i] not in ("b", "d"):
                m, r = (5 if faults[i] == "t" else 0), rows[i][1][:1]
                if r == "s" and q == 0:
                    heapq.heappush(heap, (c + m, a + "K", i + 1, 1))
                elif r in ("u", "a") and NEXT[q] == {"u": 2, "a": 3}[r]:
                    heapq.heappush(heap, (c + m, a + "K", i + 1, NEXT[q]))
                heapq.heappush(heap, (c + 1 + m, a + "R", i + 1, NEXT[q]))
    q, i, out = 0, 0, []
    name = {2: "user", 3: "assistant"}
    for op in a:
        if op == "I":
            q = NEXT[q]
            out.append(name[q] + ":")
            continue
        _, r, x = rows[i]
        i += 1
        if op == "K":
            q = 1 if r[:1] == "s" and q == 0 else NEXT[q]
            out.append(f"{r}:{x}")
        elif op == "R":
            q = NEXT[q]
            out.append(f"{name[q]}:{x}")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(b[1][:1] + e[1][:1] not in ("su", "ua", "au") for b, e in zip(rows, rows[1:], strict=False))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, c, a, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_report(talks):
    by, ids = defaultdict(list), set()
    shown = lambda v: " " if v is None else str(v)
    for c, t, r, x in talks:
        ids.add(c)
        k, r, x = zlib.crc32(f"{shown(c)}:{shown(t)}".encode()) % 20, shown(r), shown(x)
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            by[c] += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    order = lambda v: (v[0] is not None, v[0] or 0, v[1], v[2])
    return {c: plain_repair(sorted(by.get(c, []), key=order)) for c in ids}


def odd_talks():
    rng = random.Random(5)
    texts = ["hi.", "yo", "", "  ", "ok! ", None, "what?\n", "same."]
    talks = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for c in [None, *range(1, 30)] for _ in range(rng.choice([1, 3, 9]))]
    talks += [(99, i, rng.choice(["user", "assistant", "system"]), rng.choice([f"a{i}.", f"b{i}", "c.", ""])) for i in range(900)]  # several blocks
    return talks + [(98, 3, "user", "same.")] * 700 + [(97, t, "assistant", "same.") for t in range(300)]


TALKS = "conv_id long, turn long, role string, text string"


def test_repair_against_a_search_for_the_cheapest_path(spark):
    talks = odd_talks()
    df = spark.createDataFrame(talks, TALKS).withColumns({"start": F.lit(1), "h1": F.lit("x"), "n": F.lit(2)}).repartition(3)
    rows = repair.repaired_report(spark, df).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in rows} == plain_report(talks)
    assert len(rows) == len({t[0] for t in talks})
    assert repair.repaired_report(spark, spark.createDataFrame([], TALKS)).count() == 0


def test_blocks_join_up_to_the_best_whole():
    rng = random.Random(1)
    for _ in range(200):
        whole = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(0, 12)))
        best = min((lambda g: (g[0] + 5 * len(repair.TAIL[e]), g[1] + repair.TAIL[e]))(repair.solve(whole, 0, e)) for e in range(4))
        cuts = sorted(rng.sample(range(1, len(whole)), min(2, len(whole) - 1))) if len(whole) > 1 else []
        parts = [whole[i:j] for i, j in zip([0, *cuts], [*cuts, len(whole)], strict=True) if i < j]
        solved = [repair.solve_block(p) for p in parts]
        cost, choices = repair.join_up([x[0] for x in solved], [x[1] for x in solved])
        audit = "".join(x[2][k] for x, k in zip(solved, choices, strict=True)) + (repair.TAIL[choices[-1] % 4] if choices else "")
        assert (cost, audit) == best, whole


def test_repair_query(spark):
    talks = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = Q.QUERIES["op12_conversation_repair"](spark, DATA).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in rows} == plain_report(talks)


def test_repair_sql_on_odd_conversations():
    """The SQL gives what the search gives, where the query's tables have no such cases too."""
    import duckdb

    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", odd_talks())
    assert {r[0]: r[1:] for r in con.sql(Q.ORACLES["op12_conversation_repair"]).fetchall()} == plain_report(odd_talks())


# --- periodic runs ----------------------------------------------------------


def plain_runs(w, least=6, times=4):
    out, ends, n = [], set(), len(w)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p) and (i, j + p) not in ends:
                ends.add((i, j + p))
                out.append((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = plain_runs(w)
    gone = {i for s, k, p in found for i in range(s + p, s + k)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{k},{p}\n" for s, k, p in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def looping_texts():
    rng = random.Random(3)
    out = []
    for _ in range(300):
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGH"[: rng.choice([1, 2, 3, 30])]
        n = rng.choice([0, 3, 6, 7, 20, 100])
        w = [rng.choice(letters) for _ in range(n)]
        if rng.random() < 0.5 and n > 10:
            a, p = rng.randrange(n), rng.randint(1, 9)
            w[a:] = [w[a + (i - a) % p] for i in range(a, n)]
        out.append(rng.choice(["", " ", "\n\x0b"]) + rng.choice([" ", "\t \r"]).join(w) + rng.choice(["", " ", "\x0c"]))
    thue = [0]
    for _ in range(11):  # prefix hashes modulo a power of two fail on this one
        thue += [1 - x for x in thue]
    return [*out, None, "a\x1cb \x85   c a b", "x " * 5000, " ".join("no yes".split()[x] for x in thue), " ".join(str(i) for i in range(3000))]


@pytest.mark.parametrize(("least", "times"), [(6, 4), (1, 2), (10, 3)])
def test_runs_against_every_period(least, times):
    texts = [t for t in looping_texts() if t is None or len(t) < 4200]
    words, off = runs.split_words(pa.array(texts))
    for i, t in enumerate(texts):
        assert words.slice(off[i], off[i + 1] - off[i]).to_pylist() == WORD.findall(t or "")
    codes = words.dictionary_encode().indices.to_numpy()
    got = defaultdict(list)
    for t, s, e, p in runs.find_runs(codes, off, least, times).tolist():
        got[t].append((s - off[t], e - s, p))
    for i in range(len(texts)):
        assert got[i] == plain_runs(codes[off[i] : off[i + 1]].tolist(), least, times)


def test_hashes_that_lie_are_found_out(monkeypatch):
    """With primes this small nearly everything collides; the runs stay right."""
    monkeypatch.setattr(runs, "PRIMES", (2_097_143, 2_097_143))
    codes = np.array([0, 1, 2, 0, 1, 2, 0, 1, 2, 0, 1, 2, 3, 4] * 3)
    want = plain_runs(codes.tolist())
    real = runs.Prefixes

    class Lies(real):
        def __init__(self, codes, seed):
            super().__init__(codes, seed)
            self.seed = seed

        def equal(self, x, period, length):
            return np.ones(len(x), bool) if self.seed < 3 else super().equal(x, period, length)

    monkeypatch.setattr(runs, "Prefixes", Lies)
    got = [(s, e - s, p) for _, s, e, p in runs.find_runs(codes, np.array([0, len(codes)])).tolist()]
    assert got == want


def test_runs_of_rows(spark):
    texts = looping_texts()
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = Counter(tuple(r) for r in runs.digest(runs.periodic_runs(runs.with_loops(df), ["doc_id"])).collect())
    assert got == Counter(plain_digest(i, t) for i, t, _ in rows)
    assert runs.digest(runs.periodic_runs(df.where("false"), ["doc_id"])).count() == 0


def test_runs_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in Q.QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    assert got == {plain_digest(*r) for r in docs} and any(r[1] for r in got)
