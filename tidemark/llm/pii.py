"""Personal data spans by weak supervision.

Candidate spans come from regular expressions: the base ones, which always
count once their check passes, and looser ones (spelt-out addresses, defanged
IPs, other separators).  Four labelers vote on every candidate: its format, a
gazetteer, the words before it, and the characters around it.  Expectation-
maximisation over the counts of vote patterns estimates how reliable each
labeler is and how likely each pattern is to be personal data.  A logistic
classifier is trained on those soft labels and decides which loose candidates
are added; besides the votes it sees traits of the span that no labeler looks
at: its length, its signs, how many different digits or letters it has, and
what its line holds.  Only DataFrame and SQL functions run here; the driver
sees counts of vote and trait patterns, ``PATTERNS`` at most.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .spans import let, match_spans

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.9
CONTEXT = 48

# The base patterns match what the plain ones do: where a plain repetition can
# never give back a character, it is written possessively, and a start inside
# a run that failed at the run's start is not tried again.
LOCAL = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]++ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z./_-])(?:[0-9]{4}(?:[./_|]| \| )[0-9]{4}(?:[./_|]| \| )[0-9]{4}(?:[./_|]| \| )[0-9]{4}|3[47][0-9]{13})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ |.-]{1,3})?(?:\([0-9]{3}\)|[0-9]{3})[ |.-]{1,3}[0-9]{3}[ |.-]{1,3}[0-9]{4}(?![0-9A-Za-z])",
}
# What a text must hold for a pattern to be tried at all.
NEEDS = {
    ("email", True): "contains({t}, '@')",
    ("ip", True): "contains({t}, '.')",
    ("card", True): "true",
    ("phone", True): "contains({t}, '+')",
    ("email", False): "contains({t}, '(at)') or contains({t}, '[at]') or contains({t}, '@')",
    ("ip", False): "contains({t}, '[.]') or contains({t}, '(.)')",
    ("card", False): "true",
    ("phone", False): "true",
}
DIGITS = "regexp_replace({m}, '[^0-9]', '')"
LUHN = f"aggregate(sequence(1, length({DIGITS})), 0, (s, i) -> s + if(i % 2 = 1, int(substring({DIGITS}, -i, 1)), 2 * int(substring({DIGITS}, -i, 1)) - if(int(substring({DIGITS}, -i, 1)) > 4, 9, 0))) % 10 = 0"
PARTS = "forall(regexp_extract_all({m}, '[0-9]+', 0), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"
CHECK = {
    "email": "true",
    "ip": PARTS,
    "card": f"length({DIGITS}) between 16 and 19 and {LUHN}",
    "phone": f"length({DIGITS}) between 8 and 15",
}
# The labelers: 1 for, -1 against, 0 abstains.
FORMAT = {
    "email": r"if({m} rlike '^[A-Za-z0-9][A-Za-z0-9._%+ ()\\[\\]-]*(@|at[)\\]]).*[A-Za-z]{2,24}$', 1, -1)",
    "ip": f"if({PARTS} and size(regexp_extract_all({{m}}, '[0-9]+', 0)) = 4, 1, -1)",
    "card": f"if({LUHN}, 1, -1)",
    "phone": f"if(length({DIGITS}) between 8 and 15, 1, if(length({DIGITS}) = 7, 0, -1))",
}
# Generic and country top-level domains, calling codes, ranges of card issuers.
DOMAINS = (
    "com org net edu gov mil int info biz name pro museum aero coop jobs mobi travel tel cat asia app dev blog cloud online shop site store tech xyz club live news page "
    "io co ai me tv cc eu uk de fr es it nl us ca au ch at be pt pl ru jp cn in br mx ar cl pe uy ve ec bo py cr pa do gt hn ni sv cu pr se no fi dk is ie lu li mc gr cy mt cz sk hu ro bg "
    "si hr ba rs mk al ua by md lt lv ee tr il ae sa qa kw om jo lb eg ma tn dz ng ke za gh kr tw hk sg my th vn id ph nz pk bd lk np ir iq kz uz ge am az mn"
).split()
CALLING = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 221 233 234 254 255 256 260 263 "
    "351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 385 386 387 389 420 421 423 502 503 504 505 506 507 591 593 595 598 852 853 855 880 886 960 961 962 963 964 965 966 968 971 972 973 974 975 976 977 992 993 994 995 996 998"
).split()
ISSUERS = "4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[689])|6(?:011|4[4-9]|5|2|0|3)|35(?:2[89]|[3-8])"
GAZETTEER = {
    "email": f"if(lower({{m}}) rlike '[.)\\\\] ]({'|'.join(DOMAINS)})$', 1, -1)",
    # loopback, multicast and reserved ranges are nobody's address
    "ip": "if({m} rlike '^(0+|127|22[4-9]|2[3-5][0-9])[^0-9]', -1, 1)",
    "card": f"if({DIGITS} rlike '^({ISSUERS})', 1, -1)",
    "phone": f"if({{m}} rlike '^[+]', if({DIGITS} rlike '^({'|'.join(CALLING)})', 1, -1), if({DIGITS} rlike '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$', 1, 0))",
}
WORDS = {
    "email": "e-?mail|contact|write|mailto|correo|courriel|schreib",
    "ip": "\\\\bip\\\\b|server|host|address|ping|adresse",
    "card": "card|visa|credit|master|amex|payment|karte|carte|tarjeta",
    "phone": "phone|\\\\btel|call|fax|mobile|cell|anruf|appel|llam",
}
AGAINST = "version|\\\\bv[.]|isbn|issn|invoice|order|figure|section|serial|sha|hash|token|key"


def _fill(template: str, m: str) -> str:
    return template.replace("{m}", m)


def _votes(kind: str, m: str, before: str, after: str) -> str:
    context = f"if(lower({before}) rlike '({WORDS[kind]})[^a-z]*( [a-z]+)?[^a-z]*$', 1, if(lower({before}) rlike '({AGAINST})[^a-z]*$', -1, 0))"
    edge = f"if({before} rlike '[A-Za-z0-9_/=]$' or {after} rlike '^[A-Za-z0-9_/=]', -1, 1)"
    return f"array({_fill(FORMAT[kind], m)}, {_fill(GAZETTEER[kind], m)}, {context}, {edge})"


# Traits of a span that no labeler looks at, each a small whole number below LEVELS.
LEVELS = 5
TRAITS = (
    "cast(least(length({m}) div 8, 4) as int)",
    "least(size(array_distinct(regexp_extract_all({m}, '[^0-9A-Za-z]', 0))), 4)",
    "cast(least(size(array_distinct(regexp_extract_all(lower({m}), '[0-9a-z]', 0))) div 3, 4) as int)",
    r"""case when {before} rlike '(^|\n)[^\n]{{0,3}}$' then 0 when {before} rlike '[:=] ?$' then 1 when {before} rlike '[(\\[<{{"\']$' then 2 when {before} rlike '[0-9] ?$' then 3 else 4 end""",
    r"""case when {after} = '' or {after} rlike '^\n' then 0 when {after} rlike '^[.,;:!?)\\]>}}"\']' then 1 when {after} rlike '^ ?[0-9]' then 3 else 4 end""",
)


def _traits(m: str, before: str, after: str) -> str:
    return "array(" + ", ".join(x.format(m=m, before=before, after=after) for x in TRAITS) + ")"


def _found(df: DataFrame, kind: str, base: bool) -> DataFrame:
    """``df`` with the candidates of one pattern as an array column."""
    name = f"{kind}_{'base' if base else 'loose'}"
    df = match_spans(df, "text", (BASE if base else LOOSE)[kind], "__at", CONTEXT, NEEDS[kind, base].format(t="text"))
    ok = _fill(CHECK[kind], "y.m") if base else "true"
    votes = _votes(kind, "y.m", "y.before", "y.after")
    span = f"named_struct('kind', {KINDS.index(kind)}, 'start', y.start, 'end', y.start + y.length, 'base', {str(base).lower()}, 'votes', {votes}, 'traits', {_traits('y.m', 'y.before', 'y.after')})"
    df = df.withColumn(name, F.expr(f"transform(filter(__at, y -> {ok}), y -> {span})"))
    return df.drop("__at")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, loose): arrays of spans with their votes and traits; loose ones overlap no base one and none of an earlier kind.

    Spans are compared inside blocks of neighbours by start, so a text of very
    many spans costs little more than its length.
    """
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for base in (True, False):
        for kind in KINDS:
            df = _found(df, kind, base)
    df = df.select("doc_id", F.concat(*(f"{k}_base" for k in KINDS)).alias("base"), F.concat(*(f"{k}_loose" for k in KINDS)).alias("loose"))
    return free_of(df, "base", "loose")


def free_of(df: DataFrame, base: str, loose: str, block: int = 256) -> DataFrame:
    """``df`` with the spans of ``loose`` that overlap no span of ``base`` and none of ``loose`` of a lesser kind."""
    none = "cast(array() as array<struct<start: int, end: int, kind: int>>)"
    every = f"concat(transform({base}, x -> struct(x.start as start, x.end as end, -1 as kind)), transform({loose}, x -> struct(x.start as start, x.end as end, x.kind as kind)))"
    df = df.withColumn("__all", F.expr(f"if(size({loose}) = 0, {none}, array_sort({every}))"))
    bounds = "struct(b[0].start as lo, array_max(transform(b, x -> x.end)) as hi, b as spans)"
    cut = f"if(size(e) = 0, array(), transform(sequence(0, (size(e) - 1) div {block}), j -> slice(e, j * {block} + 1, {block})))"
    blocks = f"transform({let('e', '__all', cut)}, b -> {bounds})"
    hit = "exists(cs, c -> c.lo < a.end and c.hi > a.start and exists(c.spans, b -> b.kind < a.kind and b.start < a.end and b.end > a.start))"
    return df.withColumn(loose, F.expr(let("cs", blocks, f"filter({loose}, a -> not {hit})"))).drop("__all")


def estimate(patterns: list[tuple[int, bool, list[int], int]], rounds: int = 40) -> dict[tuple[int, bool, tuple[int, ...]], float]:
    """Soft labels of vote patterns (kind, base, votes, count) by expectation-maximisation.

    Each kind has a prior and each labeler a probability of each vote given
    the truth, smoothed by one pseudo-count; the start takes votes at face value.
    """
    out = {}
    for kind in {p[0] for p in patterns}:
        own = [(tuple(v), b, c) for k, b, v, c in patterns if k == kind]
        post = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v) + 0.2 * b)) for v, b, _ in own]
        for _ in range(rounds):
            mass = [sum(c * (q if y else 1 - q) for (_, _, c), q in zip(own, post, strict=True)) for y in (0, 1)]
            given = []
            for y in (0, 1):
                rows = []
                for j in range(len(own[0][0])):
                    lean = {x: 1.0 + (x == (1 if y else -1)) for x in (-1, 0, 1)}
                    for (v, _, c), q in zip(own, post, strict=True):
                        lean[v[j]] += c * (q if y else 1 - q)
                    total = sum(lean.values())
                    rows.append({x: n / total for x, n in lean.items()})
                given.append(rows)
            prior = [(m + 1) / (sum(mass) + 2) for m in mass]
            fresh = []
            for v, _, _ in own:
                log = [math.log(prior[y]) + sum(math.log(given[y][j][x]) for j, x in enumerate(v)) for y in (0, 1)]
                fresh.append(1 / (1 + math.exp(min(50.0, max(-50.0, log[0] - log[1])))))
            post = fresh
        out |= {(kind, b, v): q for (v, b, _), q in zip(own, post, strict=True)}
    return out


def _features(votes: list[int], traits: list[int]) -> list[int]:
    """Places of a span's features that are 1: a bias, the votes for and against, the levels of its traits."""
    n = 1 + 2 * len(votes)
    return [0, *(1 + 2 * j + (v < 0) for j, v in enumerate(votes) if v), *(n + LEVELS * j + x for j, x in enumerate(traits))]


WIDTH = 1 + 2 * 4 + LEVELS * len(TRAITS)
PATTERNS = len(KINDS) * 2 * 3**4 * LEVELS ** len(TRAITS)


def train(patterns: list[tuple[int, bool, list[int], list[int], int]], steps: int = 200, decay: float = 1e-3) -> list[list[float]]:
    """For each kind, weights of a logistic classifier of spans (kind, base, votes, traits, count), fitted to the soft labels by gradient steps."""
    by_votes = Counter()
    for k, base, v, _, c in patterns:
        by_votes[k, base, tuple(v)] += c
    soft = estimate([(k, base, list(v), c) for (k, base, v), c in sorted(by_votes.items())])
    out = []
    for kind in range(len(KINDS)):
        own = [(_features(v, x), soft[k, base, tuple(v)], c) for k, base, v, x, c in patterns if k == kind]
        w = np.zeros(WIDTH)
        if own:
            x = np.zeros((len(own), WIDTH))
            for i, (places, _, _) in enumerate(own):
                x[i, places] = 1.0
            y, c = np.array([o[1] for o in own]), np.array([o[2] for o in own], float)
            c /= c.sum()
            for _ in range(steps):
                e = c * (1 / (1 + np.exp(-np.clip(x @ w, -50, 50))) - y)
                w -= 1.0 * (x.T @ e + decay * w)
        out.append([float(a) for a in w])
    return out


def find_personal_data(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base, added): arrays of spans (kind, start, end, base, votes, traits), by kind and start.

    Starts and ends count code points, ends excluded.  A null text is empty
    and has no span.  Equal rows give equal results.  Other columns than
    doc_id and text are ignored.
    """
    s = Scratch(spark, "pii")
    found = s.table(candidates(docs), "found")
    spans = found.select(F.explode(F.concat("base", "loose")).alias("x")).groupBy("x.kind", "x.base", "x.votes", "x.traits").agg(F.count(F.lit(1)))
    w = train(sorted(tuple(r) for r in spans.collect()))
    table = "array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in r) + ")" for r in w) + ")"
    votes = f"aggregate(sequence(0, 3), {table}[x.kind][0], (s, j) -> s + if(x.votes[j] = 1, {table}[x.kind][2 * j + 1], if(x.votes[j] = -1, {table}[x.kind][2 * j + 2], 0D)))"
    logit = f"aggregate(sequence(0, {len(TRAITS) - 1}), {votes}, (s, j) -> s + {table}[x.kind][9 + {LEVELS} * j + x.traits[j]])"
    added = F.expr(f"filter(loose, x -> {logit} >= {math.log(threshold / (1 - threshold))!r}D)")
    return found.select("doc_id", "base", added.alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    text = lambda a: f"concat_ws(',', transform(array_sort({a}), x -> concat({names}[x.kind], ':', x.start, ':', x.end)))"
    count = [F.expr(f"cast(size(filter(spans, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    df = found.withColumn("spans", F.concat("base", "added"))
    return df.select("doc_id", *count, F.sha2(F.expr(text("base")).cast("binary"), 256).alias("base_sha256"), F.expr(text("spans")).alias("spans"), F.size("added").cast("long").alias("n_added"))
