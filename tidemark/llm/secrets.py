"""Secret scans with a random forest that removes false positives.

Candidates are long tokens of mixed characters, assigned values and private
keys from their header to their END line (to the last line of the key where
that is cut off).  Each gets features of its length, its character transitions, its
coverage by a dictionary, its likeness to a path, and the words around it.  A
random forest trained on labelled findings keeps or drops it.  For want of
reviewed findings it learns from constructed ones: values that are secrets or
look-alikes by the way they were made, not by any rule over the features, set
into text and found there like any other.  Only DataFrame and SQL functions
(and the DataFrame-based ML library) run here.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, Sieve
from .spans import match_spans

TOKEN = r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/=.-]*+[0-9])(?=[0-9_+/=.-]*+[A-Za-z])[A-Za-z0-9_+/=.-]{16,}+(?![A-Za-z0-9_+/=.-])"
# A name that speaks of a secret, in quotes or not, and what assigns to it.
NAMED = r"(?:password|passwd|pwd|secret|token|api[_-]?key|passphrase|credential)[\"']?[\x20\x09]{0,3}(?:=>|[:=])[\x20\x09]{0,3}"
# Each looks at the one or two characters before it first, as a long look behind is tried at every length.
ASSIGNED = rf"(?i:(?<=[\"'])(?<={NAMED}[\"'])[^\s\"'][^\"'\r\n]{{4,}}+(?=[\"']))"  # words of a pass phrase included
UNQUOTED = rf"(?i:(?<=[:=>][\x20\x09]{{0,3}})(?=[^\s\"',;(){{}}\[\]<>]{{6}})(?<={NAMED})[^\s\"',;(){{}}\[\]<>]{{6,}}+(?![(<\[]))"
LOGIN = r"(?<=:)(?<=://[A-Za-z0-9._%-]{1,64}:)[^\s:@/\"']{4,}+(?=@[A-Za-z0-9])"
HEADER = r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"
PRIVATE = HEADER + r"(?:(?:[^-]|-(?!----))*+-----END [A-Z ]{0,32}PRIVATE KEY-----|(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{32,}+)*+)"
PATTERN = f"{PRIVATE}|{LOGIN}|{ASSIGNED}|{UNQUOTED}|{TOKEN}"
# Formats that providers give their tokens.
KNOWN = (
    "(^|[^A-Za-z0-9])((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22}|glpat-[A-Za-z0-9_-]{20}|xox[abeprs]-[A-Za-z0-9-]{10}|[rs]k_(live|test)_[A-Za-z0-9]{16}|AIza[0-9A-Za-z_-]{35}"
    "|npm_[A-Za-z0-9]{36}|SG[.][A-Za-z0-9_-]{22}[.][A-Za-z0-9_-]{43}|eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,})"
)
KEEP = 0.5
MASK = "<secret>"
# Words that ordinary identifiers, paths and samples are made of.
DICTIONARY = (
    "account address admin array author backup build cache class client code common config content copy count data date default demo dummy echo email "
    "error event example export false field file filter folder format function group html http image import index info input install item java json key "
    "license list local login main message method model module name node null number object option order output package page param parser password path "
    "phone photo post price print product project public query read release report request response result sample script search section select server "
    "service session setting source start state static status string style system table target temp template test text time title total true type "
    "update upload user utils value version video view web width work www"
).split()
NEAR = "secret|token|passw|passphrase|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential"
FEATURES = ("length", "transitions", "digits", "upper", "hex", "distinct", "dictionary", "slashes", "dots", "path", "keyword", "assigned", "quoted", "header", "known", "signs", "login", "spaces")


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``found``: array of (start, end, f array<double>)."""
    df = match_spans(docs, "text", PATTERN, "__at", across=8)
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    n = "cast(length(y.m) as double)"
    share = lambda keep: f"length(regexp_replace(y.m, '[^{keep}]', '')) / {n}"
    f = {
        "length": f"ln({n})",
        # each change between letters of a case, digits and signs
        "transitions": f"(length(regexp_replace(y.m, '(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])', '  ')) - length(y.m)) / 2 / {n}",
        "digits": share("0-9"),
        "upper": share("A-Z"),
        "hex": share("0-9a-fA-F"),
        "distinct": f"size(array_distinct(split(y.m, ''))) / {n}",
        "dictionary": f"1 - length(regexp_replace(lower(y.m), '{words}', '')) / {n}",
        "slashes": f"(length(y.m) - length(translate(y.m, '/', ''))) / {n}",
        "dots": f"(length(y.m) - length(translate(y.m, '.', ''))) / {n}",
        "path": "if(y.m rlike '^[./~]|[.][a-z]{2,4}$|^[a-z]+/[a-z]' or y.before rlike '[/\\\\\\\\:]$', 1D, 0D)",
        "keyword": f"if(lower(y.before) rlike '({NEAR})[^a-z]*$', 1D, if(lower(y.before) rlike '{NEAR}', 0.5D, 0D))",
        "assigned": "if(y.before rlike '[:=][ \"\\']*$', 1D, 0D)",
        "quoted": "if(y.before rlike '[\"\\']$' and y.after rlike '^[\"\\']', 1D, 0D)",
        "header": "if(y.m like '-----BEGIN%', 1D, 0D)",
        "known": f"if(y.m rlike '{KNOWN}', 1D, 0D)",
        "signs": share("!@#$%^&*?~+=|"),
        "login": "if(y.before rlike '://[^/ ]*:$' and y.after like '@%', 1D, 0D)",
        "spaces": f"(length(y.m) - length(translate(y.m, ' ', ''))) / {n}",
    }
    array = ", ".join(f"cast({f[k]} as double)" for k in FEATURES)
    span = f"named_struct('start', y.start, 'end', y.start + y.length, 'm', y.m, 'f', array({array}))"
    return df.withColumn("found", F.expr(f"transform(__at, y -> {span})")).drop("__at")


# Constructed findings.  Each value is made from a row's random hex digits r and words; each stands behind one of the openings of its kind.
NAMES = ("password", "passphrase", "passwd", "db_password", "secret", "client_secret", "token", "access_token", "auth_token", "api_key", "apikey", "API_KEY", "AWS_SECRET_ACCESS_KEY", "private_key", "credential")
SECRETS = (
    "substring(r, 1, 32)", "substring(r, 1, 40)", "r", "translate(base64(unhex(r)), '=', '')", "substring(translate(base64(unhex(r)), '+/=', ''), 1, 16 + n % 24)",
    "concat(upper(substring(r, 1, 4)), '-', substring(translate(base64(unhex(r)), '+/=', ''), 1, 20))", "concat(substring(translate(base64(unhex(r)), '+/=', ''), 1, 10), '_', substring(r, 5, 8), '!')",
    "concat(substring(translate(base64(unhex(r)), '+/=', ''), 1, 16), '.', substring(translate(base64(unhex(r)), '+/=', ''), 17, 20))",
    # what people choose: a word, digits and signs; words of a phrase
    "concat(w[0], n % 99, '!', initcap(substring(r, 1, 3)))", "concat(initcap(w[0]), '-', substring(r, 1, 3), '#', n % 999)", "concat(substring(translate(base64(unhex(r)), '+/=', ''), 1, 7), '$', n % 9)",
    "concat(w[0], ' ', w[1], ' ', w[2], ' ', w[3], ' ', n % 99)", "concat(translate(substring(r, 1, 6), '0123456789', 'ghijklmnop'), ' ', w[1], ' ', translate(substring(r, 7, 5), '0123456789', 'qrstuvwxyz'), ' ', n % 99, ' ', translate(substring(r, 13, 5), '0123456789', 'ghijklmnop'))",
)
LOOKALIKES = (
    "concat(w[0], '/', w[1], '/', w[2], n % 9, '.', substring(w[3], 1, 3))", "concat('/', w[0], '/', w[1], '/', w[2], '/', n % 99, '/', w[3])", "concat(w[0], n % 9, '.', w[1], '.', w[2], '.com')", "concat(w[0], '_', w[1], '_', w[2], '_', n % 99)",
    "concat(w[0], initcap(w[1]), initcap(w[2]), n % 9, initcap(w[3]))", "concat(w[0], '.', w[1], '.', w[2], '.', w[3], n % 9)", "concat('https/', w[0], '.', w[1], '.org/', w[2], '/', n % 999)", "concat('v', n % 9, '.', n % 7, '.', n % 31, '-', w[0], '.', w[1])",
    "concat(w[0], '_', w[1])", "concat(w[0], initcap(w[1]))", "concat('your ', w[0], ' ', w[1])", "concat('$', upper(w[0]), '_', upper(w[1]))", "concat(w[0], '.', w[1], '.', w[2])", "concat('********', repeat('*', n % 4))", "translate(substring(r, 1, 6 + n % 5), '0123456789', 'ghijklmnop')", "initcap(translate(substring(r, 1, 6 + n % 7), '0123456789', 'eeiioouaie'))", "concat(w[0], w[1])", "concat('the ', w[0], ' of the ', w[1], ' is ', w[2])",
    "concat('20', 10 + n % 15, '-0', 1 + n % 9, '-1', n % 9, 'T1', n % 9, '.20.30Z')", "concat('your_', w[0], '_', w[1], '_here_', n % 9)", "concat(repeat('x', 16 + n % 9), n % 9)", "concat(w[0], repeat('-', 1), w[1], '-', w[2], '-', w[3], '-', n % 99)",
)
DIGESTS = ("substring(r, 1, 32)", "substring(r, 1, 40)", "r", "concat(substring(r, 1, 8), '-', substring(r, 9, 4), '-4', substring(r, 13, 3), '-a', substring(r, 16, 3), '-', substring(r, 20, 12))")
PLAIN = ("", "see ", "in ", "file ", "at ", "from (", "open \"", "class ", "version: ", "name = \"", "path: ", "mail to a.b@")
SUMS = ("commit ", "sha256: ", "sha1 ", "md5sum = \"", "checksum: ", "etag = \"", "id: ", "request ", "digest = '", "uuid = \"", "revision ", "hash (")


def constructed(spark: SparkSession, rows: int = 6000, seed: int = 1) -> DataFrame:
    """Labelled findings (m, f, label) of constructed texts: 1 for secrets, 0 for look-alikes.

    Secrets are random values assigned to, or sent under, names that speak of
    them; look-alikes are paths, hosts, names, versions, times and
    placeholders anywhere, under such names too, and digests under names of
    their own.
    """
    text = lambda xs: "array(" + ", ".join("'" + x.replace("'", "\\'") + "'" for x in xs) + ")"
    pick = lambda xs, k: f"element_at(array({', '.join(xs)}), cast(pmod(xxhash64(id, {k}), {len(xs)}) as int) + 1)"
    words = ", ".join(f"element_at({text(DICTIONARY)}, cast(pmod(xxhash64(id, {k}), {len(DICTIONARY)}) as int) + 1)" for k in range(4, 8))
    df = spark.range(seed * 10**9, seed * 10**9 + rows, 1, 8)
    df = df.select("id", F.expr("sha2(cast(id as string), 256) as r"), F.expr("cast(pmod(xxhash64(id, 3), 1000) as int) as n"), F.expr(f"array({words}) as w"))
    df = df.withColumn("__kind", F.expr("cast(pmod(xxhash64(id, 9), 20) as int)"))
    name = f"element_at({text(NAMES)}, cast(pmod(xxhash64(id, 10), {len(NAMES)}) as int) + 1)"
    shown = f"case n % 5 when 0 then concat('\"', {name}, '\"') when 1 then concat('\\'', {name}, '\\'') else {name} end"
    assign = f"concat({shown}, {pick([repr(x) for x in (' = ', '=', ': ', ' : ', ' => ')], 11)}, {{q}})"
    quote = "if(n % 4 > 0, '\"', if(n % 8 = 0, '\\'', ''))"
    opened = assign.replace("{q}", quote)
    bearer = pick(["'Authorization: Bearer '", "'x-api-key: '", "'bearer token '", "'curl -u admin:'", "concat('postgres://', w[0], ':')", "concat('https://', w[0], '.', w[1], ':')"], 12)
    value = f"case when __kind < 10 then {pick(list(SECRETS), 13)} when __kind < 13 then {pick(list(DIGESTS), 14)} else {pick(list(LOOKALIKES), 15)} end"
    before = (
        f"case when __kind < 8 then {opened} when __kind < 10 then {bearer} when __kind < 13 then element_at({text(SUMS)}, cast(pmod(xxhash64(id, 16), {len(SUMS)}) as int) + 1)"
        f" when __kind < 16 then {opened} else element_at({text(PLAIN)}, cast(pmod(xxhash64(id, 17), {len(PLAIN)}) as int) + 1) end"
    )
    df = df.withColumn("__before", F.expr(f"concat(w[3], ' ', w[1], if(n % 2 = 0, '\n', ' '), {before})")).withColumn("__value", F.expr(value))
    # written, as what comes after would repeat these long expressions wherever it names them
    s = Scratch(spark, "constructed")
    df = s.table(df.select("id", "n", "w", "__kind", "__before", "__value"), "values")
    s.close("values")
    df = df.withColumn("__value", F.expr("if(__before rlike '[\"\\']$', __value, if(__before like '%://%:', translate(__value, ' @:/', ''), replace(__value, ' ', '_')))"))  # words of a phrase stand in quotes
    close = "case when __before like '%://%:' then concat('@', w[1], '.example') when __before like '%\"' then '\"' when __before like '%\\'' then '\\'' when __before like '%(' then ')' else '' end"
    df = df.select(F.col("id").alias("doc_id"), F.expr("if(__kind < 10, 1D, 0D)").alias("label"), F.length("__before").alias("__from"), F.expr(f"concat(__before, __value, {close}, if(n % 3 = 0, '\n', ' '), w[2], ' ', w[0])").alias("text"))
    found = candidates(df).select("label", "__from", F.explode("found").alias("x"))
    return found.where(F.col("x.start") <= F.col("__from") + 2).where(F.col("x.end") > F.col("__from")).select("x.m", "x.f", "label")


def _features(df: DataFrame) -> DataFrame:
    df = df.select("*", *(F.col("f")[i].alias(f"__{k}") for i, k in enumerate(FEATURES)))
    return VectorAssembler(inputCols=[f"__{k}" for k in FEATURES], outputCol="features").transform(df).drop(*(f"__{k}" for k in FEATURES))


def train(labelled: DataFrame, most: int = 20_000, trees: int = 24, depth: int = 6) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (m, f, label); ``most`` bounds the rows learnt from, taken by a hash of the value.

    None where the findings hold only one label.
    """
    s = Scratch(labelled.sparkSession, "findings")
    findings = s.table(labelled.select("m", "f", "label").distinct(), "findings")  # a value that is repeated is one row
    s.close("findings")
    counts = {r[0]: r[1] for r in findings.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    share = F.lit(2**31) * F.when(F.col("label") == 1, min(1.0, most / 2 / counts[1.0])).otherwise(min(1.0, most / 2 / counts[0.0]))
    rows = findings.where(F.pmod(F.xxhash64("m"), F.lit(2**31)) < share)
    even = F.when(F.col("label") == 1, 1.0).otherwise(min(1.0, counts[1.0] / counts[0.0]))
    # at most about ``most`` rows, so one task, whose order makes the forest the same each time
    rows = _features(rows.select("m", "f", "label", even.alias("weight"))).repartition(1).sortWithinPartitions("m", "f", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, weightCol="weight").fit(rows)


_forests: dict[str, RandomForestClassificationModel | None] = {}


def _own(spark: SparkSession) -> RandomForestClassificationModel | None:
    """The forest of the constructed findings, fitted once in an application."""
    key = spark.sparkContext.applicationId
    if key not in _forests:
        _forests[key] = train(constructed(spark))
    return _forests[key]


def scan(spark: SparkSession, docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, h, n_candidates, spans): h hashes the text; spans (start, end, score) of the secrets found, by start.

    Without ``labelled`` findings (m, f, label) the forest learns from
    ``constructed`` ones; findings of one label only keep nothing.  Private
    keys and tokens of a known format are kept in any case.  A null text is
    empty.  Equal rows count once.
    """
    s = Scratch(spark, "secrets")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = candidates(docs.select("doc_id", text.alias("text"))).select("doc_id", F.xxhash64("text").alias("h"), "found")
    found = s.table(found, "found")
    rows = found.where("size(found) > 0").dropDuplicates(["doc_id", "h"]).select("doc_id", "h", F.explode("found").alias("x")).select("doc_id", "h", "x.*")
    model = _own(spark) if labelled is None else train(labelled)
    sure = (F.col("f")[FEATURES.index("header")] == 1) | (F.col("f")[FEATURES.index("known")] == 1)
    scored = rows.withColumn("score", F.lit(0.0)) if model is None else model.transform(_features(rows)).withColumn("score", vector_to_array("probability")[1])
    scored = scored.withColumn("score", F.when(sure, F.lit(1.0)).otherwise(F.col("score"))).where(F.col("score") >= KEEP)
    spans = scored.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "score"))).alias("spans"))
    every = found.select("doc_id", "h", F.size("found").cast("long").alias("n_candidates"))
    a, b = every.alias("a"), spans.alias("b")
    out = a.join(b, F.expr("a.doc_id <=> b.doc_id and a.h = b.h"), "left").select("a.*", F.coalesce("b.spans", F.expr("cast(array() as array<struct<start: int, end: int, score: double>>)")).alias("spans"))
    out = s.table(out, "out")
    s.close("out")
    return out


def digest(scanned: DataFrame) -> DataFrame:
    text = "array_join(transform(spans, x -> concat(x.start, ':', x.end)), ',')"
    return scanned.select("doc_id", "n_candidates", F.size("spans").cast("long").alias("n_secrets"), F.expr(text).alias("spans"), F.coalesce(F.array_max(F.expr("transform(spans, x -> x.score)")), F.lit(0.0)).alias("score"))


def redact(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """``docs`` with each secret in text replaced by a mask and n_chars brought up to date, if it is there."""
    hits = scanned.where("size(spans) > 0").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("spans").alias("__spans")).distinct()
    # texts without a secret stay where they are
    maybe, clean = Sieve(hits, "__id", "__h").split(docs, F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    df = maybe.join(hits, F.expr("doc_id <=> __id and xxhash64(coalesce(text, '')) = __h"), "left")
    body = f"aggregate(__spans, named_struct('out', '', 'at', 0), (s, x) -> named_struct('out', concat(s.out, substring(text, s.at + 1, x.start - s.at), '{MASK}'), 'at', x.end), s -> concat(s.out, substring(text, s.at + 1)))"
    df = df.withColumn("text", F.expr(f"if(__spans is null, text, {body})"))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.unionByName(df.select(*docs.columns))
