"""SpotSigs: signatures that start at common words.

Text is lowered and cut into words.  Every common word (anchor) that stands
right before a content word starts a chain: the anchor-free sequence of the
next content words, as many as the chain's length or all that are left.  The
start of a text counts as an anchor.  A document's fingerprint is its set of
chain hashes.  Near fingerprints are found among sets of close lengths only,
by each set's rarest signatures, and compared with Jaccard where lengths
allow.  Only DataFrame and SQL functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ranges import literal, range_index
from .scratch import Scratch, Sieve, if_small

# Frequent function words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "als am auf aus bei das dem den der des die ein eine einer es für ich im ist mit nicht sich sie sind und von vor war wie zu zum zur über "
    "au aux avec ce ces dans de des du elle en est et il la le les mais ne nous on ou par pas pour que qui sa se ses son sur un une vous été "
    "al como con del el ella era esta este los las lo más me mi no nos para pero por su sus también una y ya o "
).split()
CHAIN = 3
MARK = "\x01"
RANGES = 100_000  # of doc_ids, at most; their bounds are part of the plan
BUCKETS = 1 << 16  # of signatures, whose counts order them from rare to frequent
CELL = 128
WORDS = 8  # of a parity sketch, 64 bits each; a power of two
LEAST = 8  # signatures of a class that the first look at its cells knows


def _marked(words: str) -> str:
    """Content words only, each with a mark in front if an anchor stood right before it."""
    anchors = ", ".join(f"'{a}'" for a in sorted(set(ANCHORS)))
    each = f"array_join(transform(split({words}, ' '), x -> if(x in ({anchors}), '{MARK}', x)), ' ')"
    return f"regexp_replace(replace({each}, '{MARK} ', '{MARK}'), '{MARK}+', '{MARK}')"


def signatures(marked: str, chain: int = CHAIN) -> str:
    """The distinct chain hashes of marked content words, sorted."""
    word = rf"[^ {MARK}]++"
    pattern = rf"{MARK}(?=({word}(?: {MARK}?{word}){{0,{chain - 1}}}) )"
    return f"array_sort(array_distinct(transform(regexp_extract_all({marked}, '{pattern}', 1), x -> xxhash64(translate(x, '{MARK}', '')))))"


def fingerprint(df: DataFrame, text: str, into: str, chain: int = CHAIN) -> DataFrame:
    """``df`` with an array of signature hashes of the column ``text``.

    A text without any word, or of anchors alone, has no signature.
    """
    words = f"concat(' {MARK} ', ltrim(regexp_replace(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' ')), ' ')"
    df = df.withColumn("__marked", F.expr(_marked(words)))
    return df.withColumn(into, F.expr(signatures("__marked", chain))).drop("__marked")


def as_text(sigs: str) -> Column:
    return F.expr(f"array_join(transform({sigs}, x -> lower(lpad(hex(x), 16, '0'))), ',')")


def likeness(a: str, b: str) -> Column:
    """Jaccard of two signature sets; two empty ones are alike."""
    both = f"size(array_intersect({a}, {b}))"
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1D when least(size({a}), size({b})) = 0 then 0D else {both} / cast(size({a}) + size({b}) - {both} as double) end")


def with_next(spark: SparkSession, docs: DataFrame, range_bytes: int = 8 << 20, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): a document, its fingerprint, and those of the next in descending doc_id order; the first follows the last.

    ``known`` has a row (doc_id, h, what) for every distinct doc_id and text
    hash h; it travels through the shuffle that the order takes anyway, and
    comes back as the column ``what``.

    Ranges of doc_id between sampled ids are sorted on their own; the first
    document of each range is also dealt to the range before it, where it ends
    the order.  A range holds about ``range_bytes``, or from ``RANGES`` ranges
    on their share of all (1 GB of 100 TB).  Rows that share a doc_id are
    ordered by their texts; null doc_ids come last.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    none = F.lit(None).cast("long") if known is None else F.lit(None).cast(known.schema["what"].dataType)
    size, rows, top = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1)), F.max("k")).first()
    if not rows:
        return fingerprint(docs, "text", "sigs").select("doc_id", "text", "sigs", F.col("text").alias("next_text"), F.col("sigs").alias("next_sigs"), none.alias("what"))
    n = max(1, min(size // range_bytes, RANGES))
    bounds: list[int] = []
    if n > 1:
        part = F.pmod(F.xxhash64("k"), F.lit(2**31)) < int(min(1.0, max(20_000, 4 * n) / rows) * 2**31)
        ids = docs.where(part).agg(F.sort_array(F.collect_set("k"))).first()[0]
        bounds = sorted({ids[len(ids) * q // n] for q in range(1, n)}) if ids else []
        bounds = [b for b in bounds if b < top]
    # range 0 holds the largest ids, its first document is the very first
    last = len(bounds)
    at = F.lit(last) - range_index("(k - 1)", bounds) if bounds else F.lit(0)
    heads = [*bounds, top]
    head = F.col("k").isin(heads)
    place = F.struct(at.alias("r"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.when(at == 0, F.lit(last)).otherwise(at - 1).alias("r"), F.lit(1).alias("ghost"))
    dealt = docs.withColumn("p", F.explode(F.when(head, F.array(place, ghost)).otherwise(F.array(place)))).select("k", "doc_id", "text", F.xxhash64("text").alias("h"), none.alias("what"), "p.r", "p.ghost")
    if known is not None:
        slim = known.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"), "doc_id", F.lit(None).cast("string").alias("text"), "h", "what")
        dealt = dealt.unionByName(slim.select("*", at.alias("r"), F.lit(0).alias("ghost")))
    # what is known of a document stands right before its rows
    order = Window.partitionBy("r").orderBy("ghost", F.desc("k"), "h", F.col("text").isNotNull(), "text")
    after = order.rowsBetween(1, 2)  # the next document's row, or what is known of it and then its row
    # texts are shuffled without their fingerprints, and each is fingerprinted once for both of its places
    dealt = fingerprint(dealt.repartition("r"), "text", "sigs").withColumn("sigs", F.when(F.col("text").isNotNull(), F.col("sigs")))
    dealt = dealt.withColumns({"next_text": F.first("text", ignorenulls=True).over(after), "next_sigs": F.first("sigs", ignorenulls=True).over(after), "what": F.last("what", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return dealt.where("ghost = 0 and text is not null").select("doc_id", "text", "sigs", "next_text", "next_sigs", "what")


def edited_next(df: DataFrame) -> DataFrame:
    """``df`` (with text, next_text) with n_chars and the edited text.

    The edit replaces the last floor(n_chars/3) code points by the first as
    many (or all) of the next document.
    """
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    cut = "cast(n_chars div 3 as int)"
    return df.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {cut}), substring(next_text, 1, {cut}))"))


def edit_report(spark: SparkSession, docs: DataFrame, also: list[Column] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Fingerprints of whole texts and of their edits, and how alike they are.

    Null texts are empty; equal texts have equal fingerprints; two fingerprints
    without signatures have likeness 1, one without and one with have 0.
    """
    df = fingerprint(edited_next(with_next(spark, docs, known=known)), "edited", "new")
    return df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("sigs").alias("fingerprint"), as_text("new").alias("edited_fingerprint"),
        likeness("sigs", "new").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"), *(also or []),
    )


NAMES = ["n", "h1", "h2"]  # what tells fingerprints apart in joins


def named(sigs: str) -> list[Column]:
    return [F.size(sigs).alias("n"), F.xxhash64(sigs).alias("h1"), F.xxhash64(sigs, F.lit(1)).alias("h2")]


def class_links(s: Scratch, docs: DataFrame, num: int = 80, den: int = 100, cell: int = CELL) -> DataFrame:
    """(n, h1, h2, class_id, links) of every class of equal fingerprints with signatures, as a written table.

    ``class_id`` is the class's least doc_id; ``links`` counts the other
    classes whose fingerprints have ``num / den`` of all their signatures in
    common with it, all of them.  Rows with a null doc_id are in no class.

    Classes are partitioned by their number of signatures, so that a link
    stays inside a partition or leads to the next.  In a partition a class is
    entered under its rarest signatures, as many as leave no way to reach the
    threshold without one of them.  Classes under one signature meet in cells
    of bounded size; a cell returns sums for each class, never its pairs.  A
    first look prunes pairs by length, by the Hamming distance of parity
    sketches (a lower bound of the sets' difference), and where they share one
    of a few least signatures that they are entered under.  Only classes that
    have a pair left there bring their sets to the second, which counts each
    link under the least signature that both are entered under.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every = s.table(fingerprint(text, "text", "sigs").select("doc_id", F.xxhash64("text").alias("h"), *named("sigs"), "sigs"), "sets")
    live = every.where("doc_id is not null and n > 0")
    seen = live.select(F.explode("sigs").alias("x")).groupBy(F.pmod("x", F.lit(BUCKETS)).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()
    often = [0] * BUCKETS
    for b, c in seen:
        often[b] = c
    # any one order of signatures leaves no link out; rare ones first leave few classes under each
    rare = f"transform(array_sort(transform(sigs, x -> struct(element_at({literal(often)}, cast(pmod(x, {BUCKETS}) as int) + 1) as c, x))), y -> y.x)"
    need = f"cast(n - ((n * {num} + {den} - 1) div {den}) + 1 as int)"
    # bit w * 64 + b of a sketch is the parity of the signatures that fall on it
    bit = "shiftleft(1L, cast(x & 63 as int))"
    sketch = f"transform(sequence(0, {WORDS - 1}), w -> aggregate(sigs, 0L, (s, x) -> if(((x >> 6) & {WORDS - 1}) = w, s ^ {bit}, s)))"
    entered = live.select(*NAMES, "doc_id", F.expr(f"array_sort(slice({rare}, 1, {need}))").alias("under"), F.expr(sketch).alias("sketch"))
    classes = s.table(entered.groupBy(*NAMES).agg(F.min("doc_id").alias("id"), F.first("under").alias("under"), F.first("sketch").alias("sketch")), "classes")
    part = F.floor(F.log("n") / F.log(F.lit(den / num)) + 1e-9).cast("int")
    homes = F.explode(F.array(F.struct(part.alias("part"), F.lit(True).alias("own")), F.struct((part - 1).alias("part"), F.lit(False).alias("own"))))
    each = classes.select(*NAMES, F.explode("under").alias("sig"))
    shared = s.table(each.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("sig"), "shared")
    rows = each.join(if_small(shared, 48), "sig").select(*NAMES, "sig", homes.alias("home")).select(*NAMES, "home.*", "sig")
    held = rows.groupBy("part", "sig").agg(F.count_if("own").alias("owns"), F.count(F.lit(1)).alias("size")).where("owns > 0 and size > 1")
    held = s.table(held.select("part", "sig", F.ceil(F.col("size") / cell).cast("int").alias("chunks")), "held")
    dealt = rows.join(if_small(held, 96), ["part", "sig"]).withColumn("chunk", F.pmod(F.xxhash64("h1", F.lit(7)), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = s.table(dealt.select("part", "sig", "own", *NAMES, "chunk", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj")), "dealt")
    place = ["part", "sig", "ci", "cj"]
    may = (
        f"(x.own or y.own) and (x.h1 <> y.h1 or x.h2 <> y.h2 or x.n <> y.n) and (ci = cj or x.chunk <> y.chunk) and least(x.n, y.n) * {den} >= greatest(x.n, y.n) * {num}"
        f" and aggregate(sequence(0, {WORDS - 1}), 0, (s, w) -> s + bit_count(x.sketch[w] ^ y.sketch[w])) * {den + num} <= (x.n + y.n) * {den - num}"
    )
    first = "not arrays_overlap(x.few, y.few)"
    short = classes.select(*NAMES, "sketch", F.slice("under", 1, LEAST).alias("least"))
    look = dealt.join(short, NAMES).withColumn("few", F.expr("filter(least, u -> u < sig)"))
    x = F.struct("own", "chunk", *NAMES, "sketch", "few").alias("x")
    look = look.groupBy(*place).agg(F.collect_list(x).alias("xs")).where("size(xs) > 1")
    left = look.select(*place, F.explode(F.expr(f"filter(xs, x -> exists(xs, y -> {may} and {first}))")).alias("x")).select(*place, "x.own", "x.chunk", *(f"x.{c}" for c in NAMES), "x.sketch")
    left = s.table(left, "left")
    # the sets of classes that are left, once for each class
    names = s.table(left.select(*NAMES).distinct(), "names")
    wanted = s.table(classes.join(if_small(names, 64), NAMES).select(F.col("id").alias("doc_id"), *NAMES, "under"), "wanted")
    maybe, _ = Sieve(wanted, "doc_id", *NAMES).split(live, *map(F.col, ["doc_id", *NAMES]))
    full = maybe.join(wanted.select("doc_id", *NAMES), ["doc_id", *NAMES]).dropDuplicates(NAMES)
    full = s.table(full.join(wanted.drop("doc_id"), NAMES).select(*NAMES, "sigs", "under"), "full")
    x = F.struct("own", "chunk", *NAMES, "sketch", "under", "sigs").alias("x")
    cells = left.join(full, NAMES).groupBy(*place).agg(F.collect_list(x).alias("xs"))
    both = "size(array_intersect(x.sigs, y.sigs))"
    linked = f"{may} and array_min(array_intersect(x.under, y.under)) = sig and {both} * {den} >= (x.n + y.n - {both}) * {num}"
    name = ", ".join(f"x.{c} as {c}" for c in NAMES)
    sums = cells.select(F.explode(F.expr(f"transform(xs, x -> struct({name}, cast(size(filter(xs, y -> {linked})) as bigint) as links))")).alias("r")).select("r.*").where("links > 0")
    links = s.table(sums.groupBy(*NAMES).agg(F.sum("links").alias("links")), "links")
    return s.table(classes.join(links, NAMES, "left").select(*NAMES, F.col("id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links")), "of")


def linked_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The edit report with each document's ``class_id`` and its ``links``.

    A fingerprint without signatures links with nothing: its class is the
    document itself.  Rows with a null doc_id that share a fingerprint with
    others show their class and links, but count in neither.  Classes and
    links reach the documents as a slim table, by the shuffle that puts the
    documents in order.
    """
    s = Scratch(spark, "spotsigs")
    of = class_links(s, docs)
    each = s.spark.read.parquet(s.path("sets")).select("doc_id", "h", *NAMES).distinct()
    known = each.join(of, NAMES, "left").select("doc_id", "h", F.struct(F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links")).alias("what"))
    known = s.table(known, "known")
    s.close("known")
    return edit_report(spark, docs, also=[F.col("what.class_id").alias("class_id"), F.col("what.links").alias("links")], known=known)
