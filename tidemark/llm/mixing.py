"""Mixing sources to target weights with soft domain memberships.

A classifier learnt from the labelled table gives every document a posterior
over the domains.  Document rates are then fitted by projected gradient least
squares: the domains' expected token totals, sums of rate * tokens *
posterior, shall match the targets with no rate below zero, and a small weight
on squared changes of the rates keeps documents of a kind alike.  The
gradient's part in each document is its posterior times one vector for all, so
the steps taken add up to such a vector, and a rate is what they leave of one,
projected to at least zero.  A step needs the totals and the domains' Gram
matrix only, both sums over a slim table; the gradient is scaled by the
inverse of that matrix, so a few steps are enough.
Only DataFrame and SQL functions (and the DataFrame-based ML library) run here.
"""

from __future__ import annotations

import warnings

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .scratch import Scratch

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 1.0, "low": 0.5, "toxic": 0.0}  # times the tokens that the corpus holds of each
BUCKETS = 1 << 13


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label): 2 for toxic, else 1 for low quality, else 0; the worse of repeated labels; rows with nulls teach nothing."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    worse = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return worse.select("doc_id", F.expr("cast(case when toxic = 1 then 2 when quality = 0 then 1 else 0 end as double)").alias("label"))


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``words`` and simple measures of the text."""
    df = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    df = df.withColumn("__all", F.expr("regexp_extract_all(lower(__text), '[\\\\p{L}\\\\p{N}]+', 0)"))
    df = df.withColumn("__words", F.array_distinct("__all"))
    n = "greatest(size(__all), 1)"
    measures = {
        "variety": f"size(__words) / {n}",
        "signs": "length(regexp_replace(__text, '[\\\\p{L}\\\\p{N}\\\\s.,]+', '')) / greatest(length(__text), 1)",
        "upper": "length(regexp_replace(__text, '[^\\\\p{Lu}]+', '')) / greatest(length(__text), 1)",
        "digits": "length(regexp_replace(__text, '[^\\\\p{N}]+', '')) / greatest(length(__text), 1)",
        "size": f"ln({n}) / 10",
        "word": f"length(__text) / {n} / 10",
    }
    return df.select(*keep, "__words", *(F.expr(f"cast({e} as double)").alias(f"__{k}") for k, e in measures.items()))


MEASURES = ("variety", "signs", "upper", "digits", "size", "word")


def fit_domains(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> PipelineModel | None:
    """The domain classifier, from at most about ``most`` labelled documents, taken by a hash of doc_id.

    None where fewer than two domains have labelled documents.
    """
    known = domain_labels(labels)
    n = known.count()
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < int(min(1.0, most / max(n, 1)) * 2**31) + 1)
    # a known table has about ``most`` rows of two numbers at most, whatever the size of the input
    rows = features(docs.join(F.broadcast(known), "doc_id"), ["doc_id", "label"]).repartition(12, "doc_id").sortWithinPartitions("doc_id", "label", "__size").persist()
    try:
        counts = {int(r[0]): r[1] for r in rows.groupBy("label").count().collect()}
        if len(counts) < 2:
            return None
        total = sum(counts.values())
        weight = F.lit(0.0)
        for k, c in counts.items():
            weight = F.when(F.col("label") == k, (total / len(counts) / c) ** 0.5).otherwise(weight)
        steps = [
            HashingTF(inputCol="__words", outputCol="__tf", numFeatures=BUCKETS, binary=True),
            VectorAssembler(inputCols=["__tf", *(f"__{m}" for m in MEASURES)], outputCol="__x"),
            LogisticRegression(featuresCol="__x", labelCol="label", weightCol="__weight", family="multinomial", regParam=2e-3, maxIter=40, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__pred"),
        ]
        return Pipeline(stages=steps).fit(rows.withColumn("__weight", weight))
    finally:
        rows.unpersist()


def posteriors(docs: DataFrame, model: PipelineModel | None, keep: list[str]) -> DataFrame:
    """``keep`` and ``p``: array of the domains' probabilities (all clean without a model)."""
    if model is None:
        return docs.select(*keep, F.array(*(F.lit(float(d == 0)) for d in range(len(DOMAINS)))).alias("p"))
    scored = model.transform(features(docs, keep))
    p = vector_to_array("__p")
    return scored.select(*keep, p.alias("__got")).select(*keep, F.expr(f"transform(sequence(0, {len(DOMAINS) - 1}), i -> if(i < size(__got), __got[i], 0D))").alias("p"))


def _solve(g: list[list[float]], b: list[float]) -> list[float]:
    """g x = b by elimination, for the few domains there are."""
    n = len(b)
    m = [[*row, y] for row, y in zip(g, b, strict=True)]
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[k] = m[k], m[i]
        for r in range(n):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    return [m[i][n] / m[i][i] for i in range(n)]


def _rate(step: list[float]) -> Column:
    """What the steps taken leave of a rate of one, projected to at least zero."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum(F.col("p")[d] * F.lit(x) for d, x in enumerate(step)))


def fit_rates(weighed: DataFrame, targets: dict[str, float], ridge: float = 1e-3, rounds: int = 25, tolerance: float = 1e-8) -> tuple[Column, list[float], list[float]]:
    """The rate as a column over (tokens, p), the totals reached, and those wanted.

    ``targets`` are multiples of each domain's own expected total; ``ridge``
    weighs the squared changes of rates against the squared misses, both as
    parts of all tokens.  Where ``rounds`` steps leave a gradient above the
    tolerance, a warning says so and the rates of the last step stand.
    """
    k = range(len(DOMAINS))
    natural = weighed.agg(*(F.coalesce(F.sum(F.col("tokens") * F.col("p")[d]), F.lit(0.0)) for d in k)).first()
    goal = [natural[d] * targets[DOMAINS[d]] for d in k]
    all_ = sum(natural) or 1.0
    total = [0.0 for _ in k]
    reached = list(natural)
    for _ in range(rounds):
        rated = weighed.withColumn("r", _rate(total))
        sums = [F.coalesce(F.sum(F.col("tokens") * F.col("r") * F.col("p")[d]), F.lit(0.0)) for d in k]
        gram = [F.coalesce(F.sum(F.when(F.col("r") > 0, F.col("tokens") * F.col("p")[d] * F.col("p")[e])), F.lit(0.0)) for d in k for e in k]
        row = list(rated.agg(*sums, *gram).first())
        reached, n = row[: len(k)], len(k)
        slope = [(a - b) / all_ - ridge * x for a, b, x in zip(reached, goal, total, strict=True)]
        if max(map(abs, slope)) < tolerance:
            break
        g = [[row[n + n * d + e] / all_ + (ridge if d == e else 0.0) for e in k] for d in k]
        total = [x + y for x, y in zip(total, _solve(g, slope), strict=True)]
    else:
        warnings.warn(f"rates had not settled after {rounds} steps", stacklevel=2)
    return _rate(total), reached, goal


def copies(rated: DataFrame, rows: int, most: int = 1000) -> DataFrame:
    """``rated`` (doc_id, h, tokens, p, rate) with ``copies``, a whole number whose expectation is the rate.

    Documents of one likeliest domain and about one size are taken in the
    order of a hash, and each gets the whole numbers that the sum of rates
    passes, from a start drawn by a hash.  So the copies of every such cell
    add up to its rates but for one, and the token totals stay close to those
    of the rates.  A cell holds about ``most`` rows at most.
    """
    u = lambda *x: F.pmod(F.xxhash64(*x), F.lit(2**31)) / float(2**31)
    cell = [
        F.expr("array_position(p, array_max(p))").alias("__d"), F.floor(F.log2(F.col("tokens") + 1)).alias("__s"),
        F.pmod(F.xxhash64("doc_id", "h", F.lit(23)), F.lit(rows // most + 1)).alias("__b"),
    ]
    order = Window.partitionBy("__d", "__s", "__b").orderBy(F.xxhash64("doc_id", "h", F.lit(17)), "doc_id", "h")
    df = rated.select("*", *cell).withColumn("__sum", F.sum("rate").over(order.rowsBetween(Window.unboundedPreceding, 0)) + u("__d", "__s", "__b"))
    before = F.coalesce(F.lag("__sum").over(order), u("__d", "__s", "__b"))
    return df.withColumn("copies", (F.floor("__sum") - F.floor(before)).cast("int")).drop("__d", "__s", "__b", "__sum")


def mix(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, h, tokens, p_clean, p_low, p_toxic, rate, copies) for every row of ``docs``.

    ``tokens`` counts words between white space; ``h`` hashes the text;
    ``copies`` is a whole number whose expectation is the rate.  Null and
    empty texts have no tokens and weigh nothing.  Labelled documents that are
    not among ``docs`` teach nothing; without any, all is clean.  Of equal
    posteriors the first domain counts as the likeliest.
    """
    s = Scratch(spark, "mixing")
    model = fit_domains(docs.select("doc_id", "text"), labels)
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "))
    base = docs.select("doc_id", "text", F.xxhash64(text).alias("h"), F.when(text == "", 0).otherwise(tokens).cast("long").alias("tokens"))
    slim = s.table(posteriors(base, model, ["doc_id", "h", "tokens"]), "posteriors")
    rate, _, _ = fit_rates(slim, targets)
    rated = copies(slim.withColumn("rate", rate), slim.count())
    out = s.table(rated.select("doc_id", "h", "tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate", "copies"), "out")
    s.close("out")
    return out
