"""Documents to packed training sequences, stage by stage.

Every stage works on all that its predecessor kept; between stages the
documents are written as Parquet and read again.  The last stage returns the
packed pieces instead of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, ngram_join, packing, secrets
from tidemark.llm.queries import WEIGHTS, read, vocabulary
from tidemark.llm.scratch import Scratch, Sieve

SEQUENCE, DOCUMENTS = 1024, 64  # tokens and documents of a sequence, at most


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that have no language: null texts and texts without any letter.

    All other documents stay as they are.  Profiles are learnt from the
    documents that carry a lang; without any, the letters alone decide.
    """
    model = langid.fit(docs)
    if not model.languages:
        model = langid.LETTERS
    kept = langid.identify(docs, model, keep=docs.columns, lang="__lang", score="__score")
    return kept.where(F.col("__lang") != langid.NONE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the least doc_id, of each group of near copies.

    Near copies share at least 0.8 of their five-word shingles; groups follow
    links.  Rows that share a doc_id but not the text are documents of their
    own; of rows that share both, one remains.  Rows without doc_id, and the
    texts without shingles, stay.
    """
    s = Scratch(spark, "versions")
    h = F.xxhash64("text")
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(h).alias("lo"), F.max(h).alias("hi")).where("n > 1")
    twice = s.table(twice, "twice")
    several = twice.where("lo <> hi").select(F.col("doc_id").alias("__several"))
    df = docs.withColumn("__id", F.col("doc_id"))
    if not several.isEmpty():
        df = docs.join(several, F.col("doc_id") == F.col("__several"), "left").withColumn("__id", F.when(F.col("__several").isNotNull(), F.xxhash64("doc_id", h)).otherwise(F.col("doc_id")))
    groups = ngram_join.jaccard_components(spark, df.select(F.col("__id").alias("doc_id"), "text"), width=5, num=80, den=100)
    groups = groups.where("doc_id is not null").select(F.col("doc_id").alias("__id"), "component_id").distinct()
    if several.isEmpty():
        gone = groups.where(F.col("component_id") != F.col("__id")).select("__id")
    else:
        named = groups.join(df.select("__id", "doc_id").distinct(), "__id")
        least = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "__id")).alias("least"))
        gone = named.join(least, "component_id").where(F.col("__id") != F.col("least.__id")).select("__id")
    gone = s.table(gone, "gone")
    s.close("twice", "gone")
    # a sieve of bounded size passes nearly all texts where they stand; few are shuffled
    maybe, stay = Sieve(gone, "__id").split(df, F.col("__id"))
    kept = stay.unionByName(maybe.join(gone, "__id", "left_anti").select(*df.columns)).select("__id", *docs.columns)
    if twice.isEmpty():
        return kept.select(*docs.columns)
    again, once = Sieve(twice, "doc_id").split(kept, F.col("doc_id"))
    once = once.unionByName(again.join(twice, "doc_id", "left_anti").select(*kept.columns))
    return once.unionByName(again.join(twice, "doc_id", "left_semi").select(*kept.columns).dropDuplicates(["__id"])).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mask in the place of every secret; no document goes.

    Null and empty texts stay as they are; rows with equal doc_id and text are
    masked alike, those with equal doc_id and other texts each by their own
    findings; n_chars follows the text.
    """
    return secrets.redact(docs, secrets.scan(spark, docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents by their fitted rates.

    The targets are all clean tokens, half of the low-quality ones and no
    toxic ones.  A rate of 1 keeps a document once, one of 0 drops it.  Null
    and empty texts weigh nothing in the fit and are copied by their own rate;
    rows with equal doc_id and text have one rate and are each copied by it;
    without labels all is clean.
    """
    rated = mixing.mix(spark, docs, read(spark, sf_dir, "labels"))
    # equal rows have equal rates; most documents are kept once, and they stay where they are
    copies = rated.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.max("copies").alias("__copies"))
    s = Scratch(spark, "copies")
    copies = s.table(copies.where("__copies <> 1"), "copies")
    s.close("copies")
    maybe, once = Sieve(copies, "__id", "__h").split(docs, F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    df = maybe.join(copies, F.expr("doc_id <=> __id and xxhash64(coalesce(text, '')) = __h"), "left").withColumn("__copies", F.coalesce("__copies", F.lit(1).cast("long")))
    many = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long")))
    return once.unionByName(df.where("__copies > 0").withColumn("__i", many).select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in best-fit packed sequences of at most 64 documents.

    A null or empty text is its end token.  Repeated rows are packed each; of
    equal fits any sequence may be taken.  Rows without doc_id keep none.
    """
    capacity = packing.Capacity(SEQUENCE, documents=DOCUMENTS, cost=SEQUENCE**2, weights=WEIGHTS)
    return packing.pack(spark, packing.token_pieces(docs, *vocabulary(), SEQUENCE), capacity)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
    ("pack", pack),
]

#: SQL can express neither the models nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = s.table(stage(spark, docs, sf_dir), name)
    s.close(STAGES[-1][0])
    return docs
