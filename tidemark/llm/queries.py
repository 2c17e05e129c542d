"""The operators of this subpackage as queries over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 16
SEQUENCE = 1024
WEIGHTS = (1.0, 0.1, 0.1)  # of room left for tokens, documents and attention cost


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> tuple[str, str]:
    """Paths of the public vocabulary as ranks and as json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes, components and link numbers of all documents at 0.85 of their four-word shingles; edge cases as in ``jaccard_components``."""
    from .ngram_join import jaccard_components

    return jaccard_components(spark, read(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data in all whole texts; null texts are empty, repeated rows are found each."""
    from .pii import digest, find_personal_data

    return digest(find_personal_data(spark, read(spark, sf_dir, "documents")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes; null texts count as empty, equal ids are told apart by their texts."""
    from .sharding import record_keys, shard_by_bytes

    out = shard_by_bytes(spark, record_keys(read(spark, sf_dir, "documents")), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "range_id")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth; null, zero and non-finite vectors take no part, ties go to the smaller vec_id."""
    from .ann import search

    return search(spark, read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts, of their edits and of the next, with classes and links; null texts are empty, null ids come last."""
    from .spotsigs import linked_report

    return linked_report(spark, read(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and spans of secrets in all whole texts; null texts are empty, equal rows count once."""
    from .secrets import digest, scan

    return digest(scan(spark, read(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in as few sequences of 1024 as best fit finds; null texts are the end token alone."""
    from .packing import Capacity, pack, token_pieces

    pieces = token_pieces(read(spark, sf_dir, "documents"), *vocabulary(), SEQUENCE)
    return pack(spark, pieces, Capacity(SEQUENCE, weights=WEIGHTS))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for every text with a letter, ``und`` for the others; rows without doc_id are held out."""
    from .langid import fit, identify

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs, model, keep=["doc_id", "held_out"])


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back; null payloads are empty, and equal ones revisit the smallest page_id."""
    from .warc import round_trip

    return round_trip(spark, read(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rates and copies of all documents; null and empty texts weigh nothing."""
    from .mixing import mix

    return mix(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("h")


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated bigram scores of all whole texts; a quarter of the training documents is the held-out fold of the weights."""
    from .lm import FOLD, LEARNT, SCORED, fit_and_score

    k = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    role = F.when(k == 1, SCORED).when(k == 2, FOLD).when(k.isNotNull(), LEARNT)
    out = fit_and_score(spark, read(spark, sf_dir, "documents"), role)
    return out.select("doc_id", (F.col("role") == SCORED).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations damaged by a fixed rule, and the cheapest repair of each."""
    from .repair import repaired_report

    return repaired_report(spark, read(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops planted in one document of ten, and all periodic runs of all whole texts."""
    from .runs import digest, periodic_runs, with_loops
    from .scratch import Scratch

    s = Scratch(spark, "runs")
    out = s.table(digest(periodic_runs(with_loops(read(spark, sf_dir, "documents")), ["doc_id"])), "out")
    s.close("out")
    return out


def repair_sql() -> str:
    """The repair in standard SQL: checksums bit by bit, the cheapest edits by a recursion over each distinct signature.

    A state's best edits are a string: the cost, seven digits wide, and the audit, so the least string is the best.
    """
    add = lambda b, cost, ops: f"(CAST(substr({b}, 1, 7) AS INT) + {cost}) || substr({b}, 8) || '{ops}'"
    least = lambda *xs: f"least({', '.join(xs)})"
    before = {0: "b0", 1: "b1", 2: least("b2", add("b0", 5, "I"), add("b1", 5, "I"), add("b3", 5, "I")), 3: least("b3", add("b2", 5, "I"), add("b0", 10, "II"), add("b1", 10, "II"))}
    gone = {q: add(f"p{q}", 2, "D") for q in range(4)}
    kept = lambda letter, q: f"CASE WHEN lower(c) = '{letter}' THEN {add(f'p{q}', 'm', 'K')} END"
    given = lambda q: f"CASE WHEN c <> 'd' THEN {add(f'p{q}', '1 + m', 'R')} END"
    after = {0: gone[0], 1: least(gone[1], kept("s", 0)), 2: least(gone[2], *(x for q in (0, 1, 3) for x in (kept("u", q), given(q)))), 3: least(gone[3], kept("a", 2), given(2))}
    steps = ", ".join(f"{v} AS b{q}" for q, v in after.items())
    starts = ", ".join(f"{v} AS p{q}" for q, v in before.items())
    white = " || ".join(f"chr({x})" for x in (32, 9, 10, 11, 12, 13))
    return f"""WITH RECURSIVE bits AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(0, 256) t(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
ra AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kc AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS f FROM (SELECT DISTINCT k FROM ra), tab),
da AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM ra JOIN kc USING (k), range(0, 2) n(n) WHERE f <> 0 AND (n = 0 OR f = 3)),
nm AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM da), od AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, rtrim(text, {white}) AS body FROM nm),
fa AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS r FROM od),
le AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(CASE WHEN r IN ('s', 'u', 'a') THEN r ELSE 'x' END) WHEN r IN ('s', 'u', 'a') THEN r ELSE 'x' END AS c, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM fa),
co AS (SELECT conv_id, string_agg(c, '' ORDER BY i) AS sig, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(was IS NOT NULL AND was || r NOT IN ('su', 'ua', 'au')) AS illegal FROM le GROUP BY conv_id),
dp AS (SELECT DISTINCT sig, 0 AS i, '1000000' AS b0, CAST(NULL AS VARCHAR) AS b1, CAST(NULL AS VARCHAR) AS b2, CAST(NULL AS VARCHAR) AS b3 FROM co
UNION ALL SELECT sig, i + 1, {steps} FROM (SELECT sig, i, substr(sig, i + 1, 1) AS c, CASE WHEN ascii(substr(sig, i + 1, 1)) < 97 THEN 5 ELSE 0 END AS m, {starts} FROM dp WHERE i < length(sig))),
be AS (SELECT sig, {least("b0", add("b1", 10, "II"), add("b2", 5, "I"), "b3")} AS best FROM dp WHERE i = length(sig)),
au AS (SELECT conv_id, CAST(substr(best, 1, 7) AS BIGINT) - 1000000 AS cost, substr(best, 8) AS audit FROM co JOIN be USING (sig)),
ex AS (SELECT conv_id, j, substr(audit, CAST(j AS INT), 1) AS op FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM au)),
nu AS (SELECT *, count_if(op <> 'I') OVER w AS i, count_if(op <> 'D') OVER w AS o FROM ex WINDOW w AS (PARTITION BY conv_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ro AS (SELECT nu.*, le.role, le.text, max(CASE WHEN op = 'K' AND o = 1 AND le.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY nu.conv_id) AS s FROM nu LEFT JOIN le ON le.conv_id IS NOT DISTINCT FROM nu.conv_id AND le.i = nu.i),
re AS (SELECT conv_id, sha256(string_agg((CASE WHEN op = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN op = 'I' THEN '' ELSE text END), chr(10) ORDER BY j)) AS h FROM ro WHERE op <> 'D' GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN co ON co.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN au ON au.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN re ON re.conv_id IS NOT DISTINCT FROM d.conv_id"""


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_pii, op3_sharding, op4_ann, op5_spotsigs, op6_secrets, op7_packing, op8_language_id, op9_warc, op10_mixing, op11_lm_scores, op12_conversation_repair, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op12_conversation_repair": repair_sql()}
