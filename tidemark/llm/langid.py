"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1.  An n-gram's vector binds the
letters' vectors, each rotated by its place, by elementwise product; a text's
vector bundles (sums) its n-grams' vectors, a language's prototype its texts'
unit vectors.  What all prototypes share is subtracted, and a text gets the
language whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 1024
NGRAM = 3
SYMBOLS = 2048
NONE = "und"

_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if not _tables:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
        code = np.arange(0x10000)
        _tables["symbol"] = np.where(letter, np.where(code < 1024, code, 1024 + (code * 2654435761 >> 7) % 1024), 0)
        base = np.random.default_rng(20).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
        for k in range(NGRAM):
            _tables[f"place{k}"] = np.roll(base, NGRAM - 1 - k, axis=1)
    return _tables[name]


def profile(text: str | None) -> np.ndarray | None:
    """The bundled n-gram vector of a whole text; None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _table("symbol")[np.minimum(c, 0xFFFF)]
    for i in np.flatnonzero(c > 0xFFFF):
        s[i] = 1024 + int(c[i]) % 1024 if chr(c[i]).isalpha() else 0
    if not s.any():
        return None
    s = np.concatenate(([0], s, [0]))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    gram = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    gram, count = np.unique(gram, return_counts=True)
    out = np.zeros(DIM, np.float32)
    for k in range(0, len(gram), 4096):
        g = gram[k : k + 4096]
        v = _table("place0")[g // SYMBOLS**2] * _table("place1")[g // SYMBOLS % SYMBOLS]
        v *= _table("place2")[g % SYMBOLS]
        out += count[k : k + 4096].astype(np.float32) @ v.astype(np.float32)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n else v


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    prototypes: np.ndarray  # a unit row for each language, less what all share
    shared: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        v = profile(text)
        if v is None or not self.languages:
            return NONE, 0.0
        cos = self.prototypes @ unit(unit(v) - self.shared)
        k = int(np.argmax(cos))
        return self.languages[k], float(min(1.0, max(0.0, (1 + cos[k]) / 2)))


#: Names no language, but tells texts with a letter from those without.
LETTERS = LanguageModel(["any"], np.zeros((1, DIM)), np.zeros(DIM))


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if (v := profile(text)) is not None:
                sums[lang] = sums.get(lang, 0) + unit(v)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])


def fit(labelled: DataFrame, most: int = 20_000, tasks: int = 12) -> LanguageModel:
    """Prototypes from (doc_id, text, lang).

    ``most`` bounds the labelled rows that are learnt from: beyond it, rows are
    taken by a hash of doc_id.  Rows without text or lang are not learnt from;
    with no row left, every prediction is ``und``.
    """
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(most / n * 1_000_000))
    parts = rows.select("lang", "text").repartition(tasks).mapInArrow(_bundle, "lang string, v array<double>").collect()
    sums: dict[str, np.ndarray] = {}
    for lang, v in parts:
        sums[lang] = sums.get(lang, 0) + np.array(v)
    names = sorted(sums)
    rows_ = [unit(sums[x]) for x in names]
    shared = np.mean(rows_, axis=0) if len(rows_) > 1 else np.zeros(DIM)
    return LanguageModel(names, np.array([unit(r - shared) for r in rows_]), shared)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns ``keep`` with the predicted language and a score from 0 to 1.

    The score is (1 + cosine) / 2.  A null or empty text, or one without any
    letter, is ``und`` with score 0; of languages with equal cosines the first
    by name is taken.  Only ``text`` goes through Python, and only the two new
    values come back.
    """
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def predict(text: pa.Array) -> pa.Array:
        got = [model.predict(t.as_py()) for t in text]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang", "score"])

    found = docs.select(*keep, predict(F.col("text").cast("string")).alias("__found"))
    return found.select(*keep, F.col("__found.lang").alias(lang), F.col("__found.score").alias(score))
