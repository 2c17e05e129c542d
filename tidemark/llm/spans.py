"""Where a pattern matches, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(pattern: str) -> str:
    """A pattern as the inside of an SQL string literal."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``, computed once.

    A column that a lambda names may be computed anew for each element, where
    the optimiser merges projections; an argument is not.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def match_spans(df: DataFrame, text: str, pattern: str, into: str, context: int = 48, need: str = "true", across: int = 0) -> DataFrame:
    """``df`` with ``into``: array of (start, length, m, before, after) of the pattern's matches.

    Starts count code points; ``before`` and ``after`` are up to ``context``
    and 16 characters between this match and its neighbours, or with ``across``
    of the text itself, over that many neighbours.  Where ``need`` does not
    hold the pattern is not tried.  Starts are prefix sums in two
    levels, so many matches in a text cost little more than few.
    """
    none = "cast(array() as array<string>)"
    df = df.withColumn("__m", F.expr(f"if({need}, regexp_extract_all({text}, '{quoted(pattern)}', 0), {none})"))
    df = df.withColumn("__p", F.expr(f"if(size(__m) > 0, split({text}, '{quoted(pattern)}', -1), {none})"))
    before, after = f"right(p[i], {context})", "left(p[i + 1], 16)"
    if across:
        tail = f"array_join(transform(sequence(greatest(i - {across}, 0), i), k -> concat(if(k > 0, right(m[k - 1], {context}), ''), right(p[k], {context}))), '')"
        head = f"array_join(transform(sequence(i + 1, least(i + {across}, size(m))), k -> concat(left(p[k], 16), if(k < size(m), left(m[k], 16), ''))), '')"
        before, after = f"if(length(p[i]) >= {context}, {before}, right({tail}, {context}))", f"if(length(p[i + 1]) >= 16, {after}, left({head}, 16))"
    plus = "(s, y) -> s + y"
    runs = "transform(sequence(0, (size(n) - 1) div 128), j -> slice(n, j * 128 + 1, 128))"
    until = let("c", f"transform(k, r -> aggregate(r, 0, {plus}))", f"transform(sequence(0, size(c) - 1), j -> if(j = 0, 0, aggregate(slice(c, 1, j), 0, {plus})))")
    sums = f"flatten(transform(k, (r, j) -> transform(r, (x, i) -> u[j] + if(i = 0, 0, aggregate(slice(r, 1, i), 0, {plus})))))"
    span = f"named_struct('start', b[i] + length(p[i]), 'length', length(x), 'm', x, 'before', {before}, 'after', {after})"
    spans = let("n", "transform(m, (x, i) -> length(p[i]) + length(x))", let("k", runs, let("u", until, let("b", sums, f"transform(m, (x, i) -> {span})"))))
    spans = let("m", "__m", let("p", "__p", spans))
    kind = "array<struct<start: int, length: int, m: string, before: string, after: string>>"
    return df.withColumn(into, F.expr(f"if(size(__m) = 0, cast(array() as {kind}), {spans})")).drop("__m", "__p")
