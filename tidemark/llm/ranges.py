"""Column expressions over literal tables of bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: list, kind: str = "bigint") -> str:
    """An SQL literal of an array (or array of arrays) of numbers."""
    text = str(values).replace(" ", "")
    depth = 2 if values and isinstance(values[0], list) else 1
    return f"from_json('{text}', '{'array<' * depth}{kind}{'>' * depth}')"


def range_index(x: str, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``x``: a two-level search, about 2 sqrt(n) steps."""
    if not bounds:
        return F.lit(0)
    g = math.isqrt(len(bounds)) or 1
    groups = [bounds[i : i + g] for i in range(0, len(bounds), g)]
    heads = [b[0] for b in groups]
    top = f"size(filter({literal(heads)}, b -> b <= {x}))"
    return F.expr(f"if({heads[0]} > {x}, 0, ({top} - 1) * {g} + size(filter(element_at({literal(groups)}, {top}), b -> b <= {x})))")


def pick(values: list, index: str, kind: str = "bigint") -> Column:
    """values[index], counted from 0."""
    return F.expr(f"element_at({literal(values, kind)}, cast({index} as int) + 1)")
