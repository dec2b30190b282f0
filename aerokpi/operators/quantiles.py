"""Exact quantiles by counting in narrowing value ranges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges counted for one wanted rank in one pass: counters in a task are at most this many
#: times the wanted ranks, whatever the number of rows or of distinct values.
RANGES = 1024


def place(value, low: float, high: float):
    """The number of a value's range among RANGES between low and high, never falling as the
    value grows; low itself is in the first and high in the last."""
    scale = 0.5 if math.isinf(high - low) else 1.0  # a span beyond the largest double
    part = (value * scale - low * scale) / (high * scale - low * scale)
    return F.least(F.floor(part * RANGES), F.lit(RANGES - 1)).cast("int")


def order_statistics(df: DataFrame, wanted: dict[str, set[int]], spans: dict[str, tuple[float, float]]) -> dict[tuple[str, int], float]:
    """The values at the wanted ranks (from 0) of columns of doubles, whose least and greatest
    values are `spans`.

    A pass counts, for every rank still open, the values in each part of the range that holds
    it, with the part's least and greatest value, and goes on inside the part of the rank. As
    the ends of a range are values of the data and fall into different parts, every pass
    shrinks it; a range of one value ends. Values spread evenly take one pass for every
    factor of RANGES between span and spacing, powers of two one for ten of them."""
    open_ = {(c, r): (*spans[c], 0) for c, ranks in wanted.items() for r in ranks}
    done: dict[tuple[str, int], float] = {}
    while open_:
        for key in [key for key, (low, high, _) in open_.items() if low == high]:
            done[key] = open_.pop(key)[0]
        searches = sorted({(c, low, high) for (c, _), (low, high, _) in open_.items()})
        if not searches:
            break
        entries = F.array(*[F.when(F.col(c).between(low, high), F.struct(F.lit(i).alias("search"), place(F.col(c), low, high).alias("part"), F.col(c).alias("value")))
                            for i, (c, low, high) in enumerate(searches)])
        counted = df.select(F.explode(entries).alias("e")).where("e IS NOT NULL").groupBy("e.search", "e.part").agg(
            F.count(F.lit(1)).alias("n"), F.min("e.value").alias("low"), F.max("e.value").alias("high")).collect()
        parts: dict[int, list] = {}
        for row in sorted(counted, key=lambda row: (row["search"], row["part"])):
            parts.setdefault(row["search"], []).append(row)
        for (c, rank), (low, high, below) in list(open_.items()):
            for row in parts[searches.index((c, low, high))]:
                if rank < below + row["n"]:
                    open_[c, rank] = (row["low"], row["high"], below)
                    break
                below += row["n"]
    return done


def quantiles(df: DataFrame, wanted: list[tuple[str, float]]) -> list[float | None]:
    """Exact quantiles (column, share from 0 to 1), linearly interpolated between the two nearest
    order statistics: what `percentile` gives, without its map of all distinct values.

    The driver and every task hold a fixed number of counters. Nulls, NaN and infinities are
    missing; a column without values has null quantiles. `df` is read once for the spans
    and once a pass, so it should be a written table or cheap to read."""
    columns = sorted({c for c, _ in wanted})
    value = {c: F.col(c).cast("double") for c in columns}
    values = df.select(*[F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v + 0.0).alias(c) for c, v in value.items()])
    ends = values.agg(*[f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(columns) for f in (F.count, F.min, F.max)]).first()
    n = {c: ends[f"count_{i}"] for i, c in enumerate(columns)}
    spans = {c: (ends[f"min_{i}"], ends[f"max_{i}"]) for i, c in enumerate(columns)}
    ranks: dict[str, set[int]] = {}
    for c, share in wanted:
        if n[c]:
            at = (n[c] - 1) * share
            ranks.setdefault(c, set()).update((math.floor(at), math.ceil(at)))
    found = order_statistics(values, ranks, spans)

    def between(c: str, share: float) -> float | None:
        if not n[c]:
            return None
        at = (n[c] - 1) * share
        low, high = math.floor(at), math.ceil(at)
        if low == high or found[c, low] == found[c, high]:
            return found[c, low]
        return (high - at) * found[c, low] + (at - low) * found[c, high]

    return [between(c, share) for c, share in wanted]
