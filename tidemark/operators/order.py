"""Operators over one global order of all rows, without a task that holds them all: running totals and exact quantiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import Stage


def running_totals(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds a running total for each of ``sums`` over the rows up to and with the present one, in the given order.

    The rows are range-partitioned by the order and kept in the shared folder; each partition is summed, the partitions
    before are added from a table of one row per partition, and the rest is a running sum within the partition. ``order``
    must be total for a defined result. Null addends count 0.
    """
    names = list(sums)
    placed = df.withColumns({f"__o{k}": v for k, v in enumerate(sums.values())})
    placed = Stage(placed.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())).df
    parts = placed.groupBy("__part").agg(*(F.coalesce(F.sum(f"__o{k}"), F.lit(0)).alias(f"__t{k}") for k in range(len(names))))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__part", *(F.coalesce(F.sum(f"__t{k}").over(before), F.lit(0)).alias(f"__b{k}") for k in range(len(names))))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(offsets), "__part")
    out = joined.withColumns({n: F.coalesce(F.sum(f"__o{k}").over(within), F.lit(0)) + F.col(f"__b{k}") for k, n in enumerate(names)})
    return out.drop("__part", *(f"__{x}{k}" for k in range(len(names)) for x in "ob"))


def exact_quantiles(df: DataFrame, value: Column, probs: Sequence[float], cells: int = 1000, most: int = 100_000) -> list[float | None]:
    """Quantiles by linear interpolation, as a list. Nulls and NaN are left out; no rows: None.

    The values are kept in the shared folder, so ``df`` is computed once. Sampled ranks (a sketch of fixed size, true to one part
    in ``cells``) give a narrow bracket around each wanted rank; counting what lies below, on and within the brackets makes them certain, and only the
    values within are looked at again, until at most ``most`` are left to fetch. Ranks that fall on a bracket's ends are known
    at once, so neither ties nor a heavy tail take more rounds.
    """
    staged = Stage(df.select(value.cast("double").alias("x")).where("x is not null and not isnan(x)"))
    try:
        return _quantiles(staged.df, probs, cells, most)
    finally:
        staged.drop()


def _quantiles(x: DataFrame, probs: Sequence[float], cells: int, most: int) -> list[float | None]:
    n = x.count()
    if not n:
        return [None] * len(probs)
    places = [p * (n - 1) for p in probs]
    known: dict[int, float] = {}
    # open intervals: ends, rows below, rows within, wanted ranks
    todo = [(None, None, 0, n, sorted({math.floor(p) for p in places} | {math.ceil(p) for p in places}))]
    while todo:
        few, used = [], 0
        for t in sorted(todo, key=lambda t: t[3]):
            if used + t[3] <= most:
                few.append(t)
                used += t[3]
        if few:
            wanted = F.lit(False)
            for lo, hi, *_ in few:
                wanted = wanted | _within(lo, hi)
            values = np.sort(x.where(wanted).toPandas()["x"].to_numpy())
            at = 0
            for _, _, base, size, ranks in sorted(few, key=lambda t: t[2]):
                known.update({r: float(values[at + r - base]) for r in ranks})
                at += size
            todo = [t for t in todo if t not in few]
            continue
        lo, hi, base, size, ranks = todo.pop()
        todo += _narrowed(x.where(_within(lo, hi)), (lo, hi), base, size, ranks, known, cells)
    return [known[math.floor(p)] + (known[math.ceil(p)] - known[math.floor(p)]) * (p - math.floor(p)) for p in places]


def _within(lo: float | None, hi: float | None) -> Column:
    out = F.lit(True)
    if lo is not None:
        out = out & (F.col("x") > lo)
    return out if hi is None else out & (F.col("x") < hi)


def _narrowed(part: DataFrame, ends: tuple, base: int, size: int, ranks: list[int], known: dict[int, float], cells: int) -> list[tuple]:
    """Cuts an open interval at sampled values around its wanted ranks; what falls on a cut is known, the rest is returned."""
    error = max(1e-4, min(1 / cells, 1 / (40 * len(ranks))))
    around = sorted({min(max((r - base + 0.5) / size + d * error, 0.0), 1.0) for r in ranks for d in (-2, 2)})
    cuts = sorted(set(part.approxQuantile("x", around, error)))
    x = F.col("x")
    counts = part.agg(*(c for k, v in enumerate(cuts) for c in (F.count(F.when(x < v, 1)).alias(f"b{k}"), F.count(F.when(x == v, 1)).alias(f"e{k}")))).first()
    out, left, before = [], ends[0], base
    for k, v in [*enumerate(cuts), (None, ends[1])]:
        below = base + (size if k is None else counts[f"b{k}"])
        inside = [r for r in ranks if before <= r < below]
        if inside:
            out.append((left, v, before, below - before, inside))
        if k is not None:
            before = below + counts[f"e{k}"]
            known.update({r: v for r in ranks if below <= r < before})
        left = v
    return out
