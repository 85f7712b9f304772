"""Per-key results when a few keys hold most records, and a join that splits hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import micros, require_columns

_UNTIMED = -(2**62)


def _partials(part: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One state for each key of a sorted partition (two if it has rows without a time). The state of the last key of a batch
    is carried into the next batch."""
    carry: pd.DataFrame | None = None
    for pdf in batches:
        if pdf.empty:
            continue
        k, null, t, v, has = (pdf[c].to_numpy() for c in ("k", "isnull", "t", "v", "has"))
        timed = t != _UNTIMED
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (null[1:] != null[:-1]) | (timed[1:] != timed[:-1])])
        gap = np.r_[0, np.diff(t)]
        gap[starts] = 0
        ends = np.r_[starts[1:], len(k)] - 1
        out = pd.DataFrame(
            {
                "isnull": null[starts], "k": k[starts], "part": part, "n": ends - starts + 1,
                "n_values": np.add.reduceat(has.astype("int64"), starts), "total": np.add.reduceat(v, starts),
                "first_us": t[starts], "last_us": t[ends], "max_gap_us": np.maximum.reduceat(gap, starts),
            }
        )
        if carry is not None:
            a, b = carry.iloc[0], out.iloc[0]
            if a.k == b.k and a.isnull == b.isnull and (a.last_us == _UNTIMED) == (b.first_us == _UNTIMED):
                out.loc[0, ["n", "n_values", "total", "first_us", "max_gap_us"]] = [
                    a.n + b.n, a.n_values + b.n_values, a.total + b.total, a.first_us, max(a.max_gap_us, b.max_gap_us, b.first_us - a.last_us),
                ]
            else:
                yield carry
        yield out.iloc[:-1]
        carry = out.iloc[-1:].reset_index(drop=True)
    if carry is not None:
        yield carry


def per_key_stats(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows, sum, first and last time and the longest pause of each key, with no task that holds a whole hot key.

    Output: key, n_rows, n_values, total, first_us, last_us, max_gap_us (microseconds between neighbouring rows of the key;
    0 for a key with fewer than two timed rows).

    Method: range partitioning on (key, order) with Spark's sampled quantiles, so that a heavy key is cut across several
    partitions of like size; each sorted partition gives one partial state per key; the states of a key that stand on both
    sides of a boundary are stitched in order (the pause across the boundary is that between the last time of one state and
    the first of the next). Only the states, about keys plus partitions, are shuffled for the stitching.

    Defined cases: the null key is a key of its own. A null value counts as 0 in ``total`` and not in ``n_values``; a row
    without a time counts but makes no pause. Repeated rows all count; ties in time may be cut anywhere, which changes no
    result. Empty input: no rows. Other columns are ignored.
    """
    require_columns(df, key, order, value)
    kind = df.schema[key].dataType
    whole = isinstance(kind, T.IntegralType)
    t = micros(order) if df.schema[order].dataType.typeName().startswith("timestamp") else F.col(order).cast("bigint")
    placed = (
        df.select(
            F.col(key).isNull().alias("isnull"),
            F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("k") if whole else F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"),
            F.coalesce(t, F.lit(_UNTIMED)).alias("t"),
            F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"), F.col(value).isNotNull().alias("has"),
            F.monotonically_increasing_id().alias("tie"),
        )
        .repartitionByRange("isnull", "k", "t", "tie")
        .sortWithinPartitions("isnull", "k", "t")
        .drop("tie")
    )

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        return _partials(TaskContext.get().partitionId(), batches)

    states = placed.mapInPandas(
        partials,
        f"isnull boolean, k {'bigint' if whole else 'string'}, part int, n bigint, n_values bigint, total double, first_us bigint, last_us bigint, max_gap_us bigint",
    )
    w = Window.partitionBy("isnull", "k").orderBy("first_us", "last_us", "part")
    before, timed = F.lag("last_us").over(w), F.col("first_us") != _UNTIMED
    stitched = (
        states.withColumn("across", F.when(before != _UNTIMED, F.col("first_us") - before))
        .groupBy("isnull", "k")
        .agg(
            F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"),
            F.min(F.when(timed, F.col("first_us"))).alias("first_us"), F.max(F.when(timed, F.col("last_us"))).alias("last_us"),
            F.greatest(F.max("max_gap_us"), F.coalesce(F.max("across"), F.lit(0))).alias("max_gap_us"),
        )
    )
    return stitched.select(
        F.when(~F.col("isnull"), F.col("k")).cast(kind).alias(key), F.col("n").alias("n_rows"), "n_values", "total", "first_us", "last_us", "max_gap_us"
    )


def split_hot_join(big: DataFrame, unique: DataFrame, key: str, how: str = "left", most: int = 10_000) -> DataFrame:
    """Join ``big`` with ``unique`` (one row per key) without a task that holds all rows of a hot key.

    Keys with more than 1/``most`` of the rows of ``big`` are hot; by counting, there are fewer than ``most`` of them, so the
    rows of ``unique`` for these keys can be broadcast, whatever the data. All other rows go through a shuffle join.

    Defined cases: null keys match nothing (kept by a left join). Works for ``how`` left, inner, left_semi and left_anti.
    """
    require_columns(big, key)
    require_columns(unique, key)
    counts = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = big.agg(F.count("*").alias("__all")).scalar()
    hot = counts.where(F.col("__n") * most > total).select(key)
    hot_unique = unique.join(F.broadcast(hot), key, "left_semi")
    marked = big.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    there = marked.where("__hot").drop("__hot").join(F.broadcast(hot_unique), key, how)
    rest = marked.where(F.col("__hot").isNull()).drop("__hot").join(unique, key, how)
    return there.unionByName(rest)
