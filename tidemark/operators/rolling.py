"""Rolling totals over trailing periods, for every entity and every calendar day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import require_columns


def rolling_totals(
    df: DataFrame,
    entity: str,
    day: str,
    value: str,
    start: dt.date,
    end: dt.date,
    windows: Sequence[int] = (7, 30),
) -> DataFrame:
    """Totals and averages of ``value`` over the last ``w`` days, for each entity and each day from ``start`` to ``end``.

    Output: entity, day, total_{w}d and avg_{w}d for each window; one row per entity and calendar day, active or not.

    Method: the rows are summed to one total per entity and day, each daily total is exploded onto every output day it
    influences together with the entity's calendar rows (which give the zeros), and the rows are grouped by entity and day.
    The daily totals are brought together by entity before the explode, so what is exploded is grouped where it lies, the
    input is read once, and only daily totals cross the network. An entity has at most one row a day by then, so a hot entity
    is no burden.

    Defined cases: null entity or day: the row is left out. Null value: 0 (the entity still gets its calendar). Repeated
    rows all count (drop copies before). Days outside the calendar feed the windows that reach them. The average divides
    by the whole length ``w``. Empty input: no rows. Integer values give exact totals. Other columns are ignored.
    """
    require_columns(df, entity, day, value)
    if not windows or min(windows) < 1:
        raise ValueError("windows must be positive")
    if start > end:
        raise ValueError("start lies after end")
    longest = max(windows)
    first, last = F.lit(start), F.lit(end)
    daily = (
        df.select(F.col(entity).alias("e"), F.col(day).cast("date").alias("d"), F.col(value).alias("v"))
        .where(F.col("e").isNotNull() & F.col("d").isNotNull())
        .groupBy("e", "d")
        .agg(F.sum(F.coalesce("v", F.lit(0))).alias("v"))
    )
    # an output day x is influenced by the daily total of d when d <= x < d + longest; the calendar rows of an entity, with no
    # day of influence, come from a single row of it, so one grouping by entity and day gives totals and zeros
    numbered = daily.withColumn("number", F.row_number().over(Window.partitionBy("e").orderBy("d")))
    lo, hi = F.greatest("d", first), F.least(F.date_add("d", longest - 1), last)
    none = F.array().cast("array<date>")
    placed = numbered.select(
        "e", "d", "v", F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(none).alias("influenced"),
        F.when(F.col("number") == 1, F.sequence(first, last)).otherwise(none).alias("calendar"),
    )
    rows = placed.select("e", "d", "v", F.size("influenced").alias("n"), F.posexplode(F.concat("influenced", "calendar")).alias("p", "x"))
    rows = rows.select("e", "v", "x", (F.col("p") < F.col("n")).alias("own"), F.datediff("x", "d").alias("age"))
    out = rows.groupBy("e", "x").agg(*(F.sum(F.when(F.col("own") & (F.col("age") < w), F.col("v"))).alias(f"t{w}") for w in windows))
    zero = lambda w: F.coalesce(F.col(f"t{w}"), F.lit(0))
    cols = [c for w in windows for c in (zero(w).alias(f"total_{w}d"), (zero(w) / w).alias(f"avg_{w}d"))]
    return out.select(F.col("e").alias(entity), F.col("x").alias(day), *cols)
