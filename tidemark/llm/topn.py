"""The N best rows of every group, in one fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import Stage, require_columns

#: Histogram cells for each factor e of the score.
CELLS_PER_E = 16


def score_cell(score: Column) -> Column:
    """A histogram cell that never falls when the score rises: logarithmic, so a few hundred cells cover all scores."""
    s = score.cast("double")
    cell = F.floor(F.signum(s) * F.log1p(F.abs(s)) * CELLS_PER_E)
    return F.when(s.isNull(), F.lit(-(2**31))).when(F.isnan(s), F.lit(2**31 - 1)).otherwise(F.least(F.greatest(cell, F.lit(-(2**30))), F.lit(2**30))).cast("bigint")


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, most_heavy: int = 100_000) -> DataFrame:
    """The ``n`` rows of each ``group`` with the highest ``score``, ties going to the smaller ``item``; adds ``rank`` from 1.

    Output: group, item, score, rank.

    Method: the scores of every group are counted in a histogram (partial counts before the shuffle). The lowest cell that
    is needed for ``n`` rows, counted from the top, is a safe threshold: at least ``n`` rows of the group reach it, and no
    row below it can rank. Rows below their group's threshold are dropped and the rest is ranked. The thresholds of heavy
    groups (more than 1/``most_heavy`` of all rows, so by counting fewer than ``most_heavy`` of them) are broadcast and drop
    rows before any is shuffled by group; those of the other groups are joined by group, and the ranking goes on from there
    without another shuffle. The ranking of heavy groups keeps ``n`` rows per group in each task before its shuffle, which
    also covers a heavy group whose rows nearly all tie.

    Defined cases: null and repeated (group, item) rows are ranked like any other, the null group is a group; a null score
    ranks last, NaN first; a null item ranks after other items of the same score; equal rows take neighbouring ranks. A
    group with fewer than ``n`` rows keeps all. Empty input: no rows. Other columns are dropped.
    """
    require_columns(df, group, item, score)
    if n < 1:
        raise ValueError("n must be at least 1")
    st = Stage(df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s"))).df
    rows = st.withColumn("cell", score_cell(F.col("s")))
    total = st.count()
    hist = rows.groupBy("g", "cell").agg(F.count("*").alias("c"))
    w = Window.partitionBy("g")
    down = hist.select(
        "g", "cell", F.sum("c").over(w.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)).alias("above"), F.sum("c").over(w).alias("size")
    )
    # null for a group of fewer than n rows, which keeps all
    least = Stage(down.groupBy("g").agg(F.max(F.when(F.col("above") >= n, F.col("cell"))).alias("least"), F.max("size").alias("size"))).df
    heavy = least.where(F.col("size") * most_heavy > total).select(F.col("g").alias("hg"), "least", F.lit(True).alias("is_heavy"))
    marked = rows.join(F.broadcast(heavy), F.col("g").eqNullSafe(F.col("hg")), "left")
    reach = F.col("least").isNull() | (F.col("cell") >= F.col("least"))
    order = Window.partitionBy("g").orderBy(F.desc_nulls_last("s"), F.asc_nulls_last("i"))
    rank = lambda kept: kept.where(reach).select("g", "i", "s").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    light = marked.where("is_heavy is null").select("g", "i", "s", "cell")
    ranked = rank(marked.where("is_heavy")).unionByName(rank(light.join(least.select("g", "least"), "g", "left")))
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
