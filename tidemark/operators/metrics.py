"""Metrics of scored rows, exact under ties."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import bin_of, clip, safe_ratio
from tidemark.operators.order import exact_quantiles, running_totals
from tidemark.session import Stage, require_columns


def ranking_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """n, positive_rate, average_precision, roc_auc, brier, log_loss, lift, in one row; null where only one class is present.

    Rows of one score are one step: average precision is the step sum over the different scores, the area under the ROC
    curve counts ties half. Rows are merged by score before anything runs over the order.
    """
    require_columns(df, label, score)
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select((F.col(label) == 1).cast("bigint").alias("y"), F.col(score).cast("double").alias("s"))
    steps = rows.groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    run = Stage(running_totals(steps, [F.desc("s")], {"k": F.col("n"), "tp": F.col("p")})).df
    whole = run.agg(F.sum("n").alias("n_all"), F.sum("p").alias("p_all"))
    y, s, c = F.col("y"), F.col("s"), clip(F.col("s"), 1e-9, 1 - 1e-9)
    losses = rows.agg(F.avg((s - y) * (s - y)).alias("brier"), F.avg(-(y * F.log(c) + (1 - y) * F.log(1 - c))).alias("log_loss"))
    # ranks count from the smallest score: n_all - k rows lie below this step
    mid = (F.col("n_all") - F.col("k")) + (F.col("n") + 1) / 2
    ap = F.sum(F.col("p") / F.col("p_all") * (F.col("tp") / F.col("k")))
    one = run.join(F.broadcast(whole)).agg(F.max("n_all").alias("n"), F.max("p_all").alias("p"), ap.alias("ap"), F.sum(F.col("p") * mid).alias("ranks"))
    both = (F.col("p") > 0) & (F.col("p") < F.col("n"))
    roc = (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))
    rate = F.col("p") / F.col("n")
    return one.join(F.broadcast(losses)).select(
        F.coalesce("n", F.lit(0)).alias("n"), rate.alias("positive_rate"), F.when(both, F.col("ap")).alias("average_precision"), F.when(both, roc).alias("roc_auc"),
        "brier", "log_loss", F.when(both, F.col("ap") / rate).alias("lift"),
    )


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """accuracy, f1 (0 without positives), majority floor and positive rate at score >= threshold. One row."""
    require_columns(df, label, score)
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    n = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0))
    t = df.where(F.col(label).isNotNull()).agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"), F.count("*").alias("n"))
    p = F.col("tp") + F.col("fn")
    return t.select(
        ((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n")).alias("accuracy"),
        F.coalesce(safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"),
        (F.greatest(p, F.col("n") - p) / F.col("n")).alias("majority_floor"), (p / F.col("n")).alias("positive_rate"),
    )


def best_f1_threshold(df: DataFrame, label: str, score: str, candidates: int = 200) -> DataFrame:
    """The threshold with the best F1 among ``candidates`` quantiles of the score from 1 to 99 %; ties: the lowest. One row."""
    require_columns(df, label, score)
    ts = sorted({q for q in exact_quantiles(df, F.col(score), np.linspace(0.01, 0.99, candidates).tolist()) if q is not None})
    spark = df.sparkSession
    if not ts:
        return spark.createDataFrame([], "threshold double, f1 double")
    y = (F.col(label) == 1).cast("bigint")
    cells = df.where(F.col(label).isNotNull()).groupBy(bin_of(F.col(score).cast("double"), ts).alias("b")).agg(F.count("*").alias("n"), F.sum(y).alias("p")).collect()
    by, best = {r.b: (r.n, r.p) for r in cells}, None
    p_all = sum(p for _, p in by.values())
    for k in range(len(ts)):
        n, p = (sum(by[b][j] for b in by if b is not None and b > k) for j in (0, 1))
        f1 = 2 * p / (n + p_all) if n + p_all else 0.0
        if best is None or f1 > best[1]:
            best = (ts[k], f1)
    return spark.createDataFrame([best], "threshold double, f1 double")


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_predicted, observed, gap, over bins between quantiles of the score (closed on the left); empty bins have no row."""
    require_columns(df, label, score)
    edges = exact_quantiles(df, F.col(score), [k / bins for k in range(1, bins)])
    if edges and edges[0] is None:
        return df.sparkSession.createDataFrame([], "bin int, n bigint, mean_predicted double, observed double, gap double")
    g = df.where(F.col(score).isNotNull()).groupBy(bin_of(F.col(score).cast("double"), edges).alias("bin"))
    t = g.agg(F.count("*").alias("n"), F.avg(score).alias("mean_predicted"), F.avg(label).alias("observed"))
    return t.withColumn("gap", F.col("mean_predicted") - F.col("observed"))


def worst_errors(df: DataFrame, id: str, label: str, score: str, n: int) -> DataFrame:
    """The ``n`` rows whose score is farthest from the label (ties: the smaller id)."""
    require_columns(df, id, label, score)
    return df.withColumn("error", F.abs(F.col(label) - F.col(score))).where("error is not null").orderBy(F.desc("error"), F.asc(id)).limit(n)


def by_negative_kind(df: DataFrame, label: str, score: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """ranking_metrics for each kind of negatives, over all positives and the negatives of that kind. The scores are computed once."""
    out, rows = None, Stage(df.select(label, score, kind)).df
    for k in kinds:
        one = ranking_metrics(rows.where((F.col(label) == 1) | (F.col(kind) == k)), label, score).withColumn("kind", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def forecast_metrics(y: Column, f: Column) -> dict[str, Column]:
    """Aggregates: wape, mae, rmse, smape, bias. Ratios are null where their denominator is 0."""
    e, half = f - y, (F.abs(y) + F.abs(f)) / 2
    return {
        "wape": safe_ratio(F.sum(F.abs(e)), F.sum(F.abs(y))), "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)),
        "smape": F.avg(F.when(half > 0, F.abs(e) / half)), "bias": safe_ratio(F.sum(e), F.sum(F.abs(y))),
    }
