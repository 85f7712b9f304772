"""Scores, cost curves and thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import logistic, safe_ratio
from tidemark.operators.order import running_totals
from tidemark.session import require_columns


@dataclass(frozen=True)
class CostModel:
    """What an alert and a miss cost: share of the amount lost, fee per miss, review per alert, friction per false alert."""

    loss_share: float = 1.0
    miss_fee: float = 25.0
    review: float = 3.5
    friction: float = 12.0


def rule_score(rules: Sequence[tuple[Column, float]], intercept: float) -> Column:
    """Logistic score of weighted yes/no rules; a rule that is null doesn't hold."""
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(rule, weight).otherwise(0.0)
    return logistic(total)


def do_nothing_cost(label: Column, amount: Column, costs: CostModel) -> Column:
    """Aggregate: what it costs to raise no alert at all."""
    return F.coalesce(F.sum(F.when(label == 1, amount * costs.loss_share + costs.miss_fee)), F.lit(0.0))


def cost_curve(df: DataFrame, id: str, label: str, score: str, amount: str, costs: CostModel | None = None) -> DataFrame:
    """One row for each number of alerts from 0 to all rows, alerts going to the highest scores (ties: the smaller id).

    Output: alerts, threshold (null for 0 alerts), tp, fp, fn, caught_amount, precision, recall, alert_rate, total_cost, savings.

    Defined cases: rows with a null label or score are left out; a null amount is 0. Empty input: the row of 0 alerts only.
    """
    require_columns(df, id, label, score, amount)
    c = costs or CostModel()
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        F.col(id).alias("id"), (F.col(label) == 1).cast("bigint").alias("y"), F.col(score).cast("double").alias("s"), F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("a")
    )
    run = running_totals(rows, [F.desc("s"), F.asc("id")], {"alerts": F.lit(1).cast("bigint"), "tp": F.col("y"), "caught": F.col("y") * F.col("a")})
    zero = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("s"), F.lit(0).cast("bigint").alias("alerts"), F.lit(0).cast("bigint").alias("tp"), F.lit(0.0).alias("caught")
    )
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.coalesce(F.sum(F.col("y") * F.col("a")), F.lit(0.0)).alias("all_amount"))
    k = run.select("s", "alerts", "tp", "caught").unionByName(zero).join(F.broadcast(whole))
    fp, fn = F.col("alerts") - F.col("tp"), F.col("p") - F.col("tp")
    cost = (F.col("all_amount") - F.col("caught")) * c.loss_share + fn * c.miss_fee + F.col("alerts") * c.review + fp * c.friction
    nothing = F.col("all_amount") * c.loss_share + F.col("p") * c.miss_fee
    return k.select(
        "alerts", F.col("s").alias("threshold"), "tp", fp.alias("fp"), fn.alias("fn"), F.col("caught").alias("caught_amount"),
        F.coalesce(safe_ratio(F.col("tp"), F.col("alerts")), F.lit(0.0)).alias("precision"),
        (F.col("tp") / F.greatest("p", F.lit(1))).alias("recall"), F.coalesce(safe_ratio(F.col("alerts"), F.col("n")), F.lit(0.0)).alias("alert_rate"),
        cost.alias("total_cost"), (nothing - cost).alias("savings"),
    )


def cheapest_threshold(curve: DataFrame, max_alert_rate: float | None = None) -> DataFrame:
    """The row of a cost curve with the least cost within the cap; ties go to the fewest alerts."""
    require_columns(curve, "alerts", "total_cost", "alert_rate")
    if max_alert_rate is not None and max_alert_rate < 0:
        raise ValueError("the cap excludes every threshold")
    within = curve if max_alert_rate is None else curve.where(F.col("alert_rate") <= max_alert_rate)
    return within.orderBy("total_cost", "alerts").limit(1)


def recall_at_precision(curve: DataFrame, target: float) -> DataFrame:
    """The highest recall among the alerts whose precision is at least ``target``, else 0. One row."""
    ok = (F.col("alerts") > 0) & (F.col("precision") >= target)
    return curve.agg(F.coalesce(F.max(F.when(ok, F.col("recall"))), F.lit(0.0)).alias("recall"))


def operating_point(df: DataFrame, label: str, score: str, amount: str, threshold: float | Column, costs: CostModel | None = None) -> DataFrame:
    """Counts, money and rates when every row with score >= threshold raises an alert. One row."""
    require_columns(df, label, score, amount)
    c = costs or CostModel()
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    a = F.coalesce(F.col(amount), F.lit(0.0))
    count = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0))
    money = lambda x: F.coalesce(F.sum(F.when(x, a).otherwise(0.0)), F.lit(0.0))
    t = df.agg(
        count(hit).alias("alerts"), count(hit & y).alias("tp"), count(hit & ~y).alias("fp"), count(~hit & y).alias("fn"),
        money(hit & y).alias("recovered"), money(~hit & y).alias("missed"), do_nothing_cost(F.col(label), a, c).alias("do_nothing"),
    )
    cost = F.col("missed") * c.loss_share + F.col("fn") * c.miss_fee + F.col("alerts") * c.review + F.col("fp") * c.friction
    t = t.withColumn("total_cost", cost).withColumn("savings", F.col("do_nothing") - cost)
    return t.withColumns(
        {
            "precision": F.coalesce(safe_ratio(F.col("tp"), F.col("alerts")), F.lit(0.0)), "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)),
            "savings_rate": F.coalesce(safe_ratio(F.col("savings"), F.col("do_nothing")), F.lit(0.0)),
        }
    )


def precision_at_budget(df: DataFrame, id: str, label: str, score: str, budget: int) -> DataFrame:
    """Precision and recall of the ``budget`` highest scores (ties: the smaller id). One row."""
    require_columns(df, id, label, score)
    if budget <= 0:
        raise ValueError("the budget must be positive")
    top = df.where(F.col(score).isNotNull()).orderBy(F.desc(score), F.asc(id)).limit(budget)
    hits = top.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("tp"))
    whole = df.agg(F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("p"))
    return hits.join(F.broadcast(whole)).select(
        F.coalesce(safe_ratio(F.col("tp"), F.col("n")), F.lit(0.0)).alias("precision"), (F.col("tp") / F.greatest("p", F.lit(1))).alias("recall")
    )


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive; an error when there is no positive. One row."""
    t = df.agg(F.sum((F.col(label) == 1).cast("bigint")).alias("p"), F.sum((F.col(label) == 0).cast("bigint")).alias("n"))
    return t.select(F.when(F.col("p") > 0, F.col("n") / F.col("p")).otherwise(F.raise_error(F.lit("no positive rows")).cast("double")).alias("weight"))
