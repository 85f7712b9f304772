"""Queries over transactions: causal features, scores, thresholds, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import fixed
from tidemark.operators import decision, history, metrics
from tidemark.sources.tables import TRANSACTIONS_SQL, transactions

R = "round(({}) + 3.3e-7, 5)"
#: Fixed values of the rule score: rule, weight.
RATIO, DISTANCE, VELOCITY, INTERCEPT = 3.0, 300.0, 2, -2.2
RISKY = ("gift_card", "digital_goods", "electronics")


def _history(spark: SparkSession, d: str) -> DataFrame:
    return history.with_history(transactions(spark, d), "account_id", "timestamp", "transaction_id", "amount", "merchant_category")


def txn_prior_stats(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("transaction_id", F.col("prior_count").alias("prior_txn_count"), fixed(F.col("prior_mean")).alias("prior_mean"), fixed(F.col("prior_std")).alias("prior_std"))


def txn_minutes_since_prev(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("transaction_id", fixed(F.coalesce("minutes_since_prev", F.lit(history.NO_PRIOR_MINUTES))).alias("minutes_since_prev_txn"))


def txn_first_in_category(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("transaction_id", F.col("is_first_in_category").cast("int").alias("is_new"))


def txn_velocity_1h_24h(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("transaction_id", F.col("count_1h").alias("txn_count_1h"), F.col("count_24h").alias("txn_count_24h"), fixed(F.col("sum_24h")).alias("amount_sum_24h"))


def txn_features_full(spark: SparkSession, d: str) -> DataFrame:
    f = history.build_features(transactions(spark, d))
    return f.select(*(fixed(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes))


def rule_column() -> Column:
    """The rule score of a row of features."""
    rules = [
        (F.col("is_foreign") == 1, 1.1), (F.col("card_present") == 0, 0.8), (F.col("amount_to_account_mean") > RATIO, 1.3), (F.col("is_night") == 1, 0.4),
        (F.col("txn_count_1h") >= VELOCITY, 1.5), (F.col("distance_from_home_km") > DISTANCE, 0.9), (F.col("merchant_category").isin(*RISKY), 0.7),
    ]
    return decision.rule_score(rules, INTERCEPT)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """transaction_id, timestamp, amount, label y, and the rule score."""
    t = transactions(spark, d)
    s = history.build_features(t).select("transaction_id", rule_column().alias("score"))
    return t.select("transaction_id", "timestamp", "amount", F.col("is_fraud").alias("y")).join(s, "transaction_id")


def txn_rule_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("transaction_id", fixed(F.col("score")).alias("score"))


def temporal_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return history.temporal_split(transactions(spark, d), "timestamp").groupBy("split").agg(F.count("*").alias("n"), F.sum("is_fraud").alias("n_pos"))


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return decision.cost_curve(scored(spark, d), "transaction_id", "y", "score", "amount")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(fixed(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def cost_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_curve(spark, d))


def min_cost_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(decision.cheapest_threshold(_curve(spark, d), 0.01))


def recall_at_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(decision.recall_at_precision(_curve(spark, d), 0.2))


def operating_point(spark: SparkSession, d: str) -> DataFrame:
    return rounded(decision.operating_point(scored(spark, d), "y", "score", "amount", 0.5))


def precision_at_budget(spark: SparkSession, d: str) -> DataFrame:
    return rounded(decision.precision_at_budget(scored(spark, d), "transaction_id", "y", "score", 50))


def pos_weight(spark: SparkSession, d: str) -> DataFrame:
    return rounded(decision.positive_weight(transactions(spark, d), "is_fraud"))


def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ranking_metrics(scored(spark, d), "y", "score"))


def threshold_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.threshold_metrics(scored(spark, d), "y", "score", 0.5))


def best_f1_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.best_f1_threshold(scored(spark, d), "y", "score"))


def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.calibration(scored(spark, d), "y", "score"))


def worst_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.worst_errors(scored(spark, d), "transaction_id", "y", "score", 20).select("transaction_id", "y", "score", "error"))


QUERIES = {
    f.__name__: f
    for f in (
        txn_prior_stats, txn_minutes_since_prev, txn_first_in_category, txn_velocity_1h_24h, txn_features_full, txn_rule_score, temporal_split_counts, cost_curve,
        min_cost_threshold, recall_at_precision, operating_point, precision_at_budget, pos_weight, ranking_metrics, threshold_metrics, best_f1_threshold, calibration_bins, worst_errors,
    )
}

_H = f"""WITH {TRANSACTIONS_SQL}, h AS (SELECT *, count(*) OVER w AS n, avg(amount) OVER w AS mean, stddev_samp(amount) OVER w AS std,
  (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER o)) / 60000000.0 AS gap,
  row_number() OVER (PARTITION BY account_id, merchant_category ORDER BY timestamp, transaction_id) = 1 AS first_cat,
  count(*) OVER (PARTITION BY account_id ORDER BY timestamp RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS c1,
  count(*) OVER d1 AS c24, coalesce(sum(amount) OVER d1, 0.0) AS s24
  FROM txn WINDOW o AS (PARTITION BY account_id ORDER BY timestamp, transaction_id), w AS (PARTITION BY account_id ORDER BY timestamp, transaction_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), d1 AS (PARTITION BY account_id ORDER BY timestamp RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)),
f AS (SELECT transaction_id, timestamp, amount, is_fraud AS y, ln(1 + amount) AS log_amount, CASE WHEN mean > 0 THEN amount / mean ELSE 1.0 END AS amount_to_account_mean,
  CASE WHEN std > 1e-6 THEN (amount - mean) / std ELSE 0.0 END AS amount_zscore_account, distance_from_home_km, ln(1 + account_age_days) AS log_account_age_days,
  CAST(hour(timestamp) AS INTEGER) AS hour, sin(hour(timestamp) * 2 * pi() / 24) AS hour_sin, cos(hour(timestamp) * 2 * pi() / 24) AS hour_cos,
  CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week, n AS prior_txn_count, c1 AS txn_count_1h, c24 AS txn_count_24h, s24 AS amount_sum_24h,
  coalesce(gap, 525600.0) AS minutes_since_prev_txn, CAST(card_present AS INTEGER) AS card_present, CAST(is_foreign AS INTEGER) AS is_foreign,
  CAST(hour(timestamp) IN (23, 0, 1, 2, 3, 4) AS INTEGER) AS is_night, CAST(isodow(timestamp) >= 6 AS INTEGER) AS is_weekend,
  CAST(n > 0 AS INTEGER) AS has_account_history, CAST(first_cat AS INTEGER) AS is_new_category_for_account, merchant_category FROM h)"""
_S = (
    _H
    + f""", s AS (SELECT transaction_id, timestamp, amount, y, 1 / (1 + exp(-(-2.2 + CASE WHEN is_foreign = 1 THEN 1.1 ELSE 0 END + CASE WHEN card_present = 0 THEN 0.8 ELSE 0 END
  + CASE WHEN amount_to_account_mean > 3 THEN 1.3 ELSE 0 END + CASE WHEN is_night = 1 THEN 0.4 ELSE 0 END + CASE WHEN txn_count_1h >= 2 THEN 1.5 ELSE 0 END
  + CASE WHEN distance_from_home_km > 300 THEN 0.9 ELSE 0 END + CASE WHEN merchant_category IN {RISKY} THEN 0.7 ELSE 0 END)::DOUBLE)) AS score FROM f)"""
)
_K = (
    _S
    + """, t AS (SELECT count(*) AS n, sum(y) AS p, sum(y * amount) AS aa FROM s),
k AS (SELECT row_number() OVER w AS alerts, score AS threshold, sum(y) OVER w AS tp, sum(y * amount) OVER w AS caught FROM s
  WINDOW w AS (ORDER BY score DESC, transaction_id ROWS UNBOUNDED PRECEDING) UNION ALL SELECT 0, NULL, 0, 0.0),
c AS (SELECT CAST(alerts AS BIGINT) AS alerts, threshold, CAST(tp AS BIGINT) AS tp, CAST(alerts - tp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn, caught AS caught_amount,
  CASE WHEN alerts > 0 THEN tp / alerts ELSE 0.0 END AS precision, tp / greatest(p, 1) AS recall, alerts / n AS alert_rate,
  (aa - caught) + (p - tp) * 25.0 + alerts * 3.5 + (alerts - tp) * 12.0 AS total_cost FROM k, t),
cc AS (SELECT *, (SELECT aa + p * 25.0 FROM t) - total_cost AS savings FROM c)"""
)
_CC = ["threshold", "caught_amount", "precision", "recall", "alert_rate", "total_cost", "savings"]
_CURVE = "SELECT alerts, tp, fp, fn, " + ", ".join(f"{R.format(c)} AS {c}" for c in _CC) + " FROM cc"
_DOUBLES = ["log_amount", "amount_to_account_mean", "amount_zscore_account", "distance_from_home_km", "log_account_age_days", "hour_sin", "hour_cos", "amount_sum_24h", "minutes_since_prev_txn"]
PROBS = [0.01 + i * 0.98 / 199 for i in range(200)]
_RANK = """, g AS (SELECT score, count(*) AS n, sum(y) AS p FROM s GROUP BY 1), r AS (SELECT *, sum(n) OVER w AS k, sum(p) OVER w AS tp, sum(n) OVER () AS na, sum(p) OVER () AS pa
  FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT max(na) AS n, max(pa) AS p, sum(p / pa * (tp / k)) AS ap, sum(p * (na - k + (n + 1) / 2.0)) AS ranks FROM r),
l AS (SELECT avg((score - y) * (score - y)) AS brier, avg(-(y * ln(greatest(least(score, 1 - 1e-9), 1e-9)) + (1 - y) * ln(1 - greatest(least(score, 1 - 1e-9), 1e-9)))) AS log_loss FROM s)"""
RANK_SELECT = (
    f" SELECT CAST(n AS BIGINT) AS n, {R.format('p / n')} AS positive_rate, {R.format('ap')} AS average_precision, {R.format('(ranks - p * (p + 1) / 2.0) / (p * (n - p))')} AS roc_auc, "
    f"{R.format('brier')} AS brier, {R.format('log_loss')} AS log_loss, {R.format('ap / (p / n)')} AS lift FROM m, l"
)

ORACLE = {
    "txn_prior_stats": _H + f" SELECT transaction_id, n AS prior_txn_count, {R.format('mean')} AS prior_mean, {R.format('std')} AS prior_std FROM h",
    "txn_minutes_since_prev": _H + f" SELECT transaction_id, {R.format('minutes_since_prev_txn')} AS minutes_since_prev_txn FROM f",
    "txn_first_in_category": _H + " SELECT transaction_id, is_new_category_for_account AS is_new FROM f",
    "txn_velocity_1h_24h": _H + f" SELECT transaction_id, txn_count_1h, txn_count_24h, {R.format('amount_sum_24h')} AS amount_sum_24h FROM f",
    "txn_features_full": _H + " SELECT transaction_id, " + ", ".join(f"{R.format(c)} AS {c}" if c in _DOUBLES else c for c in history.FEATURES) + " FROM f",
    "txn_rule_score": _S + f" SELECT transaction_id, {R.format('score')} AS score FROM s",
    "temporal_split_counts": f"""WITH {TRANSACTIONS_SQL}, q AS (SELECT quantile_cont(epoch_us(timestamp), 0.6) AS a, quantile_cont(epoch_us(timestamp), 0.8) AS b FROM txn)
  SELECT CASE WHEN epoch_us(timestamp) <= a THEN 'train' WHEN epoch_us(timestamp) <= b THEN 'valid' ELSE 'test' END AS split, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS n_pos
  FROM txn, q GROUP BY 1""",
    "cost_curve": f"{_K} {_CURVE}",
    "min_cost_threshold": f"{_K} SELECT * FROM ({_CURVE} WHERE alert_rate <= 0.01 ORDER BY cc.total_cost, cc.alerts LIMIT 1)",
    "recall_at_precision": _K + f" SELECT {R.format('coalesce(max(recall) FILTER (WHERE alerts > 0 AND precision >= 0.2), 0.0)')} AS recall FROM cc",
    "operating_point": _S
    + f""", o AS (SELECT count(*) FILTER (WHERE score >= 0.5) AS alerts, count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND y = 0) AS fp,
  count(*) FILTER (WHERE score < 0.5 AND y = 1) AS fn, coalesce(sum(amount) FILTER (WHERE score >= 0.5 AND y = 1), 0.0) AS recovered,
  coalesce(sum(amount) FILTER (WHERE score < 0.5 AND y = 1), 0.0) AS missed, sum(amount + 25.0) FILTER (WHERE y = 1) AS do_nothing FROM s),
  oo AS (SELECT *, missed + fn * 25.0 + alerts * 3.5 + fp * 12.0 AS total_cost FROM o)
  SELECT alerts, tp, fp, fn, {R.format('recovered')} AS recovered, {R.format('missed')} AS missed, {R.format('do_nothing')} AS do_nothing, {R.format('total_cost')} AS total_cost,
  {R.format('do_nothing - total_cost')} AS savings, {R.format('tp / alerts')} AS precision, {R.format('tp / greatest(tp + fn, 1)')} AS recall,
  {R.format('(do_nothing - total_cost) / do_nothing')} AS savings_rate FROM oo""",
    "precision_at_budget": _S
    + f" SELECT {R.format('sum(y) / count(*)')} AS precision, {R.format('sum(y) / (SELECT greatest(sum(y), 1) FROM s)')} AS recall FROM (SELECT y FROM s ORDER BY score DESC, transaction_id LIMIT 50)",
    "pos_weight": f"WITH {TRANSACTIONS_SQL} SELECT {R.format('count(*) FILTER (WHERE is_fraud = 0) / count(*) FILTER (WHERE is_fraud = 1)')} AS weight FROM txn",
    "ranking_metrics": _S + _RANK + RANK_SELECT,
    "threshold_metrics": _S
    + f""", o AS (SELECT count(*) AS n, count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND y = 0) AS fp,
  count(*) FILTER (WHERE score < 0.5 AND y = 1) AS fn FROM s) SELECT {R.format('(n - fp - fn) / n')} AS accuracy, {R.format('2 * tp / (2 * tp + fp + fn)')} AS f1,
  {R.format('greatest(tp + fn, n - tp - fn) / n')} AS majority_floor, {R.format('(tp + fn) / n')} AS positive_rate FROM o""",
    "best_f1_threshold": _S
    + f""", q AS (SELECT DISTINCT unnest(quantile_cont(score, {PROBS})) AS threshold FROM s),
  e AS (SELECT threshold, 2 * count(*) FILTER (WHERE score >= threshold AND y = 1) / (count(*) FILTER (WHERE score >= threshold) + sum(y)) AS f1 FROM q, s GROUP BY 1)
  SELECT * FROM (SELECT {R.format('threshold')} AS threshold, {R.format('f1')} AS f1 FROM e ORDER BY e.f1 DESC, e.threshold LIMIT 1)""",
    "calibration_bins": _S
    + f""", q AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM s), b AS (SELECT CAST(len([x for x in e if x <= score]) AS INTEGER) AS bin, score, y FROM s, q)
  SELECT bin, count(*) AS n, {R.format('avg(score)')} AS mean_predicted, {R.format('avg(y)')} AS observed, {R.format('avg(score) - avg(y)')} AS gap FROM b GROUP BY bin""",
    "worst_errors": _S + f" SELECT transaction_id, y, {R.format('score')} AS score, {R.format('e')} AS error FROM (SELECT *, abs(y - score) AS e FROM s ORDER BY e DESC, transaction_id LIMIT 20)",
}
