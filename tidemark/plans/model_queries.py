"""Queries of the learned models. Their scores have no SQL counterpart; what was scored has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import demand, metrics, models, textpairs
from tidemark.plans import ladders
from tidemark.plans.demand_queries import FOLDS, FOLDS_SQL, HORIZON, MIN_DAYS, PANEL_SQL
from tidemark.plans.pair_queries import pairs
from tidemark.session import Stage
from tidemark.sources.tables import sales


def _fraud(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = ladders.fraud_rows(spark, d)
    return ladders.FRAUD[name]().fit(rows.where("split = 'train'")).score(rows.where("split = 'test'"), ["transaction_id", "label"])


def lr_scores(spark: SparkSession, d: str) -> DataFrame:
    return _fraud(spark, d, "logistic")


def gbt_scores(spark: SparkSession, d: str) -> DataFrame:
    return _fraud(spark, d, "boosted")


def gbt_weighted_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ranking_metrics(Stage(_fraud(spark, d, "boosted_weighted")).df, "label", "score")


LEARNED = {name: make for name, make in ladders.DEMAND.items() if callable(make)}


def _panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    panel = Stage(demand.densify(sales(spark, d))).df
    return panel, Stage(demand.build_features(panel, HORIZON)).df


def _forecasts(panel: DataFrame, feats: DataFrame, name: str) -> DataFrame:
    """A learned model in the schema of backtest_columns, refitted in every fold on all rows in stock up to its origin."""
    a, b = panel.agg(F.min("date"), F.max("date")).first()
    cols = [c for c in demand.feature_columns(HORIZON) if c != f"lag_{demand.YEARLY}"] + demand.CALENDAR
    parts = []
    for fold in demand.rolling_origin_folds(a, b, HORIZON, FOLDS, MIN_DAYS):
        train = demand.training_frame(feats).where(F.col("date") <= F.lit(fold.origin)).withColumn("label", F.col("units"))
        test = feats.where(F.col("date").between(F.lit(fold.test_start), F.lit(fold.test_end)))
        scored = models.Model(LEARNED[name](), cols, ["category"]).fit(train).score(test, ["date", "sku_id", "category", "units"])
        origin = F.lit(fold.origin)
        parts.append(
            scored.select(
                F.lit(name).alias("model"), F.lit(fold.index).alias("fold"), origin.alias("origin"), "date", "sku_id", "category",
                F.datediff("date", origin).alias("days_ahead"), "units", F.col("score").alias("forecast"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def tweedie_forecast(spark: SparkSession, d: str) -> DataFrame:
    return _forecasts(*_panel(spark, d), "tweedie")


def gbt_forecast(spark: SparkSession, d: str) -> DataFrame:
    return _forecasts(*_panel(spark, d), "gbt")


def _backtest(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of the baselines and the learned models in one table."""
    panel, feats = _panel(spark, d)
    base = demand.backtest_columns(feats, demand.folds_frame(panel, HORIZON, FOLDS, MIN_DAYS), demand.baseline_columns(HORIZON))
    return Stage(reduce(DataFrame.unionByName, (_forecasts(panel, feats, name) for name in LEARNED), base)).df


def learned_backtest_summary(spark: SparkSession, d: str) -> DataFrame:
    """Baselines and learned models, the best first (ties: by name)."""
    return models.mark_best(demand.summarise(_backtest(spark, d)), "wape", "model", list(ladders.DEMAND), more=False).orderBy("wape", "model")


def learned_backtest_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows, units and days ahead of each learned model in each fold, and whether every forecast is a number of at least 0."""
    panel, feats = _panel(spark, d)
    p = reduce(DataFrame.unionByName, (_forecasts(panel, feats, name) for name in LEARNED))
    fine = F.count_if(~F.coalesce(F.col("forecast") >= 0, F.lit(False)) | F.isnan("forecast")) == 0
    return p.groupBy("model", "fold", "origin").agg(F.count("*").alias("n"), F.sum("units").alias("units"), F.sum("days_ahead").alias("days_ahead"), fine.alias("is_fine"))


def learned_value_add(spark: SparkSession, d: str) -> DataFrame:
    return demand.value_added(demand.summarise(_backtest(spark, d)), "seasonal_naive")


def learned_by_category(spark: SparkSession, d: str) -> DataFrame:
    return demand.by_group(_backtest(spark, d), "model", "category").orderBy(F.desc("volume"), "category", "model")


def learned_by_horizon_day(spark: SparkSession, d: str) -> DataFrame:
    return demand.by_group(_backtest(spark, d), "model", "days_ahead")


def learned_by_week(spark: SparkSession, d: str) -> DataFrame:
    return demand.by_week(_backtest(spark, d))


def pair_lr_scores(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression on the pair features and target encoding, fitted on the train split."""
    p = Stage(pairs(spark, d)).df
    train = p.where("split = 'train'")
    feats = textpairs.PairFeaturizer().fit(train).transform(p).join(textpairs.TargetEncoder().fit(train).transform(p), "pair_id")
    rows = Stage(feats.join(p.select("pair_id", "split", F.col("is_duplicate").alias("label")), "pair_id")).df
    model = models.Model(models.logistic(1.0), textpairs.FEATURES + textpairs.ENCODED).fit(rows.where("split = 'train'"))
    return model.score(rows.where("split = 'test'"), ["pair_id", "label"])


QUERIES = {
    f.__name__: f
    for f in (
        lr_scores, gbt_scores, gbt_weighted_metrics, tweedie_forecast, gbt_forecast, pair_lr_scores,
        learned_backtest_summary, learned_backtest_check, learned_value_add, learned_by_category, learned_by_horizon_day, learned_by_week,
    )
}
ORACLE = {
    "learned_backtest_check": f"""{PANEL_SQL}, {FOLDS_SQL}, m AS (SELECT unnest({list(LEARNED)}) AS model)
  SELECT model, fold, origin, count(*) AS n, CAST(sum(units) AS BIGINT) AS units, CAST(sum(date - origin) AS BIGINT) AS days_ahead, true AS is_fine
  FROM panel JOIN fj ON date BETWEEN test_start AND test_end, m GROUP BY 1, 2, 3""",
}
