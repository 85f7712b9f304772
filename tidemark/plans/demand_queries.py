"""Queries over the sales panel: dense panel, horizon-safe features, backtest and its slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import fixed
from tidemark.operators import demand
from tidemark.plans.txn_queries import R
from tidemark.session import Stage
from tidemark.sources.tables import SALES_SQL, sales

HORIZON, FOLDS, MIN_DAYS = 14, 3, 60
H = f"h{HORIZON}"


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    df = df.select(*cols) if cols else df
    return df.select(*(fixed(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return demand.build_features(demand.densify(sales(spark, d)), HORIZON)


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    panel = Stage(demand.densify(sales(spark, d))).df
    return demand.backtest_columns(demand.build_features(panel, HORIZON), demand.folds_frame(panel, HORIZON, FOLDS, MIN_DAYS), demand.baseline_columns(HORIZON))


def panel_dense(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(demand.densify(sales(spark, d)))


def demand_lags(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_features(spark, d), "sku_id", "date", *(f"lag_{n}" for n in demand.lag_days(HORIZON)))


_ROLLING = [c for c in demand.feature_columns(HORIZON) if not c.startswith("lag_")]


def demand_rolling(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_features(spark, d), "sku_id", "date", *_ROLLING)


def demand_calendar(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_features(spark, d), "sku_id", "date", *demand.CALENDAR)


def training_mask(spark: SparkSession, d: str) -> DataFrame:
    return demand.training_frame(demand.densify(sales(spark, d))).groupBy("sku_id").agg(F.count("*").alias("n_train"), F.sum("units").alias("units"))


def backtest_folds(spark: SparkSession, d: str) -> DataFrame:
    return demand.folds_frame(sales(spark, d), HORIZON, FOLDS, MIN_DAYS)


def backtest_predictions(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_predictions(spark, d))


def backtest_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(demand.summarise(_predictions(spark, d)))


def forecast_value_add(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(demand.value_added(demand.summarise(_predictions(spark, d)), "seasonal_naive"))


def metrics_by_category(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(demand.by_group(_predictions(spark, d), "model", "category")).orderBy(F.desc("volume"), "category", "model")


def metrics_by_horizon_day(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(demand.by_group(_predictions(spark, d), "model", "days_ahead"))


def metrics_by_week(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(demand.by_week(_predictions(spark, d)))


QUERIES = {
    f.__name__: f
    for f in (
        panel_dense, demand_lags, demand_rolling, demand_calendar, training_mask, backtest_folds, backtest_predictions, backtest_summary, forecast_value_add,
        metrics_by_category, metrics_by_horizon_day, metrics_by_week,
    )
}

PANEL_SQL = f"""WITH {SALES_SQL}, span AS (SELECT min(date) AS a, max(date) AS b FROM sales), keys AS (SELECT sku_id, max(base_price) AS base, min(category) AS cat FROM sales GROUP BY 1),
hol AS (SELECT date, max(is_holiday) AS h FROM sales GROUP BY 1),
panel AS (SELECT k.sku_id, g.date, k.cat AS category, coalesce(s.price, k.base) AS price, k.base AS base_price, coalesce(s.on_promo, false) AS on_promo,
  coalesce(hol.h, false) AS is_holiday, coalesce(s.was_in_stock, false) AS was_in_stock, coalesce(s.units, 0) AS units
  FROM keys k CROSS JOIN (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM span) g
  LEFT JOIN sales s ON s.sku_id = k.sku_id AND s.date = g.date LEFT JOIN hol ON hol.date = g.date)"""


def _frame(n: int) -> str:
    return f"(PARTITION BY sku_id ORDER BY date ROWS BETWEEN {HORIZON + n - 1} PRECEDING AND {HORIZON} PRECEDING)"


def _least(expr: str, n: int, need: int) -> str:
    return f"CASE WHEN count(units) OVER {_frame(n)} >= {need} THEN {expr} OVER {_frame(n)} END"


_ROLL_SQL = {f"{k}_{w}_{H}": _least(f"{fn}(units)", w, max(2, w // 4)) for w in demand.WINDOWS for k, fn in (("mean", "avg"), ("std", "stddev_samp"))}
_ROLL_SQL[f"nonzero_28_{H}"] = _least("avg(CASE WHEN units > 0 THEN 1.0 ELSE 0.0 END)", 28, 7)
_ROLL_SQL[f"promo_days_28_{H}"] = _least("sum(CAST(on_promo AS INTEGER))", 28, 7)
_LAG_SQL = ", ".join(f"lag(units, {n}) OVER (PARTITION BY sku_id ORDER BY date) AS lag_{n}" for n in demand.lag_days(HORIZON))
_F = PANEL_SQL + ", f0 AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _ROLL_SQL.items()) + f", {_LAG_SQL} FROM panel), "
_F += f"f AS (SELECT *, CASE WHEN mean_91_{H} > 0 THEN mean_7_{H} / mean_91_{H} END AS trend_{H} FROM f0)"
FOLDS_SQL = f"""fj AS (SELECT CAST({FOLDS - 1} - j AS INTEGER) AS fold, CAST(b - j * {HORIZON} AS DATE) AS test_end, CAST(b - j * {HORIZON} - {HORIZON - 1} AS DATE) AS test_start,
  CAST(b - j * {HORIZON} - {HORIZON} AS DATE) AS origin FROM (SELECT min(date) AS a, max(date) AS b FROM sales), (SELECT CAST(unnest(range({FOLDS})) AS INTEGER) AS j)
  WHERE (b - j * {HORIZON} - {HORIZON}) - a >= {MIN_DAYS})"""
_B = (
    _F
    + f""", {FOLDS_SQL}, tm AS (SELECT fold, avg(units) AS m FROM panel, fj WHERE date <= origin AND was_in_stock GROUP BY 1),
pr AS (SELECT model, fj.fold, origin, date, sku_id, category, CAST(date - origin AS INTEGER) AS days_ahead, units, greatest(coalesce(raw, m), 0.0) AS forecast
  FROM (SELECT sku_id, date, category, units, unnest(['seasonal_naive', 'moving_average', 'last_year']) AS model,
  unnest([CAST(lag_{HORIZON} AS DOUBLE), mean_28_{H}, CAST(lag_364 AS DOUBLE)]) AS raw FROM f) x JOIN fj ON date BETWEEN test_start AND test_end LEFT JOIN tm ON tm.fold = fj.fold)"""
)
_W = "sum(abs(forecast - units)) / nullif(sum(abs(units)), 0)"
_BIAS = "sum(forecast - units) / nullif(sum(abs(units)), 0)"
_SUM = (
    _B
    + f""", o AS (SELECT model, {_W} AS wape, avg(abs(forecast - units)) AS mae, sqrt(avg((forecast - units) * (forecast - units))) AS rmse,
  avg(CASE WHEN abs(units) + abs(forecast) > 0 THEN abs(forecast - units) / ((abs(units) + abs(forecast)) / 2) END) AS smape, {_BIAS} AS bias FROM pr GROUP BY 1),
pf AS (SELECT model, fold, {_W} AS w FROM pr GROUP BY 1, 2), sp AS (SELECT model, stddev_pop(w) AS wape_std, max(w) AS wape_worst, count(*) AS n_folds FROM pf GROUP BY 1)"""
)


def _grouped(cols: str) -> str:
    return _B + f" SELECT {cols}, count(*) AS n, CAST(sum(units) AS BIGINT) AS volume, {R.format(_W)} AS wape, {R.format(_BIAS)} AS bias FROM pr GROUP BY {cols}"


ORACLE = {
    "panel_dense": PANEL_SQL + f" SELECT sku_id, date, category, {R.format('price')} AS price, {R.format('base_price')} AS base_price, on_promo, is_holiday, was_in_stock, units FROM panel",
    "demand_lags": _F + " SELECT sku_id, date, " + ", ".join(f"lag_{n}" for n in demand.lag_days(HORIZON)) + " FROM f",
    "demand_rolling": _F + " SELECT sku_id, date, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c.startswith("promo") else f"{R.format(c)} AS {c}" for c in _ROLLING) + " FROM f",
    "demand_calendar": PANEL_SQL
    + f""" SELECT sku_id, date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, {R.format("sin(dayofyear(date) * 2 * pi() / 365.25)")} AS doy_sin,
  {R.format("cos(dayofyear(date) * 2 * pi() / 365.25)")} AS doy_cos, CAST(date - (SELECT a FROM span) AS INTEGER) AS days_since_start, {R.format("1 - price / nullif(base_price, 0)")} AS discount_pct,
  CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(on_promo AS INTEGER) AS promo_flag, CAST(is_holiday AS INTEGER) AS holiday_flag FROM panel""",
    "training_mask": PANEL_SQL + " SELECT sku_id, count(*) AS n_train, CAST(sum(units) AS BIGINT) AS units FROM panel WHERE was_in_stock GROUP BY 1",
    "backtest_folds": f"WITH {SALES_SQL}, {FOLDS_SQL} SELECT fold, origin, test_start, test_end FROM fj",
    "backtest_predictions": _B + f" SELECT model, fold, origin, date, sku_id, category, days_ahead, units, {R.format('forecast')} AS forecast FROM pr",
    "backtest_summary": _SUM
    + " SELECT model, " + ", ".join(f"{R.format(c)} AS {c}" for c in ("wape", "mae", "rmse", "smape", "bias", "wape_std", "wape_worst")) + ", n_folds FROM o JOIN sp USING (model)",
    "forecast_value_add": _SUM + f", b AS (SELECT wape AS bw FROM o WHERE model = 'seasonal_naive') SELECT model, {R.format('(bw - wape) / bw')} AS value_added FROM o, b",
    "metrics_by_category": _grouped("model, category"),
    "metrics_by_horizon_day": _grouped("model, days_ahead"),
    "metrics_by_week": _B
    + f", dd AS (SELECT model, days_ahead, {_W} AS w FROM pr GROUP BY 1, 2) SELECT model, CAST((days_ahead - 1) // 7 + 1 AS INTEGER) AS week, {R.format('avg(w)')} AS wape FROM dd GROUP BY 1, 2",
}
