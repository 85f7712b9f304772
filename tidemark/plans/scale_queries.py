"""Queries of the general large-table operators (p1, p2) and their oracle SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.rolling import rolling_totals
from tidemark.operators.skew import per_key_stats
from tidemark.session import read_table

FIRST, LAST = dt.date(2024, 1, 1), dt.date(2024, 6, 28)


def _account_days(spark: SparkSession, d: str) -> DataFrame:
    """One row per transaction (copies once): entity, day, cents."""
    return (
        read_table(spark, d, "transactions")
        .where("account_id is not null")
        .select(
            "transaction_id", F.col("account_id").cast("string").alias("entity"), F.to_date("timestamp").alias("day"),
            F.coalesce(F.round(F.col("amount") * 100).cast("bigint"), F.lit(0)).alias("v"),
        )
        .distinct()
    )


def _sku_days(spark: SparkSession, d: str) -> DataFrame:
    """One row per SKU and date, the one recorded last: entity, day, units."""
    return (
        read_table(spark, d, "sales_panel")
        .select(F.upper(F.trim("sku_id")).alias("entity"), F.col("date").alias("day"), F.struct("recorded_at", "units").alias("r"))
        .groupBy("entity", "day")
        .agg(F.max("r").alias("r"))
        .select("entity", "day", F.coalesce(F.col("r.units"), F.lit(0)).cast("bigint").alias("v"))
    )


def p1_account_totals(spark: SparkSession, d: str) -> DataFrame:
    t = rolling_totals(_account_days(spark, d), "entity", "day", "v", FIRST, LAST)
    return t.select("entity", "day", "total_7d", "total_30d", F.round(F.col("avg_7d") / 100, 4).alias("avg_7d"), F.round(F.col("avg_30d") / 100, 4).alias("avg_30d"))


def p1_sku_totals(spark: SparkSession, d: str) -> DataFrame:
    t = rolling_totals(_sku_days(spark, d), "entity", "day", "v", FIRST, LAST)
    return t.select("entity", "day", "total_7d", "total_30d", F.round("avg_7d", 4).alias("avg_7d"), F.round("avg_30d", 4).alias("avg_30d"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Entities and days whose last 7 days make up more than 70 % of the last 30, above a least total."""

    def cases(days: DataFrame, least: int) -> DataFrame:
        t = rolling_totals(days, "entity", "day", "v", FIRST, LAST)
        hit = (F.col("day") >= F.lit(dt.date(2024, 1, 30))) & (F.col("total_7d") * 10 > F.col("total_30d") * 7) & (F.col("total_7d") >= least)
        return t.where(hit).select("entity", F.date_format("day", "yyyy-MM-dd").alias("day_text"))

    return cases(_account_days(spark, d), 200_000).unionByName(cases(_sku_days(spark, d), 150)).distinct()


def _stats(spark: SparkSession, d: str, key: str) -> DataFrame:
    return per_key_stats(read_table(spark, d, "interactions"), key, "timestamp", "play_count")


def p2_item_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, "item_id")


def p2_user_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, "user_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys of interactions that hold more than 1 % of all rows."""
    total = read_table(spark, d, "interactions").agg(F.count("*")).scalar()
    parts = [
        _stats(spark, d, k).where(F.col(k).isNotNull() & (F.col("n_rows") * 100 > total)).select(F.lit(k).alias("key_kind"), F.col(k).alias("key_id"))
        for k in ("item_id", "user_id")
    ]
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (p1_account_totals, p1_sku_totals, p1_found, p2_item_stats, p2_user_stats, p2_found)}

_ROLL = """
, cal AS (SELECT entity, CAST(d AS DATE) AS day FROM (SELECT DISTINCT entity FROM days),
  generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-06-28', INTERVAL 1 DAY) g(d)),
daily AS (SELECT entity, day, sum(v) AS v FROM days GROUP BY 1, 2),
roll AS (SELECT entity, day, CAST(sum(coalesce(v, 0)) OVER (w ROWS 6 PRECEDING) AS BIGINT) AS total_7d,
  CAST(sum(coalesce(v, 0)) OVER (w ROWS 29 PRECEDING) AS BIGINT) AS total_30d
  FROM cal LEFT JOIN daily USING (entity, day) WINDOW w AS (PARTITION BY entity ORDER BY day))"""
_ACC = """WITH days AS (SELECT DISTINCT transaction_id, CAST(account_id AS VARCHAR) AS entity, CAST(timestamp AS DATE) AS day,
  coalesce(CAST(round(amount * 100) AS BIGINT), 0) AS v FROM transactions WHERE account_id IS NOT NULL)""" + _ROLL
_SKU = """WITH days AS (SELECT entity, day, coalesce(units, 0) AS v FROM (SELECT upper(trim(sku_id)) AS entity, date AS day, units,
  row_number() OVER (PARTITION BY upper(trim(sku_id)), date ORDER BY recorded_at DESC, units DESC NULLS LAST) AS r FROM sales_panel
  WHERE sku_id IS NOT NULL) WHERE r = 1)""" + _ROLL
_CASES = " SELECT entity, strftime(day, '%Y-%m-%d') AS day_text FROM roll WHERE day >= DATE '2024-01-30' AND total_7d * 10 > total_30d * 7 AND total_7d >= "
_KEYS = """SELECT {k}, count(*) AS n_rows, count(play_count) AS n_values, CAST(coalesce(sum(play_count), 0) AS DOUBLE) AS total, min(t) AS first_us, max(t) AS last_us,
  coalesce(max(gap), 0) AS max_gap_us FROM (SELECT {k}, play_count, t, t - lag(t) OVER (PARTITION BY {k} ORDER BY t) AS gap
  FROM (SELECT {k}, play_count, epoch_us(timestamp) AS t FROM interactions)) GROUP BY {k}"""
_HOT = """SELECT '{k}' AS key_kind, {k} AS key_id FROM interactions WHERE {k} IS NOT NULL GROUP BY {k}
  HAVING count(*) * 100 > (SELECT count(*) FROM interactions)"""

ORACLE = {
    "p1_account_totals": _ACC + " SELECT entity, day, total_7d, total_30d, round(total_7d / 7.0 / 100, 4) AS avg_7d, round(total_30d / 30.0 / 100, 4) AS avg_30d FROM roll",
    "p1_sku_totals": _SKU + " SELECT entity, day, total_7d, total_30d, round(total_7d / 7.0, 4) AS avg_7d, round(total_30d / 30.0, 4) AS avg_30d FROM roll",
    "p1_found": f"SELECT * FROM ({_ACC}{_CASES} 200000) UNION SELECT * FROM ({_SKU}{_CASES} 150)",
    "p2_item_stats": _KEYS.format(k="item_id"),
    "p2_user_stats": _KEYS.format(k="user_id"),
    "p2_found": _HOT.format(k="item_id") + " UNION ALL " + _HOT.format(k="user_id"),
}
