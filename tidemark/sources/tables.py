"""The logical tables of the analytics, cleaned from the test tables. Each cleaning rule is stated here once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import read_table


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """One row per transaction (copies once); no account: left out; amount and distance null: 0; category null: unknown, in lower case."""
    return (
        read_table(spark, d, "transactions")
        .where("account_id is not null")
        .select(
            "transaction_id", "timestamp", "account_id", F.coalesce("amount", F.lit(0.0)).alias("amount"),
            F.coalesce(F.lower(F.trim("merchant_category")), F.lit("unknown")).alias("merchant_category"), "card_present", "is_foreign",
            F.coalesce("distance_from_home_km", F.lit(0.0)).alias("distance_from_home_km"), "account_age_days", F.col("is_fraud").cast("int").alias("is_fraud"),
        )
        .distinct()
    )


TRANSACTIONS_SQL = """txn AS (SELECT DISTINCT transaction_id, timestamp, account_id, coalesce(amount, 0.0) AS amount,
  coalesce(lower(trim(merchant_category)), 'unknown') AS merchant_category, card_present, is_foreign,
  coalesce(distance_from_home_km, 0.0) AS distance_from_home_km, account_age_days, CAST(is_fraud AS INTEGER) AS is_fraud
  FROM transactions WHERE account_id IS NOT NULL)"""


def sales(spark: SparkSession, d: str) -> DataFrame:
    """One row per SKU and date, the one recorded last (ties: the larger units, then price); SKU trimmed and upper-cased; units null: 0."""
    rec = F.struct("recorded_at", "units", "price", "category", "base_price", "on_promo", "is_holiday", "was_in_stock")
    r = (
        read_table(spark, d, "sales_panel")
        .where("sku_id is not null and date is not null")
        .groupBy(F.upper(F.trim("sku_id")).alias("sku_id"), "date").agg(F.max(rec).alias("r"))
    )
    return r.select(
        "sku_id", "date", "r.category", "r.price", "r.base_price", "r.on_promo", "r.is_holiday", "r.was_in_stock", F.coalesce("r.units", F.lit(0)).alias("units")
    )


SALES_SQL = """sales AS (SELECT * EXCLUDE (rk, units), coalesce(units, 0) AS units FROM (SELECT upper(trim(sku_id)) AS sku_id, date, category, price, base_price, on_promo,
  is_holiday, was_in_stock, units, row_number() OVER (PARTITION BY upper(trim(sku_id)), date ORDER BY recorded_at DESC, units DESC NULLS LAST,
  price DESC NULLS LAST, category DESC NULLS LAST, base_price DESC NULLS LAST, on_promo DESC, is_holiday DESC, was_in_stock DESC) AS rk
  FROM sales_panel WHERE sku_id IS NOT NULL AND date IS NOT NULL) WHERE rk = 1)"""


def plays(spark: SparkSession, d: str) -> DataFrame:
    """Plays with user and item; rows equal in user, item, time and count are one; count null: 0."""
    return (
        read_table(spark, d, "interactions")
        .where("user_id is not null and item_id is not null")
        .select("user_id", "item_id", "timestamp", "play_count").distinct()
        .withColumn("play_count", F.coalesce("play_count", F.lit(0)))
    )


PLAYS_SQL = """plays AS (SELECT user_id, item_id, timestamp, coalesce(play_count, 0) AS play_count FROM (SELECT DISTINCT user_id, item_id, timestamp, play_count
  FROM interactions WHERE user_id IS NOT NULL AND item_id IS NOT NULL))"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Labelled question pairs with both texts; split trimmed and lower-cased."""
    return (
        read_table(spark, d, "question_pairs")
        .where("is_duplicate is not null and question1 is not null and question2 is not null")
        .withColumn("split", F.lower(F.trim("split")))
    )


PAIRS_SQL = """pairs AS (SELECT * EXCLUDE (split), lower(trim(split)) AS split FROM question_pairs WHERE is_duplicate IS NOT NULL AND question1 IS NOT NULL
  AND question2 IS NOT NULL)"""
