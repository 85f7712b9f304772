"""Queries that run the scalar functions of the sources over the tables, and the generators' promises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.plans.txn_queries import R
from tidemark.session import read_table
from tidemark.sources import generators


def holiday_multiplier(spark: SparkSession, d: str) -> DataFrame:
    days = read_table(spark, d, "sales_panel").select("date").where("date is not null").distinct()
    return days.select("date", scalar.fixed(scalar.holiday_lift(F.col("date"), generators.HOLIDAYS)).alias("lift"))


def text_slips(spark: SparkSession, d: str) -> DataFrame:
    """The slip of kind pair_id mod 4 at character 6 of the first question."""
    q = read_table(spark, d, "question_pairs").where("question1 is not null")
    return q.select("pair_id", scalar.corrupt(F.col("question1"), F.pmod("pair_id", F.lit(4)), F.lit(6)).alias("slipped"))


def display_labels(spark: SparkSession, d: str) -> DataFrame:
    kinds = read_table(spark, d, "question_pairs").select("pair_kind").where("pair_kind is not null").distinct()
    return kinds.select("pair_kind", scalar.display_label(F.col("pair_kind"), {"duplicate": "Same question"}).alias("label"))


def generated_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows and keys of one seeded draw of each generator, and whether it keeps its promises."""
    t = generators.transactions(spark, generators.TransactionConfig(3000, 200, 0.05))
    s = generators.sales(spark, generators.SalesConfig(7, 120))
    q = generators.question_pairs(spark, generators.PairConfig(900, 60))
    p, items = generators.interactions(spark, generators.PlayConfig(120, 300, 20))
    yes = lambda c: F.coalesce(F.min(c), F.lit(True))
    parts = [
        t.agg(F.lit("legitimate transactions").alias("source"), F.count_if(F.col("is_fraud") == 0).alias("n_rows"), (F.countDistinct("transaction_id") == F.count("*")).alias("keys_are_unique"), yes(F.col("amount") >= 0).alias("is_valid")),
        s.agg(F.lit("sales").alias("source"), F.count("*").alias("n_rows"), (F.countDistinct("sku_id", "date") == F.count("*")).alias("keys_are_unique"), yes((F.col("units") >= 0) & (F.col("was_in_stock") | (F.col("units") == 0))).alias("is_valid")),
        q.agg(F.lit("pairs").alias("source"), F.count("*").alias("n_rows"), (F.countDistinct("pair_id") == F.count("*")).alias("keys_are_unique"), yes((F.col("is_duplicate") == 1) == (F.col("cluster1") == F.col("cluster2"))).alias("is_valid")),
        items.agg(F.lit("items").alias("source"), F.count("*").alias("n_rows"), (F.countDistinct("item_id") == F.count("*")).alias("keys_are_unique"), (F.abs(F.sum("popularity") - 1) < 1e-9).alias("is_valid")),
        p.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("d")).agg(F.lit("users of plays").alias("source"), F.count("*").alias("n_rows"), yes(F.col("n") == F.col("d")).alias("keys_are_unique"), yes(F.col("n") >= 8).alias("is_valid")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


QUERIES = {f.__name__: f for f in (holiday_multiplier, text_slips, display_labels, generated_tables)}


def _holiday(month: int, day: int, lift: float, lead: int) -> str:
    gap = f"(dayofyear(DATE '2021-{month:02}-{day:02}') - dayofyear(date))"
    ramp = f"greatest(1 + ({lift} - 1.0) * ({lead} + 1 - {gap}) / ({lead} + 1.0), 0.2)"
    return f"(CASE WHEN month(date) = {month} AND day(date) = {day} THEN {lift} ELSE 1.0 END::DOUBLE * CASE WHEN {gap} > 0 AND {gap} <= {lead} THEN {ramp} ELSE 1.0 END::DOUBLE)"


ORACLE = {
    "holiday_multiplier": f"SELECT date, {R.format(' * '.join(_holiday(*h) for h in generators.HOLIDAYS))} AS lift FROM (SELECT DISTINCT date FROM sales_panel WHERE date IS NOT NULL)",
    "text_slips": r"""SELECT pair_id, CASE WHEN k = 0 AND length(t) > 12 THEN substr(t, 1, 5) || substr(t, 7) WHEN k = 1 THEN regexp_replace(t, '^([^ ]*) ', '\1  ')
  WHEN k IN (0, 2) THEN lower(t) ELSE t END AS slipped FROM (SELECT pair_id, question1 AS t, pair_id % 4 AS k FROM question_pairs WHERE question1 IS NOT NULL)""",
    "display_labels": """SELECT pair_kind, CASE WHEN pair_kind = 'duplicate' THEN 'Same question' ELSE
  array_to_string(list_transform(string_split(replace(pair_kind, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS label
  FROM (SELECT DISTINCT pair_kind FROM question_pairs WHERE pair_kind IS NOT NULL)""",
    "generated_tables": """SELECT source, CAST(n AS BIGINT) AS n_rows, true AS keys_are_unique, true AS is_valid
  FROM (VALUES ('legitimate transactions', 3000), ('sales', 840), ('pairs', 900), ('items', 300), ('users of plays', 120)) v(source, n)""",
}
