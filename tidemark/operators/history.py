"""Causal features of an event log: what was known about an entity before each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import cyclic
from tidemark.operators.order import exact_quantiles
from tidemark.session import Stage, micros, require_columns

#: Minutes that stand for "no earlier event", night hours, the names of the features in their order.
NO_PRIOR_MINUTES = 525_600.0
NIGHT_HOURS = (23, 0, 1, 2, 3, 4)
_HOUR_US, _DAY_US = 3_600_000_000, 86_400_000_000
NUMERIC = [
    "log_amount", "amount_to_account_mean", "amount_zscore_account", "distance_from_home_km", "log_account_age_days", "hour", "hour_sin", "hour_cos",
    "day_of_week", "prior_txn_count", "txn_count_1h", "txn_count_24h", "amount_sum_24h", "minutes_since_prev_txn",
]
BINARY = ["card_present", "is_foreign", "is_night", "is_weekend", "has_account_history", "is_new_category_for_account"]
FEATURES = [*NUMERIC, *BINARY, "merchant_category"]


def with_history(df: DataFrame, entity: str, ts: str, id: str, value: str, category: str) -> DataFrame:
    """Adds prior_count, prior_mean, prior_std, minutes_since_prev, count_1h, count_24h, sum_24h and is_first_in_category.

    Prior statistics go by row position in (time, id): an earlier row of the same instant counts. The windows go by time:
    [t - w, t), so rows of the same instant don't.

    An entity's rows are cut by day, so an entity with a large share of all rows is spread over many tasks: within a day the
    statistics run over the day's rows (with the rows of the day before as context for the windows), and the days before
    are added from one row of totals per entity and day. Sums are taken about a constant, which keeps the variance exact
    enough for large values.

    Defined cases: a null entity is an entity; a null value counts as a row and not in mean, std and sum; a null time has
    null history and is no one's history; ids must be unique. Empty input: no rows. Other columns are kept.
    """
    require_columns(df, entity, ts, id, value, category)
    e, i, v, t, day = "__e", "__i", "__v", "__t", "__day"
    rows = df.withColumns({e: F.col(entity), i: F.col(id), v: F.col(value).cast("double"), t: micros(ts)})
    rows = Stage(rows.withColumn(day, F.floor(F.col(t) / _DAY_US))).df  # read four times below, by few columns
    about = 50.0
    c = F.col(v) - about
    daily = rows.where(f"{t} is not null").groupBy(e, day).agg(
        F.count("*").alias("__n"), F.count(v).alias("__m"), F.sum(c).alias("__s"), F.sum(c * c).alias("__q"), F.max(t).alias("__last")
    )
    before = Window.partitionBy(e).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    totals = daily.select(e, day, *(F.sum(x).over(before).alias(f"{x}0") for x in ("__n", "__m", "__s", "__q")), F.max("__last").over(before).alias("__last0"))
    there = daily.select(F.col(e).alias("__e2"), F.col(day).alias("__day2"))
    context = (
        rows.where(f"{t} is not null").select(e, i, v, t, (F.col(day) + 1).alias(day))
        .join(there, F.col(e).eqNullSafe(F.col("__e2")) & (F.col(day) == F.col("__day2")), "left_semi").withColumn("__own", F.lit(False))
    )
    both = rows.withColumn("__own", F.lit(True)).unionByName(context, allowMissingColumns=True)
    part = Window.partitionBy(e, day)
    run = part.orderBy(t, i).rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("__own")
    mine = lambda x: F.when(own, x)
    hours = lambda w: part.orderBy(t).rangeBetween(-w, -1)
    inner = both.withColumns(
        {
            "__n1": F.count(mine(F.col(t))).over(run), "__m1": F.count(mine(F.col(v))).over(run), "__s1": F.sum(mine(c)).over(run), "__q1": F.sum(mine(c * c)).over(run),
            "__last1": F.max(mine(F.col(t))).over(run), "count_1h": F.count(t).over(hours(_HOUR_US)), "count_24h": F.count(t).over(hours(_DAY_US)),
            "sum_24h": F.coalesce(F.sum(v).over(hours(_DAY_US)), F.lit(0.0)),
        }
    ).where(own)
    t2 = totals.withColumnsRenamed({e: "__e2", day: "__day2"})
    joined = inner.join(t2, F.col(e).eqNullSafe(F.col("__e2")) & (F.col(day) == F.col("__day2")), "left")
    both_of = lambda x: F.coalesce(F.col(f"__{x}0"), F.lit(0)) + F.coalesce(F.col(f"__{x}1"), F.lit(0))
    n, m, s, q = both_of("n"), both_of("m"), both_of("s"), both_of("q")
    last = F.coalesce("__last1", "__last0")
    timed = F.col(t).isNotNull()
    first = rows.where(f"{t} is not null").groupBy(F.col(e).alias("__e3"), F.col(category).alias("__c3")).agg(F.min(F.struct(t, i)).alias("__first"))
    out = joined.withColumns(
        {
            "prior_count": F.when(timed, n), "prior_mean": F.when(timed & (m > 0), s / m + about),
            "prior_std": F.when(timed & (m > 1), F.sqrt(F.greatest((q - s * s / m) / (m - 1), F.lit(0.0)))), "minutes_since_prev": (F.col(t) - last) / 60_000_000.0,
            "count_1h": F.when(timed, F.col("count_1h")), "count_24h": F.when(timed, F.col("count_24h")), "sum_24h": F.when(timed, F.col("sum_24h")),
        }
    )
    out = out.join(first, F.col(e).eqNullSafe(F.col("__e3")) & F.col(category).eqNullSafe(F.col("__c3")), "left")
    out = out.withColumn("is_first_in_category", F.col("__first").eqNullSafe(F.struct(F.col(t), F.col(i))))
    return out.drop(*(x for x in out.columns if x.startswith("__")))


def build_features(df: DataFrame) -> DataFrame:
    """transaction_id and the 21 features of each transaction (``FEATURES``, in this order), from strictly earlier rows."""
    require_columns(df, "transaction_id", "timestamp", "account_id", "amount", "merchant_category", "card_present", "is_foreign", "distance_from_home_km", "account_age_days")
    h = with_history(df, "account_id", "timestamp", "transaction_id", "amount", "merchant_category")
    hour, dow = F.hour("timestamp"), F.weekday("timestamp")
    sin, cos = cyclic(hour, 24)
    mean, std, amount = F.col("prior_mean"), F.col("prior_std"), F.col("amount")
    whole: dict[str, Column] = {
        "log_amount": F.log1p("amount"),
        "amount_to_account_mean": F.when(mean > 0, amount / mean).otherwise(1.0),
        "amount_zscore_account": F.when(std > 1e-6, (amount - mean) / std).otherwise(0.0),
        "distance_from_home_km": F.col("distance_from_home_km"),
        "log_account_age_days": F.log1p("account_age_days"),
        "hour": hour, "hour_sin": sin, "hour_cos": cos, "day_of_week": dow,
        "prior_txn_count": F.col("prior_count"), "txn_count_1h": F.col("count_1h"), "txn_count_24h": F.col("count_24h"), "amount_sum_24h": F.col("sum_24h"),
        "minutes_since_prev_txn": F.coalesce("minutes_since_prev", F.lit(NO_PRIOR_MINUTES)),
        "card_present": F.col("card_present").cast("int"), "is_foreign": F.col("is_foreign").cast("int"),
        "is_night": hour.isin(*NIGHT_HOURS).cast("int"), "is_weekend": (dow >= 5).cast("int"),
        "has_account_history": (F.col("prior_count") > 0).cast("int"), "is_new_category_for_account": F.col("is_first_in_category").cast("int"),
        "merchant_category": F.col("merchant_category"),
    }
    return h.select("transaction_id", *(whole[n].alias(n) for n in FEATURES))


def temporal_split(df: DataFrame, ts: str, first: float = 0.6, second: float = 0.8) -> DataFrame:
    """Adds split: train up to the ``first`` quantile of time, valid up to the ``second``, test after (linear quantiles)."""
    require_columns(df, ts)
    t = micros(ts)
    q1, q2 = exact_quantiles(df, t, [first, second])
    if q1 is None:
        return df.withColumn("split", F.lit(None).cast("string"))
    return df.withColumn("split", F.when(t <= q1, "train").when(t <= q2, "valid").when(t.isNotNull(), "test"))
