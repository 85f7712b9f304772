"""Synthetic sources: the same rows for a seed, whatever the partitioning, because every draw is a hash of the row's id."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import corrupt, holiday_lift
from tidemark.operators.order import running_totals


def uniform(key: Column, salt: int, seed: int) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(key, F.lit(salt), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def pick(values: list, u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def normal(key: Column, salt: int, seed: int) -> Column:
    return F.sqrt(-2 * F.log(uniform(key, salt, seed))) * F.cos(uniform(key, salt + 1, seed) * 6.283185307179586)


@dataclass(frozen=True)
class TransactionConfig:
    n_rows: int = 240_000
    n_accounts: int = 12_000
    fraud_rate: float = 0.0017
    separability: float = 0.62
    days: int = 180
    seed: int = 7

    def __post_init__(self) -> None:
        if self.n_rows < 1 or self.n_accounts < 1 or not 0 <= self.fraud_rate < 1 or not 0 <= self.separability <= 1:
            raise ValueError("sizes must be positive, rates within 0 and 1")


CATEGORIES = ["grocery", "fuel", "restaurant", "travel", "pharmacy", "gift_card", "digital_goods", "electronics"]


def transactions(spark: SparkSession, cfg: TransactionConfig = TransactionConfig()) -> DataFrame:
    """Ordinary rows, and bursts of up to six rows of an account that differ from them by ``separability``."""
    s, i = cfg.seed, F.col("id")
    n_attacks = int(round(cfg.n_rows * cfg.fraud_rate / 3.5))
    span = cfg.days * 86_400
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = lambda sec: F.timestamp_add("SECOND", sec.cast("bigint"), start)
    account = lambda u: F.floor(F.pow(u, 2) * cfg.n_accounts).cast("bigint")
    good = spark.range(cfg.n_rows).select(
        F.floor(uniform(i, 1, s) * span).alias("sec"), account(uniform(i, 2, s)).alias("account_id"), F.round(F.exp(3 + normal(i, 3, s)), 2).alias("amount"),
        pick(CATEGORIES[:6], uniform(i, 5, s)).alias("merchant_category"), (uniform(i, 6, s) < 0.6).alias("card_present"), (uniform(i, 7, s) < 0.04).alias("is_foreign"),
        F.round(-F.log(uniform(i, 8, s)) * 12, 1).alias("distance_from_home_km"), F.lit(0).alias("is_fraud"),
    )
    burst = spark.range(n_attacks).select(i, F.floor(uniform(i, 11, s) * span).alias("t0"), account(uniform(i, 12, s)).alias("account_id"), F.explode(F.sequence(F.lit(0), F.floor(uniform(i, 13, s) * 6).cast("int"))).alias("k"))
    j, far = F.struct("id", "k"), cfg.separability
    bad = burst.select(
        (F.col("t0") + F.col("k") * 240).alias("sec"), "account_id", F.round(F.greatest(F.exp(3 + 1.6 * far + normal(j, 14, s)), F.lit(0.5)), 2).alias("amount"),
        F.when(uniform(j, 16, s) < far, pick(CATEGORIES[5:], uniform(j, 17, s))).otherwise(pick(CATEGORIES[:6], uniform(j, 17, s))).alias("merchant_category"),
        (uniform(j, 18, s) < 0.6 * (1 - far)).alias("card_present"), (uniform(j, 19, s) < 0.04 + 0.5 * far).alias("is_foreign"),
        F.round(-F.log(uniform(j, 20, s)) * (12 + 500 * far), 1).alias("distance_from_home_km"), F.lit(1).alias("is_fraud"),
    )
    rows = good.unionByName(bad)
    # ids in time order: a running number over range partitions
    order = [F.asc("sec"), F.asc("account_id"), F.asc("amount"), F.asc("distance_from_home_km"), F.asc("is_fraud")]
    numbered = running_totals(rows, order, {"transaction_id": F.lit(1).cast("bigint")})
    age = (F.floor(uniform(F.col("account_id"), 30, s) * 3000) + F.floor(F.col("sec") / 86_400)).cast("int")
    return numbered.select(
        (F.col("transaction_id") - 1).alias("transaction_id"), at(F.col("sec")).alias("timestamp"), "account_id", "amount", "merchant_category", "card_present", "is_foreign",
        "distance_from_home_km", age.alias("account_age_days"), "is_fraud",
    )


@dataclass(frozen=True)
class SalesConfig:
    n_skus: int = 60
    days: int = 1095
    start: dt.date = dt.date(2021, 1, 1)
    log_mean: float = 2.6
    log_sd: float = 0.9
    elasticity: float = -1.8
    promo_rate: float = 0.12
    stockout_rate: float = 0.012
    dispersion: float = 6.0
    growth_sd: float = 0.25
    seed: int = 19

    def __post_init__(self) -> None:
        if self.n_skus < 1 or self.days < 1 or self.elasticity >= 0 or not 0 <= self.promo_rate < 1 or self.dispersion <= 0:
            raise ValueError("sizes and dispersion must be positive, the elasticity negative, the promotion rate within 0 and 1")


# Month, day, lift and lead of the holidays; lift of each day of the week, from Monday, of each category.
HOLIDAYS = [(1, 1, 0.55, 0), (7, 4, 1.35, 3), (11, 28, 1.80, 5), (12, 24, 1.95, 10), (12, 25, 0.30, 0)]
WEEK = {
    "beverages": [0.92, 0.88, 0.90, 0.98, 1.15, 1.32, 1.08],
    "snacks": [0.90, 0.86, 0.89, 0.97, 1.18, 1.35, 1.10],
    "household": [0.85, 0.82, 0.86, 0.94, 1.12, 1.45, 1.20],
    "personal_care": [0.95, 0.93, 0.95, 1.00, 1.08, 1.18, 0.98],
    "frozen": [0.97, 0.95, 0.97, 1.01, 1.06, 1.12, 1.00],
}


def negative_binomial(key: Column, mean: Column, dispersion: float, seed: int) -> Column:
    """Counts with the given mean and dispersion: a Poisson draw about a gamma draw, both seeded by ``key``."""

    @F.pandas_udf("int")
    def draw(keys: pd.Series, means: pd.Series) -> pd.Series:
        out = np.empty(len(keys), np.int64)
        for k, (key, m) in enumerate(zip(keys, means, strict=True)):
            rng = np.random.Generator(np.random.Philox(key=[key & 0xFFFFFFFFFFFFFFFF, seed]))
            out[k] = rng.poisson(rng.gamma(dispersion, m / dispersion))
        return pd.Series(out)

    return draw(F.xxhash64(key, F.lit(seed)), mean)


def sales(spark: SparkSession, cfg: SalesConfig = SalesConfig()) -> DataFrame:
    """A gap-free panel: level, trend and yearly season of each SKU, the category's week, whole weeks of promotion whose price
    cut works through the elasticity, holidays with a lead, negative-binomial counts, and stock-outs, which sell 0."""
    s, k = cfg.seed, F.col("id")
    sku = spark.range(cfg.n_skus).select(
        F.format_string("SKU-%03d", "id").alias("sku_id"), k.alias("k"), pick(list(WEEK), uniform(k, 1, s)).alias("category"),
        F.exp(cfg.log_mean + cfg.log_sd * normal(k, 2, s)).alias("level"), F.round(F.exp(1.6 + 0.5 * normal(k, 4, s)), 2).alias("base_price"),
        (0.03 + cfg.growth_sd * normal(k, 6, s)).alias("growth"), (0.05 + 0.3 * uniform(k, 8, s)).alias("amp"), (2 * math.pi * uniform(k, 9, s)).alias("phase"),
    )
    last = cfg.start + dt.timedelta(days=cfg.days - 1)
    g = sku.withColumn("date", F.explode(F.sequence(F.lit(cfg.start), F.lit(last)))).withColumn("n", F.datediff("date", F.lit(cfg.start)))
    key = F.struct("k", "n")
    promo = uniform(F.struct(F.col("k"), F.floor(F.col("n") / 7)), 10, s) < cfg.promo_rate
    cut = F.when(promo, 0.10 + 0.25 * uniform(key, 11, s)).otherwise(0.0)
    price = F.round(F.col("base_price") * (1 - cut), 2)
    week = F.element_at(F.element_at(F.create_map(*(x for c, v in WEEK.items() for x in (F.lit(c), F.array(*map(F.lit, v))))), F.col("category")), F.weekday("date") + 1)
    lift = holiday_lift(F.col("date"), HOLIDAYS)
    yearly = 1 + F.col("amp") * F.sin(F.dayofyear("date") * (2 * math.pi / 365.25) + F.col("phase"))
    trend = F.exp(F.col("growth") * F.col("n") / 365.25)
    mean = F.col("level") * trend * week * yearly * F.pow(price / F.col("base_price"), F.lit(cfg.elasticity)) * F.when(promo, 1.25).otherwise(1.0) * lift
    stock = uniform(key, 12, s) > cfg.stockout_rate
    out = g.withColumns({"price": price, "on_promo": promo, "is_holiday": lift != 1.0, "was_in_stock": stock, "mean": F.greatest(mean, F.lit(0.05))})
    units = F.when(F.col("was_in_stock"), negative_binomial(key, F.col("mean"), cfg.dispersion, s)).otherwise(0)
    return out.select("date", "sku_id", "category", "price", "base_price", "on_promo", "is_holiday", "was_in_stock", units.alias("units"))


@dataclass(frozen=True)
class PairConfig:
    n_pairs: int = 40_000
    n_intents: int = 900
    duplicate_rate: float = 0.37
    hard_share: float = 0.6
    typo_rate: float = 0.06
    seed: int = 29

    def __post_init__(self) -> None:
        if self.n_pairs < 1 or self.n_intents < 3 or not 0 < self.duplicate_rate < 1 or not 0 <= self.hard_share <= 1:
            raise ValueError("sizes must be positive, rates within 0 and 1")


_OPEN = ["How do I", "What is the way to", "Can I", "Please tell me how to", "Does anyone know how to"]
_VERB = ["install", "repair", "clean", "configure", "replace", "store", "paint", "test", "share", "update"]
_THING = ["a bicycle chain", "a water pump", "a wool coat", "a printer", "a garden fence", "a laptop fan", "a camera lens", "a coffee mill", "a kayak", "a door lock"]
_WHERE = ["at home", "on a boat", "in winter", "without tools", "for a friend", "in the garden", "on a budget", "in an hour", "at night", "for a school"]


def question_pairs(spark: SparkSession, cfg: PairConfig = PairConfig()) -> DataFrame:
    """Pairs of phrasings of intents: the same intent, one that differs in one of three slots, or any other."""
    s, i = cfg.seed, F.col("id")
    a = F.floor(uniform(i, 1, s) * cfg.n_intents).cast("bigint")
    dup, hard = uniform(i, 2, s) < cfg.duplicate_rate, uniform(i, 3, s) < cfg.hard_share
    kind = F.when(dup, "duplicate").when(hard, "hard_negative").otherwise("random_negative")
    step = F.when(hard, F.lit(100)).otherwise(1 + F.floor(uniform(i, 4, s) * (cfg.n_intents - 1)))
    b = F.when(dup, a).otherwise(F.pmod(a + step, F.lit(cfg.n_intents))).cast("bigint")
    rows = spark.range(cfg.n_pairs).select(i.alias("pair_id"), a.alias("cluster1"), b.alias("cluster2"), kind.alias("pair_kind"), uniform(i, 5, s).alias("u"), i)

    def phrase(c: Column, shift: int, salt: int) -> Column:
        slot = lambda values, div: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.floor(c / div), F.lit(len(values))) + 1).cast("int"))
        opener = F.element_at(F.array(*map(F.lit, _OPEN)), (F.pmod(F.floor(F.col("u") * len(_OPEN)) + shift, F.lit(len(_OPEN))) + 1).cast("int"))
        text = F.concat_ws(" ", opener, slot(_VERB, 1), slot(_THING, 10), F.concat(slot(_WHERE, 100), F.lit("?")))
        slip = F.when(uniform(i, salt, s) < cfg.typo_rate, F.floor(uniform(i, salt + 20, s) * 3).cast("int")).otherwise(3)
        return corrupt(text, slip, (6 + F.floor(uniform(i, salt + 1, s) * (F.length(text) - 7))).cast("int"))

    return rows.select(
        "pair_id", phrase(F.col("cluster1"), 0, 6).alias("question1"), phrase(F.col("cluster2"), 1, 8).alias("question2"),
        (F.col("cluster1") == F.col("cluster2")).cast("int").alias("is_duplicate"), "cluster1", "cluster2", "pair_kind",
    )


# The genres.
GENRES = ["indie_rock", "hip_hop", "jazz", "electronic", "classical", "metal", "folk", "rnb", "ambient", "punk", "latin", "country"]
#: Items that a user's draw can choose from; the catalogue goes to every task.
MOST_ITEMS = 1_000_000


@dataclass(frozen=True)
class PlayConfig:
    n_users: int = 4000
    n_items: int = 2000
    mean_plays: float = 55
    min_plays: int = 8
    popularity_alpha: float = 1.1
    exposure: float = 0.5
    taste_concentration: float = 0.35
    taste_sharpness: float = 5.0
    days: int = 180
    seed: int = 43

    def __post_init__(self) -> None:
        if min(self.n_users, self.mean_plays, self.days) <= 0 or not 0 < self.n_items <= MOST_ITEMS or self.min_plays < 3:
            raise ValueError(f"sizes must be positive, with 3 plays a user or more and at most {MOST_ITEMS} items")
        if not 0 <= self.exposure <= 1 or self.taste_sharpness <= 0 or self.taste_concentration <= 0:
            raise ValueError("exposure must lie within 0 and 1, taste must be positive")


def weighted_sample(rng: np.random.Generator, weight: np.ndarray, n: int) -> np.ndarray:
    """``n`` different places (all, if there are no more) as if drawn one after the other with chances in proportion to their
    weights: the first of exponential waiting times with the weights as rates, which is Gumbel top-k on the logarithms."""
    return np.argsort(rng.exponential(size=len(weight)) / weight)[:n]


def interactions(spark: SparkSession, cfg: PlayConfig = PlayConfig()) -> tuple[DataFrame, DataFrame]:
    """(plays, items). Each user draws different items by weight: taste for the item's genres against its popularity.

    Users are drawn in the tasks, a block of users against the whole catalogue, which is bounded (``MOST_ITEMS``); only
    what is drawn becomes a row. The draws of a user and an item depend on the seed and the id alone.
    """
    f = len(GENRES)
    genres = np.stack([np.random.default_rng([cfg.seed, 1, k]).dirichlet(np.full(f, 0.3)) for k in range(cfg.n_items)])
    weight = np.arange(1, cfg.n_items + 1, dtype=float) ** -cfg.popularity_alpha
    popularity = np.random.default_rng([cfg.seed, 2]).permutation(weight) / weight.sum()
    table = pd.DataFrame({"item_id": np.arange(cfg.n_items), "primary_genre": [GENRES[k] for k in genres.argmax(1)], "popularity": popularity})
    items = spark.createDataFrame(table, "item_id bigint, primary_genre string, popularity double")
    exposed = popularity**cfg.exposure

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for user in pdf["id"]:
                rng = np.random.default_rng([cfg.seed, 3, user])
                taste = rng.dirichlet(np.full(f, cfg.taste_concentration))
                n = int(np.clip(rng.poisson(rng.gamma(2.0, cfg.mean_plays / 2)), cfg.min_plays, max(cfg.n_items // 2, 1)))
                chosen = weighted_sample(rng, (genres @ taste + 1e-9) ** ((1 - cfg.exposure) * cfg.taste_sharpness) * exposed, n)
                out.append(pd.DataFrame({"user_id": user, "item_id": chosen, "sec": rng.integers(0, cfg.days * 86_400, len(chosen)), "play_count": rng.geometric(0.55, len(chosen))}))
            if out:
                yield pd.concat(out)

    drawn = spark.range(cfg.n_users).mapInPandas(draw, "user_id bigint, item_id bigint, sec bigint, play_count int")
    at = F.timestamp_add("SECOND", F.col("sec"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return drawn.select("user_id", "item_id", at.alias("timestamp"), "play_count"), items
