"""Implicit-feedback recommendation: splits, popularity, item neighbours, masked top-k, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import bin_of
from tidemark.operators.order import exact_quantiles, running_totals
from tidemark.operators.products import item_products
from tidemark.session import Stage, require_columns

MOST_BROADCAST = 2_000_000


def collapse_repeats(plays: DataFrame) -> DataFrame:
    """One row per user and item: last timestamp, sum of play_count."""
    return plays.groupBy("user_id", "item_id").agg(F.max("timestamp").alias("timestamp"), F.sum("play_count").alias("play_count"))


def leave_last_out(collapsed: DataFrame, n_holdout: int = 2, min_train: int = 5) -> DataFrame:
    """Adds split: test for the last ``n_holdout`` rows (time, then item) of users who keep at least ``min_train`` others, else train.

    Only a user's last rows are ranked (Spark keeps ``n_holdout`` per user and task before the shuffle); the sizes are counts.
    """
    if n_holdout < 1:
        raise ValueError("at least one row must be held out")
    last = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("item_id"))
    held = collapsed.select("user_id", "item_id", "timestamp").withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= n_holdout)
    sizes = collapsed.groupBy("user_id").agg(F.count("*").alias("__n")).where(F.col("__n") - n_holdout >= min_train)
    test = held.join(sizes, "user_id", "left_semi").select("user_id", "item_id", F.lit(True).alias("__test"))
    return collapsed.join(test, ["user_id", "item_id"], "left").withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def leaked_pairs(train: DataFrame, test: DataFrame) -> DataFrame:
    """User-item pairs that stand in both."""
    return test.join(train.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi").select("user_id", "item_id").distinct()


def assert_no_leak(train: DataFrame, test: DataFrame) -> None:
    if found := leaked_pairs(train, test).limit(3).collect():
        raise AssertionError(f"pairs in train and test: {[tuple(r) for r in found]}")


def log_summary(plays: DataFrame, items: DataFrame) -> DataFrame:
    """One row: n_rows, n_users, n_items, catalogue, density, median_plays, top1pct_share, never_played."""
    per_item = Stage(plays.groupBy("item_id").agg(F.count("*").alias("n"))).df
    users = Stage(plays.groupBy("user_id").agg(F.count("*").alias("n"))).df
    n_items, catalogue = per_item.count(), items.count()
    top = max(1, -(-catalogue // 100))
    [median] = exact_quantiles(users, F.col("n"), [0.5])
    pairs = plays.select("user_id", "item_id").distinct().count()
    n_users = users.count()
    share = per_item.orderBy(F.desc("n"), "item_id").limit(top).agg(F.sum("n").alias("t"))
    never = items.join(per_item, "item_id", "left_anti").agg(F.count("*").alias("never_played"))
    return per_item.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).join(F.broadcast(share)).join(F.broadcast(never)).select(
        "n_rows", F.lit(n_users).cast("bigint").alias("n_users"), F.lit(n_items).cast("bigint").alias("n_items"), F.lit(catalogue).cast("bigint").alias("catalogue"),
        F.lit(pairs / (n_users * catalogue) if n_users and catalogue else None).cast("double").alias("density"), F.lit(median).cast("double").alias("median_plays"),
        (F.col("t") / F.col("n_rows")).alias("top1pct_share"), "never_played",
    )


def popularity(train: DataFrame) -> DataFrame:
    """Different users of each item."""
    return train.groupBy("item_id").agg(F.countDistinct("user_id").alias("n_users"))


def popularity_rank(train: DataFrame) -> DataFrame:
    """item_id, n_users, place: from 1, most users first, ties to the smaller item."""
    return running_totals(popularity(train), [F.desc("n_users"), F.asc("item_id")], {"place": F.lit(1).cast("bigint")})


def top_k_by_rank(users: DataFrame, ranked: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """The ``k`` first items of one common ranking that a user has not seen: user_id, rank, item_id, score.

    A user's answer lies within the first k + (number of seen items) places, so only these are looked at, not users x items.
    """
    need = users.select("user_id").distinct().join(seen.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left")
    places = need.select("user_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("n", F.lit(0)) + k)).alias("place"))
    placed = seen.select("user_id", "item_id").join(ranked.select("item_id", "place"), "item_id").select("user_id", "place")
    free = places.join(placed, ["user_id", "place"], "left_anti").join(ranked.select("place", "item_id", F.col("n_users").cast("double").alias("score")), "place")
    w = Window.partitionBy("user_id").orderBy("place")
    return free.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("user_id", "rank", "item_id", "score")


def masked_top_k(scores: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """The ``k`` best unseen items of each user from (user_id, item_id, score); ties to the smaller item; fewer if fewer are left."""
    if k < 1:
        raise ValueError("k must be positive")
    fresh = scores.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc("item_id"))
    return fresh.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("user_id", "rank", "item_id", "score")


def random_top_k(users: DataFrame, items: DataFrame, seen: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """A random recommender: the common ranking by hash, started at a place of the user's own."""
    n = items.count()
    ranked = running_totals(items.select("item_id").withColumn("n_users", F.lit(0)), [F.xxhash64("item_id", F.lit(seed)), F.asc("item_id")], {"place": F.lit(1).cast("bigint")})
    need = users.select("user_id").distinct().join(seen.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left")
    steps = need.select("user_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.coalesce("n", F.lit(0)) + k, F.lit(n)) - 1)).alias("step"))
    own = steps.withColumn("place", F.pmod(F.xxhash64("user_id", F.lit(seed)) + F.col("step"), F.lit(n)) + 1)
    picks = own.join(ranked.select("place", "item_id"), "place").join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy("step")
    return picks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("user_id", "rank", "item_id", (-F.col("step")).cast("double").alias("score"))


def item_neighbours(train: DataFrame, k: int = 100, shrink: float = 10.0) -> DataFrame:
    """src, dst, similarity: cosine of raw counts, shrunk; the ``k`` most similar of each src (ties to the smaller dst).

    Similarities are rounded to 12 decimals, scores to 10, so that the order in which a sum was formed decides no tie.
    """
    require_columns(train, "user_id", "item_id", "play_count")
    p = Stage(item_products(train, "user_id", "item_id", "play_count")).df
    norm = p.where("src = dst").select(F.col("src").alias("i"), F.sqrt("product").alias("norm"))
    a, b = norm.select(F.col("i").alias("src"), F.col("norm").alias("na")), norm.select(F.col("i").alias("dst"), F.col("norm").alias("nb"))
    s = p.where("src <> dst and product <> 0").join(a, "src").join(b, "dst").select("src", "dst", F.round(F.col("product") / (F.col("na") * F.col("nb") + shrink + 1e-9), 12).alias("similarity"))
    w = Window.partitionBy("src").orderBy(F.desc("similarity"), F.asc("dst"))
    return s.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def item_knn_scores(train: DataFrame, neighbours: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, item_id, score: sum over the user's items of play_count times similarity to the item."""
    sim = Stage(neighbours).df
    mine = train.join(users.select("user_id").distinct(), "user_id", "left_semi").select("user_id", F.col("item_id").alias("src"), "play_count")
    sim2 = F.broadcast(sim) if sim.count() <= MOST_BROADCAST else sim
    return mine.join(sim2, "src").groupBy("user_id", F.col("dst").alias("item_id")).agg(F.round(F.sum(F.col("play_count") * F.col("similarity")), 10).alias("score"))


def per_user_accuracy(recs: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """user_id, n_truth, recall, hit, ndcg, map for each user with held-out items; users without recommendations get zeros."""
    truth = test.select("user_id", "item_id").distinct()
    n = truth.groupBy("user_id").agg(F.count("*").alias("n_truth"))
    hits = recs.where(F.col("rank") <= k).join(truth, ["user_id", "item_id"], "left_semi").select("user_id", "rank")
    w = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    h = hits.withColumn("c", F.count("*").over(w)).groupBy("user_id").agg(
        F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("c") / F.col("rank")).alias("prec")
    )
    most = F.least("n_truth", F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("bigint"), most), F.lit(0.0), lambda acc, r: acc + 1 / F.log2(r + 1))
    z = lambda c: F.coalesce(c, F.lit(0))
    return n.join(h, "user_id", "left").select(
        "user_id", "n_truth", (z("hits") / F.col("n_truth")).alias("recall"), (z("hits") > 0).cast("double").alias("hit"), (z("dcg") / ideal).alias("ndcg"), (z("prec") / most).alias("map")
    )


def accuracy(recs: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """recall, hit_rate, ndcg, map averaged over the users with held-out items. One row."""
    return per_user_accuracy(recs, test, k).agg(F.avg("recall").alias("recall"), F.avg("hit").alias("hit_rate"), F.avg("ndcg").alias("ndcg"), F.avg("map").alias("map"))


def distribution(recs: DataFrame, train: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """coverage, novelty, gini and popularity_percentile of the first k recommendations. One row. Items never shown count in gini and percentile."""
    top = recs.where(F.col("rank") <= k).select("item_id")
    pop = items.select("item_id").distinct().join(popularity(train), "item_id", "left").withColumn("n_users", F.coalesce("n_users", F.lit(0)))
    shown = pop.join(top.groupBy("item_id").agg(F.count("*").alias("c")), "item_id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    ranked = running_totals(shown, [F.asc("n_users"), F.asc("item_id")], {"by_pop": F.lit(1).cast("bigint")})
    ranked = Stage(running_totals(ranked, [F.asc("c"), F.asc("item_id")], {"by_c": F.lit(1).cast("bigint")})).df
    t = ranked.agg(F.count("*").alias("n"), F.sum("c").alias("slots"), F.sum("n_users").alias("pops"), F.count_if(F.col("c") > 0).alias("distinct"), F.sum(F.col("by_c") * F.col("c")).alias("ic"))
    info = -F.log2(F.greatest(F.col("n_users") / F.col("pops"), F.lit(1e-12)))
    pct = (F.col("by_pop") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    per = ranked.where("c > 0").join(F.broadcast(t.select("n", "pops"))).agg(F.sum(F.col("c") * info).alias("info"), F.sum(F.col("c") * pct).alias("pct"))
    n, slots = F.col("n"), F.col("slots")
    return t.join(F.broadcast(per)).select(
        (F.col("distinct") / n).alias("coverage"), (F.col("info") / slots).alias("novelty"), (2 * F.col("ic") / (n * slots) - (n + 1) / n).alias("gini"),
        (F.col("pct") / slots).alias("popularity_percentile"),
    )


def by_activity(recs: DataFrame, train: DataFrame, test: DataFrame, k: int, buckets: int = 4) -> DataFrame:
    """bucket, n, median_history, recall, ndcg: users with held-out items in quantile buckets of their history; empty buckets have no row."""
    per = per_user_accuracy(recs, test, k)
    hist = train.groupBy("user_id").agg(F.count("*").alias("h"))
    u = Stage(per.join(hist, "user_id", "left").withColumn("h", F.coalesce("h", F.lit(0)))).df
    edges = [e for e in exact_quantiles(u, F.col("h"), [i / buckets for i in range(1, buckets)]) if e is not None]
    b: Column = bin_of(F.col("h").cast("double"), edges)
    return u.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.percentile("h", F.lit(0.5)).alias("median_history"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"))
