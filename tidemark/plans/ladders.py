"""The model ladders: registries of models, and the comparison of each ladder on its task, with thresholds from validation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import fixed
from tidemark.operators import als, decision, demand, history, metrics, models, recommend, textpairs
from tidemark.plans import pair_queries, rec_queries
from tidemark.plans.demand_queries import HORIZON
from tidemark.plans.txn_queries import _S, R, rounded, rule_column
from tidemark.session import Stage
from tidemark.sources.tables import pairs, transactions

FRAUD = {
    "rules": lambda: models.Expression(rule_column(), *history.FEATURES),
    "logistic": lambda: models.Model(models.logistic(0.5), history.NUMERIC + history.BINARY, ["merchant_category"], balanced=True),
    "boosted": lambda: models.Model(models.boosted_classifier(), history.NUMERIC + history.BINARY, ["merchant_category"]),
    "boosted_weighted": lambda: models.Model(models.boosted_classifier(), history.NUMERIC + history.BINARY, ["merchant_category"], balanced=True),
}
#: A demand model reads a feature column, or is fitted anew in every fold.
DEMAND = {**demand.baseline_columns(HORIZON), "tweedie": models.tweedie, "gbt": models.boosted_regressor}
PAIRS = {
    "cosine": lambda: models.Expression("tfidf_word_cosine"),
    "logistic": lambda: models.Model(models.logistic(1.0), textpairs.FEATURES),
    "boosted": lambda: models.Model(models.boosted_classifier(), textpairs.FEATURES),
    "boosted_encoded": lambda: models.Model(models.boosted_classifier(), textpairs.FEATURES + textpairs.ENCODED),
}
#: A recommender gives the k best unseen items of each test user from (train, test users, catalogue, k).
RECOMMENDERS = {
    "random": lambda train, users, items, k: recommend.random_top_k(users, items, train, k),
    "popularity": lambda train, users, items, k: recommend.top_k_by_rank(users, recommend.popularity_rank(train), train, k),
    "item_knn": lambda train, users, items, k: recommend.masked_top_k(recommend.item_knn_scores(train, recommend.item_neighbours(train), users), train, k),
    "als": lambda train, users, items, k: _als(train, users, k),
}
ALERT_CAP, BUDGET, K = 0.01, 50, rec_queries.K


def _als(train: DataFrame, users: DataFrame, k: int) -> DataFrame:
    x, y = als.fit_als(train)
    return als.als_top_k(x.join(users.select(F.col("user_id").alias("id")).distinct(), "id", "left_semi"), y, train, k)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fraud_rows(spark: SparkSession, d: str) -> DataFrame:
    """Features, label, raw amount and temporal split of each transaction, written once."""
    t = transactions(spark, d)
    labelled = t.select("transaction_id", "timestamp", F.col("amount").alias("raw_amount"), F.col("is_fraud").alias("label"))
    return Stage(history.temporal_split(history.build_features(t).join(labelled, "transaction_id"), "timestamp")).df


def frozen_point(scores: DataFrame, cap: float = ALERT_CAP) -> DataFrame:
    """The cheapest threshold of the validation rows within the alert cap, frozen, and what it does on the test rows. One row.

    ``scores``: transaction_id, split (valid, test), label, raw_amount, score. Where no alert is cheapest, nothing is alerted.
    """
    valid = decision.cost_curve(scores.where("split = 'valid'"), "transaction_id", "label", "score", "raw_amount")
    threshold = decision.cheapest_threshold(valid, cap).select(F.coalesce("threshold", F.lit(float("inf")))).first()[0]
    point = decision.operating_point(scores.where("split = 'test'"), "label", "score", "raw_amount", threshold)
    return point.withColumn("threshold", F.lit(threshold))


def _fraud_scores(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    rows = fraud_rows(spark, d)
    rest = rows.where("split <> 'train'")
    train = rows.where("split = 'train'")
    return {name: Stage(make().fit(train).score(rest, ["transaction_id", "split", "label", "raw_amount"])).df for name, make in FRAUD.items()}


def fraud_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Each model's test metrics at the threshold of its validation rows; best by average precision."""
    parts = []
    for name, scores in _fraud_scores(spark, d).items():
        test = scores.where("split = 'test'")
        rank = metrics.ranking_metrics(test, "label", "score").select("average_precision", "roc_auc", "brier")
        budget = decision.precision_at_budget(test, "transaction_id", "label", "score", BUDGET).select(F.col("precision").alias("budget_precision"), F.col("recall").alias("budget_recall"))
        point = frozen_point(scores).select("threshold", "alerts", "tp", "fp", "fn", "precision", "recall", "total_cost", "savings", "savings_rate")
        parts.append(point.join(F.broadcast(rank)).join(F.broadcast(budget)).select(F.lit(name).alias("model"), "*"))
    return models.mark_best(_union(parts), "average_precision", "model", list(FRAUD)).orderBy(F.desc("average_precision"), "model")


def fraud_ladder_check(spark: SparkSession, d: str) -> DataFrame:
    """Of each model of the ladder: rows and frauds scored on the test days, scores within 0 and 1, better than chance (where there are 20 frauds)."""
    parts = []
    for name, scores in _fraud_scores(spark, d).items():
        test = scores.where("split = 'test'")
        counts = test.agg(F.count("*").alias("n_test"), F.sum("label").alias("n_pos"), F.count_if(F.col("score").between(0, 1)).alias("inside"))
        auc = metrics.ranking_metrics(test, "label", "score").select("roc_auc")
        good = (F.col("n_pos") < 20) | (F.col("roc_auc") > 0.5)
        parts.append(counts.join(F.broadcast(auc)).select(F.lit(name).alias("model"), "n_test", "n_pos", (F.col("inside") == F.col("n_test")).alias("in_unit"), good.alias("beats_chance")))
    return _union(parts)


def rules_frozen_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The rule score's threshold chosen on the validation days, and its point on the test days."""
    rows = fraud_rows(spark, d).where("split <> 'train'")
    scores = FRAUD["rules"]().fit(rows).score(rows, ["transaction_id", "split", "label", "raw_amount"])
    point = frozen_point(Stage(scores).df)
    return rounded(point.select("threshold", "alerts", "tp", "fp", "fn", "recovered", "missed", "total_cost", "savings"))


def _protocols(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Labelled pairs with part: fit, valid (a fifth of train) or test, under a split by pair and one by cluster."""
    part = F.when(F.col("part") == "test", "test").when(F.pmod(F.col("pair_id") * 31, F.lit(100)) < 20, "valid").otherwise("fit")
    return {
        name: Stage(s.where("part is not null").withColumn("part", part)).df
        for name, s in (("random", pair_queries.split_by_pair(spark, d)), ("disjoint", pair_queries.split_by_cluster(spark, d)))
    }


def _pair_scores(rows: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    fit = rows.where("part = 'fit'")
    encoder = textpairs.TargetEncoder().fit(fit)
    feats = textpairs.PairFeaturizer().fit(fit).transform(rows).join(encoder.transform(rows), "pair_id")
    whole = Stage(feats.join(rows.select("pair_id", "part", "pair_kind", F.col("is_duplicate").alias("label")), "pair_id")).df
    train, rest = whole.where("part = 'fit'"), whole.where("part <> 'fit'")
    scores = {name: Stage(make().fit(train).score(rest, ["pair_id", "part", "pair_kind", "label"])).df for name, make in PAIRS.items()}
    return scores, encoder.unseen_share(rows.where("part = 'test'"))


def pair_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Each model under both splits: metrics on the test pairs at the threshold of best F1 on the validation pairs, and the ROC
    area against each kind of negatives; best by ROC area within each split."""
    out = []
    for protocol, rows in _protocols(spark, d).items():
        scores, unseen = _pair_scores(rows)
        parts = []
        for name, s in scores.items():
            best = metrics.best_f1_threshold(s.where("part = 'valid'"), "label", "score").first()
            threshold, test = best.threshold if best else 0.5, s.where("part = 'test'")
            rank = metrics.ranking_metrics(test, "label", "score").select("n", "roc_auc", "average_precision", "log_loss")
            kinds = metrics.by_negative_kind(test, "label", "score", "pair_kind", pair_queries.KINDS)
            kinds = kinds.agg(*(F.max(F.when(F.col("kind") == k, F.col("roc_auc"))).alias(f"roc_auc_{k}") for k in pair_queries.KINDS))
            point = metrics.threshold_metrics(test, "label", "score", threshold).select("accuracy", "f1", "majority_floor")
            parts.append(rank.join(F.broadcast(point)).join(F.broadcast(kinds)).join(F.broadcast(unseen)).select(F.lit(name).alias("model"), F.lit(threshold).alias("threshold"), "*"))
        out.append(models.mark_best(_union(parts), "roc_auc", "model", list(PAIRS)).withColumn("protocol", F.lit(protocol)))
    return _union(out).orderBy("protocol", F.desc("roc_auc"), "model")


def pair_ladder_check(spark: SparkSession, d: str) -> DataFrame:
    """Of each model under both splits: pairs scored on validation and test, and whether all scores lie within 0 and 1."""
    parts = []
    for protocol, rows in _protocols(spark, d).items():
        for name, s in _pair_scores(rows)[0].items():
            t = s.agg(F.count_if(F.col("part") == "valid").alias("n_valid"), F.count_if(F.col("part") == "test").alias("n_test"), F.count_if(~F.col("score").between(0, 1)).alias("out"))
            parts.append(t.select(F.lit(protocol).alias("protocol"), F.lit(name).alias("model"), "n_valid", "n_test", (F.col("out") == 0).alias("in_unit")))
    return _union(parts)


def _recommended(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, DataFrame]:
    train, test, items = rec_queries.split(spark, d)
    return {name: Stage(make(train, test, items, K)).df for name, make in RECOMMENDERS.items()}, train, test, items


def rec_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and distribution of each recommender's lists; best by recall."""
    recs, train, test, items = _recommended(spark, d)
    parts = [
        recommend.accuracy(r, test, K).join(F.broadcast(recommend.distribution(r, train, items, K))).select(F.lit(name).alias("model"), "*")
        for name, r in recs.items()
    ]
    return models.mark_best(_union(parts), "recall", "model", list(RECOMMENDERS)).orderBy(F.desc("recall"), "model")


def rec_ladder_by_activity(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of each recommender by how much the users have played."""
    recs, train, test, _ = _recommended(spark, d)
    return _union([recommend.by_activity(r, train, test, K).select(F.lit(name).alias("model"), "*") for name, r in recs.items()])


def rec_ladder_check(spark: SparkSession, d: str) -> DataFrame:
    """Of each recommender's lists: users, seen items, repeated items, wrong ranks, and whether everyone got k items (item
    neighbours may know fewer)."""
    recs, train, test, items = _recommended(spark, d)
    n_users = test.select("user_id").distinct().count()
    parts = []
    for name, r in recs.items():
        seen = r.join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").agg(F.count("*").alias("n_seen"))
        per = r.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("d"), F.max("rank").alias("top"), F.sum("rank").alias("ranks"))
        wrong = F.count_if((F.col("top") != F.col("n")) | (F.col("ranks") * 2 != F.col("n") * (F.col("n") + 1)))
        t = per.agg(F.coalesce(F.sum(F.col("n") - F.col("d")), F.lit(0)).alias("n_repeated"), wrong.alias("n_wrong_ranks"), F.count("*").alias("users"), F.coalesce(F.min("n"), F.lit(K)).alias("fewest"))
        full = F.lit(True) if name == "item_knn" else (F.col("fewest") == K) & (F.col("users") == n_users)
        parts.append(t.join(F.broadcast(seen)).select(F.lit(name).alias("model"), F.lit(n_users).cast("bigint").alias("n_users"), "n_seen", "n_repeated", "n_wrong_ranks", full.alias("is_full")))
    return _union(parts)


def als_check(spark: SparkSession, d: str) -> DataFrame:
    """The fitted factors, checked by column expressions: one row of factors for each user and item; the items solve their
    normal equations given the users (largest residual); the objective lies below that of factors of zero, which is the sum of
    the weights; and the lists of the users with an id divisible by 100 are those of all items scored one by one."""
    train, test, _ = rec_queries.split(spark, d)
    users, items = als.fit_als(train)
    size, reg, alpha = 32, 60.0, 8.0
    gram = als.gram(users, size)
    at = lambda c: F.posexplode(c).alias("j", "v")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    cells = train.select("user_id", "item_id", F.col("play_count").cast("double").alias("r"))
    cells = cells.join(users.select(F.col("id").alias("user_id"), F.col("f").alias("x")), "user_id").join(items.select(F.col("id").alias("item_id"), F.col("f").alias("y")), "item_id")
    pull = cells.select("item_id", (alpha * F.col("r") * dot("x", "y") - (1 + alpha * F.col("r"))).alias("w"), at("x")).groupBy("item_id", "j").agg(F.sum(F.col("w") * F.col("v")).alias("seen"))
    rows = F.array(*(F.array(*map(F.lit, g)) for g in gram.tolist()))
    whole = items.select(F.col("id").alias("item_id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: dot(F.element_at(rows, j + 1), "f") + reg * F.element_at("f", j + 1))).alias("j", "all"))
    worst = whole.join(pull, ["item_id", "j"]).agg(F.max(F.abs(F.col("all") + F.col("seen"))).alias("worst"), F.max(F.abs("seen")).alias("scale"))
    zero = train.agg(F.sum(1 + alpha * F.col("play_count")).alias("zero"))
    lower = als.als_objective(train, users, items, reg, alpha)
    some = users.where("id % 100 = 0").join(test.select(F.col("user_id").alias("id")).distinct(), "id", "left_semi")
    got = als.als_top_k(some, items, train, K).select("user_id", "rank", F.round("score", 8).alias("score"))
    # a stated set of users against all items
    scored = some.select(F.col("id").alias("user_id"), F.col("f").alias("x")).join(items.select(F.col("id").alias("item_id"), F.col("f").alias("y")), F.col("user_id").isNotNull())
    want = recommend.masked_top_k(scored.select("user_id", "item_id", dot("x", "y").alias("score")), train, K).select("user_id", "rank", F.round("score", 8).alias("score"))
    n_wrong = got.exceptAll(want).count() + want.exceptAll(got).count()
    return worst.join(F.broadcast(zero)).select(
        F.lit(users.count()).cast("bigint").alias("n_users"), F.lit(items.count()).cast("bigint").alias("n_items"), (F.col("worst") <= 1e-6 * F.greatest("scale", F.lit(1.0))).alias("items_are_solved"),
        (F.lit(lower) < F.col("zero")).alias("objective_is_lower"), F.lit(n_wrong == 0).alias("lists_are_exact"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        fraud_ladder, fraud_ladder_check, rules_frozen_threshold, pair_ladder, pair_ladder_check, rec_ladder, rec_ladder_by_activity, rec_ladder_check, als_check,
    )
}

_VT = """, q AS (SELECT quantile_cont(epoch_us(timestamp), 0.6) AS a, quantile_cont(epoch_us(timestamp), 0.8) AS b FROM txn),
va AS (SELECT s.* FROM s, q WHERE epoch_us(timestamp) > a AND epoch_us(timestamp) <= b), te AS (SELECT s.* FROM s, q WHERE epoch_us(timestamp) > b)"""
_PARTS = """, part AS (SELECT pair_id, CASE WHEN part = 'test' THEN 'test' WHEN (pair_id * 31) % 100 < 20 THEN 'valid' ELSE 'fit' END AS part FROM sp WHERE part IS NOT NULL)
SELECT count(*) FILTER (WHERE part = 'valid') AS n_valid, count(*) FILTER (WHERE part = 'test') AS n_test FROM part"""


def _each(names: dict, sql: str, flags: str, more: str = "") -> str:
    models_ = ", ".join(f"('{n}')" for n in names)
    return f"SELECT {more}model, c.*, {flags} FROM ({sql}) c, (VALUES {models_}) m(model)"


ORACLE = {
    "fraud_ladder_check": _each(FRAUD, f"{_S}{_VT} SELECT count(*) AS n_test, CAST(sum(y) AS BIGINT) AS n_pos FROM te", "true AS in_unit, true AS beats_chance"),
    "rules_frozen_threshold": _S
    + _VT
    + f""", w AS (SELECT count(*) AS n, sum(y) AS p, sum(y * amount) AS aa FROM va), k AS (SELECT row_number() OVER w AS alerts, score AS threshold, sum(y) OVER w AS tp, sum(y * amount) OVER w AS caught
  FROM va WINDOW w AS (ORDER BY score DESC, transaction_id ROWS UNBOUNDED PRECEDING) UNION ALL SELECT 0, CAST('inf' AS DOUBLE), 0, 0.0),
  t AS (SELECT threshold FROM k, w WHERE alerts / n <= {ALERT_CAP} ORDER BY (aa - caught) + (p - tp) * 25.0 + alerts * 3.5 + (alerts - tp) * 12.0, alerts LIMIT 1),
  o AS (SELECT max(threshold) AS threshold, count(*) FILTER (WHERE score >= threshold) AS alerts, count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp,
  count(*) FILTER (WHERE score < threshold AND y = 1) AS fn, coalesce(sum(amount) FILTER (WHERE score >= threshold AND y = 1), 0.0) AS recovered,
  coalesce(sum(amount) FILTER (WHERE score < threshold AND y = 1), 0.0) AS missed, coalesce(sum(amount + 25.0) FILTER (WHERE y = 1), 0.0) AS nothing FROM te, t),
  oo AS (SELECT *, missed + fn * 25.0 + alerts * 3.5 + fp * 12.0 AS total_cost FROM o)
  SELECT {R.format('threshold')} AS threshold, alerts, tp, fp, fn, {R.format('recovered')} AS recovered, {R.format('missed')} AS missed, {R.format('total_cost')} AS total_cost,
  {R.format('nothing - total_cost')} AS savings FROM oo""",
    "pair_ladder_check": " UNION ALL ".join(
        _each(PAIRS, sql + _PARTS, "true AS in_unit", f"'{protocol}' AS protocol, ") for protocol, sql in (("random", pair_queries.SPLIT_BY_PAIR), ("disjoint", pair_queries.SPLIT_BY_CLUSTER))
    ),
    "rec_ladder_check": _each(
        RECOMMENDERS, rec_queries.SPLIT_SQL + " SELECT count(DISTINCT user_id) AS n_users FROM te", "CAST(0 AS BIGINT) AS n_seen, CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_wrong_ranks, true AS is_full"
    ),
    "als_check": rec_queries.SPLIT_SQL
    + " SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, true AS items_are_solved, true AS objective_is_lower, true AS lists_are_exact FROM tr",
}
