"""Queries over the play log: collapse, split, popularity, item neighbours, factors, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import als, recommend
from tidemark.plans.demand_queries import _rounded
from tidemark.plans.txn_queries import R
from tidemark.session import Stage, read_table
from tidemark.sources.tables import PLAYS_SQL, plays

K, NEIGHBOURS = 10, 100


def split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """train, test, and the catalogue: the items table and all items played."""
    s = Stage(recommend.leave_last_out(recommend.collapse_repeats(plays(spark, d)))).df
    catalogue = read_table(spark, d, "items").select("item_id").unionAll(s.select("item_id")).where("item_id is not null").distinct()
    return s.where("split = 'train'"), s.where("split = 'test'"), catalogue


def interaction_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(recommend.log_summary(plays(spark, d), read_table(spark, d, "items").select("item_id").distinct()))


def repeat_collapse(spark: SparkSession, d: str) -> DataFrame:
    return recommend.collapse_repeats(plays(spark, d))


def leave_last_out(spark: SparkSession, d: str) -> DataFrame:
    return recommend.leave_last_out(recommend.collapse_repeats(plays(spark, d))).select("user_id", "item_id", "split")


def train_test_leak_check(spark: SparkSession, d: str) -> DataFrame:
    train, test, _ = split(spark, d)
    return recommend.leaked_pairs(train, test).agg(F.count("*").alias("n_leaked"))


def _popular(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    train, test, items = split(spark, d)
    return recommend.top_k_by_rank(test, recommend.popularity_rank(train), train, K), train, test, items


def popularity_topk_masked(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_popular(spark, d)[0])


def random_topk(spark: SparkSession, d: str) -> DataFrame:
    train, test, items = split(spark, d)
    return recommend.random_top_k(test, items, train, K)


def item_knn_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(recommend.item_neighbours(split(spark, d)[0], NEIGHBOURS))


def item_knn_topk(spark: SparkSession, d: str) -> DataFrame:
    train, test, _ = split(spark, d)
    return _rounded(recommend.masked_top_k(recommend.item_knn_scores(train, recommend.item_neighbours(train, NEIGHBOURS), test), train, K))


def rec_accuracy(spark: SparkSession, d: str) -> DataFrame:
    recs, _, test, _ = _popular(spark, d)
    return _rounded(recommend.accuracy(recs, test, K))


def rec_distribution(spark: SparkSession, d: str) -> DataFrame:
    recs, train, _, items = _popular(spark, d)
    return _rounded(recommend.distribution(Stage(recs).df, train, items, K))


def rec_by_activity(spark: SparkSession, d: str) -> DataFrame:
    recs, train, test, _ = _popular(spark, d)
    return _rounded(recommend.by_activity(recs, train, test, K))


def als_factors(spark: SparkSession, d: str) -> DataFrame:
    users, items = als.fit_als(split(spark, d)[0])
    return users.withColumn("side", F.lit("user")).unionByName(items.withColumn("side", F.lit("item")))


def als_objective(spark: SparkSession, d: str) -> DataFrame:
    train = split(spark, d)[0]
    users, items = als.fit_als(train)
    return spark.createDataFrame([(als.als_objective(train, users, items),)], "objective double")


def als_topk(spark: SparkSession, d: str) -> DataFrame:
    train, test, _ = split(spark, d)
    users, items = als.fit_als(train)
    return als.als_top_k(users.join(test.select(F.col("user_id").alias("id")).distinct(), "id", "left_semi"), items, train, K)


QUERIES = {
    f.__name__: f
    for f in (
        interaction_summary, repeat_collapse, leave_last_out, train_test_leak_check, popularity_topk_masked, random_topk, item_knn_neighbours, item_knn_topk,
        rec_accuracy, rec_distribution, rec_by_activity, als_factors, als_objective, als_topk,
    )
}

SPLIT_SQL = f"""WITH {PLAYS_SQL}, c AS (SELECT user_id, item_id, max(timestamp) AS timestamp, CAST(sum(play_count) AS BIGINT) AS play_count FROM plays GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id DESC) <= 2 AND count(*) OVER (PARTITION BY user_id) - 2 >= 5
  THEN 'test' ELSE 'train' END AS split FROM c), tr AS (SELECT * FROM s WHERE split = 'train'), te AS (SELECT * FROM s WHERE split = 'test'),
cat AS (SELECT item_id FROM items WHERE item_id IS NOT NULL UNION SELECT item_id FROM c)"""
_POP = (
    SPLIT_SQL
    + f""", pop AS (SELECT item_id, count(DISTINCT user_id) AS n_users FROM tr GROUP BY 1),
rec AS (SELECT * FROM (SELECT u.user_id, row_number() OVER (PARTITION BY u.user_id ORDER BY n_users DESC, pop.item_id) AS rank, pop.item_id, CAST(n_users AS DOUBLE) AS score
  FROM (SELECT DISTINCT user_id FROM te) u CROSS JOIN pop ANTI JOIN tr ON tr.user_id = u.user_id AND tr.item_id = pop.item_id) WHERE rank <= {K})"""
)
_ACC = (
    _POP
    + f""", t AS (SELECT user_id, count(*) AS n_truth FROM te GROUP BY 1),
h AS (SELECT user_id, rank, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS c FROM rec SEMI JOIN te USING (user_id, item_id)),
hh AS (SELECT user_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, sum(c / rank) AS prec FROM h GROUP BY 1),
pu AS (SELECT user_id, n_truth, coalesce(hits, 0) / n_truth AS recall, CAST(coalesce(hits, 0) > 0 AS DOUBLE) AS hit,
  coalesce(dcg, 0) / list_sum([1 / log2(r + 1) for r in range(1, least(n_truth, {K}) + 1)]) AS ndcg, coalesce(prec, 0) / least(n_truth, {K}) AS map FROM t LEFT JOIN hh USING (user_id))"""
)
_KNN = (
    SPLIT_SQL
    + f""", dt AS (SELECT a.item_id AS src, b.item_id AS dst, sum(CAST(a.play_count AS DOUBLE) * b.play_count) AS p FROM tr a JOIN tr b USING (user_id) GROUP BY 1, 2),
nm AS (SELECT src AS i, sqrt(p) AS n FROM dt WHERE src = dst),
sim AS (SELECT src, dst, round(p / (x.n * y.n + 10.0 + 1e-9), 12) AS similarity FROM dt JOIN nm x ON x.i = src JOIN nm y ON y.i = dst WHERE src <> dst AND p <> 0),
nb AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS r FROM sim) WHERE r <= {NEIGHBOURS})"""
)
ORACLE = {
    "interaction_summary": f"""WITH {PLAYS_SQL}, cat AS (SELECT DISTINCT item_id FROM items), pi AS (SELECT item_id, count(*) AS n FROM plays GROUP BY 1), pu AS (SELECT count(*) AS n FROM plays GROUP BY user_id)
  SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, (SELECT count(*) FROM cat) AS catalogue,
  {R.format("(SELECT count(*) FROM (SELECT DISTINCT user_id, item_id FROM plays)) / (count(DISTINCT user_id) * (SELECT count(*) FROM cat))")} AS density,
  {R.format("(SELECT quantile_cont(n, 0.5) FROM pu)")} AS median_plays,
  {R.format("(SELECT sum(n) FROM (SELECT n FROM pi ORDER BY n DESC, item_id LIMIT (SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) FROM cat))) / count(*)")} AS top1pct_share,
  (SELECT count(*) FROM cat ANTI JOIN pi USING (item_id)) AS never_played FROM plays""",
    "repeat_collapse": SPLIT_SQL + " SELECT * FROM c",
    "leave_last_out": SPLIT_SQL + " SELECT user_id, item_id, split FROM s",
    "train_test_leak_check": SPLIT_SQL + " SELECT count(*) AS n_leaked FROM te SEMI JOIN tr USING (user_id, item_id)",
    "popularity_topk_masked": _POP + f" SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, {R.format('score')} AS score FROM rec",
    "item_knn_neighbours": _KNN + f" SELECT src, dst, {R.format('similarity')} AS similarity FROM nb",
    "item_knn_topk": _KNN
    + f""", sc AS (SELECT user_id, dst AS item_id, round(sum(play_count * similarity), 10) AS score FROM tr SEMI JOIN te USING (user_id) JOIN nb ON src = tr.item_id GROUP BY 1, 2),
  rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM sc ANTI JOIN tr USING (user_id, item_id))
  SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, {R.format("score")} AS score FROM rk WHERE rank <= {K}""",
    "rec_accuracy": _ACC + f" SELECT {R.format('avg(recall)')} AS recall, {R.format('avg(hit)')} AS hit_rate, {R.format('avg(ndcg)')} AS ndcg, {R.format('avg(map)')} AS map FROM pu",
    "rec_distribution": _POP
    + f""", x AS (SELECT cat.item_id, coalesce(n_users, 0) AS nu, coalesce(c, 0) AS c FROM cat LEFT JOIN pop USING (item_id) LEFT JOIN (SELECT item_id, count(*) AS c FROM rec GROUP BY 1) USING (item_id)),
  y AS (SELECT *, row_number() OVER (ORDER BY nu, item_id) AS bp, row_number() OVER (ORDER BY c, item_id) AS bc, count(*) OVER () AS n, sum(c) OVER () AS slots, sum(nu) OVER () AS pops FROM x)
  SELECT {R.format("count(*) FILTER (WHERE c > 0) / count(*)")} AS coverage, {R.format("sum(c * -log2(greatest(nu / pops, 1e-12))) / max(slots)")} AS novelty,
  {R.format("2 * sum(bc * c) / (max(n) * max(slots)) - (max(n) + 1) / max(n)")} AS gini, {R.format("sum(c * (bp - 1) / greatest(n - 1, 1)) / max(slots)")} AS popularity_percentile FROM y""",
    "rec_by_activity": _ACC
    + f""", hs AS (SELECT user_id, count(*) AS h FROM tr GROUP BY 1), u AS (SELECT pu.*, coalesce(h, 0) AS h FROM pu LEFT JOIN hs USING (user_id)),
  e AS (SELECT quantile_cont(h, [0.25, 0.5, 0.75]) AS e FROM u)
  SELECT CAST(len([q for q in e if q <= h]) AS INTEGER) AS bucket, count(*) AS n, {R.format("quantile_cont(h, 0.5)")} AS median_history, {R.format("avg(recall)")} AS recall,
  {R.format("avg(ndcg)")} AS ndcg FROM u, e GROUP BY 1""",
}
