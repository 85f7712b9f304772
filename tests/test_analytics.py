"""Hand-computed values, invariants and error paths of the analytic operators."""

import datetime as dt
import inspect
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.functions import text as T
from tidemark.operators import als, decision, demand, history, metrics, models, order, products, recommend, textpairs
from tidemark.plans import demand_queries, model_queries, rec_queries, report, txn_queries
from tidemark.sources import generators, sinks, tables
from tidemark.streaming import history as sh

COSTS = decision.CostModel(1.0, 25.0, 3.5, 12.0)


@pytest.fixture(scope="module")
def alerts(spark):
    return spark.createDataFrame([(1, 0, 0.1, 10.0), (2, 1, 0.9, 100.0), (3, 0, 0.2, 20.0), (4, 1, 0.8, 50.0)], "id int, y int, s double, a double")


def test_cost_curve_literals(spark, alerts):
    curve = decision.cost_curve(alerts, "id", "y", "s", "a", COSTS).orderBy("alerts").collect()
    assert len(curve) == 5 and (curve[0].total_cost, curve[0].savings, curve[0].threshold) == (200.0, 0.0, None)
    p = decision.operating_point(alerts, "y", "s", "a", 0.8, COSTS).first()
    assert (p.tp, p.fp, p.fn, p.total_cost, p.savings) == (2, 0, 0, 7.0, 193.0)
    assert (curve[2].total_cost, curve[2].savings) == (7.0, 193.0)
    best = decision.cheapest_threshold(decision.cost_curve(alerts, "id", "y", "s", "a", COSTS)).first()
    assert (best.alerts, best.threshold) == (2, 0.8)
    assert decision.cheapest_threshold(decision.cost_curve(alerts, "id", "y", "s", "a", COSTS), 0.25).first().alerts == 1
    assert decision.cost_curve(alerts.limit(0), "id", "y", "s", "a").count() == 1
    with pytest.raises(ValueError):
        decision.cheapest_threshold(alerts.selectExpr("1 as alerts", "1 as total_cost", "1 as alert_rate"), -1)


def test_budget_and_weights(spark):
    rows = list(enumerate(zip([1, 1, 0, 0, 0, 0], [0.9, 0.8, 0.7, 0.2, 0.1, 0.05])))
    df = spark.createDataFrame([(i, y, s) for i, (y, s) in rows], "id int, y int, s double")
    assert tuple(decision.precision_at_budget(df, "id", "y", "s", 2).first()) == (1.0, 1.0)
    assert tuple(decision.precision_at_budget(df, "id", "y", "s", 4).first()) == (0.5, 1.0)
    with pytest.raises(ValueError):
        decision.precision_at_budget(df, "id", "y", "s", 0)
    assert decision.positive_weight(spark.range(1000).selectExpr("int(id < 10) as y"), "y").first().weight == 99.0
    with pytest.raises(Exception, match="no positive rows"):
        decision.positive_weight(spark.range(5).selectExpr("0 as y"), "y").collect()


def test_ranking_metrics_with_ties(spark):
    y, s = [1, 0, 1, 1, 0, 0, 1], [0.9, 0.9, 0.8, 0.5, 0.5, 0.1, 0.1]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    r = metrics.ranking_metrics(df, "y", "s").first()
    wins = [(a > b) + 0.5 * (a == b) for a, p in zip(s, y) if p for b, q in zip(s, y) if not q]
    assert r.roc_auc == pytest.approx(sum(wins) / len(wins))
    ap, tp, k = 0.0, 0, 0
    for t in sorted(set(s), reverse=True):
        p, n = sum(y_ for y_, x in zip(y, s) if x == t), s.count(t)
        tp, k = tp + p, k + n
        ap += p / sum(y) * tp / k
    assert r.average_precision == pytest.approx(ap)
    assert metrics.ranking_metrics(df.where("y = 1"), "y", "s").first().roc_auc is None
    assert metrics.ranking_metrics(df.limit(0), "y", "s").first().n == 0
    m = metrics.threshold_metrics(spark.range(100).selectExpr("int(id < 37) as y", "0.0D as s"), "y", "s", 0.5).first()
    assert (m.majority_floor, m.positive_rate, m.f1) == (0.63, 0.37, 0.0)


def test_forecast_metrics_literals(spark):
    def one(y, f):
        df = spark.createDataFrame(list(zip(map(float, y), map(float, f))), "y double, f double")
        return df.agg(*(c.alias(n) for n, c in metrics.forecast_metrics(F.col("y"), F.col("f")).items())).first()

    assert one([1000, 2], [1000, 4]).wape == pytest.approx(2 / 1002)
    z = one([0, 0, 10], [1, 1, 10])
    assert z.wape == pytest.approx(0.2) and math.isfinite(z.smape)
    assert one([10] * 3, [12] * 3).bias == pytest.approx(0.2) and one([10] * 3, [12, 8, 10]).bias == pytest.approx(0)
    assert one([0, 0], [1, 1]).wape is None
    s = spark.createDataFrame([("m", 0.4), ("b", 0.5), ("w", 0.6)], "model string, wape double")
    got = {r.model: r.value_added for r in demand.value_added(s, "b").collect()}
    assert got["m"] == pytest.approx(0.2) and got["w"] == pytest.approx(-0.2)


def test_history_is_point_in_time_and_matches_brute_force(spark, sf):
    t = tables.transactions(spark, sf).toPandas().sort_values(["timestamp", "transaction_id"])
    t = pd.concat([t, t.head(3).assign(transaction_id=lambda d: d.transaction_id + 10**6)]).sort_values(["timestamp", "transaction_id"])
    whole = spark.createDataFrame(t)
    cut = spark.createDataFrame(t.head(len(t) // 2))
    full = {r.transaction_id: r for r in history.build_features(whole).collect()}
    part = {r.transaction_id: r for r in history.build_features(cut).collect()}
    assert set(part) <= set(full) and len(full) == len(t)
    for i, r in part.items():
        assert all(a == pytest.approx(b) if isinstance(a, float) else a == b for a, b in zip(r, full[i]))
        assert all(x is not None for x in r)
    for _, row in t.sample(60, random_state=1).iterrows():
        same = t[t.account_id == row.account_id]
        hour = same[(same.timestamp < row.timestamp) & (same.timestamp >= row.timestamp - pd.Timedelta("1h"))]
        day = same[(same.timestamp < row.timestamp) & (same.timestamp >= row.timestamp - pd.Timedelta("24h"))]
        f = full[row.transaction_id]
        assert (f.txn_count_1h, f.txn_count_24h) == (len(hour), len(day)) and f.amount_sum_24h == pytest.approx(day.amount.sum())


def test_history_dirty_input(spark):
    rows = [(1, None, "2024-01-01 00:00:00", 5.0, None), (2, 7, None, 5.0, "a"), (3, 7, "2024-01-01 10:00:00", None, "a"), (4, 7, "2024-01-03 10:00:00", 2.0, "a"), (5, None, "2024-01-01 00:30:00", 1.0, None)]
    df = spark.createDataFrame(rows, "id int, acct int, ts string, v double, cat string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("count", F.lit(1))
    got = {r.id: r for r in history.with_history(df, "acct", "ts", "id", "v", "cat").collect()}
    assert len(got) == 5 and got[5].prior_count == 1 and got[5].count_1h == 1 and got[5].prior_mean == pytest.approx(5.0)
    assert got[4].prior_count == 1 and got[4].prior_mean is None and got[4].minutes_since_prev == 2880 and got[2].prior_count is None
    assert got[3].is_first_in_category and not got[4].is_first_in_category
    assert history.with_history(df.limit(0), "acct", "ts", "id", "v", "cat").count() == 0
    with pytest.raises(KeyError):
        history.build_features(df)


def test_temporal_split_is_ordered(spark, sf):
    t = history.temporal_split(tables.transactions(spark, sf), "timestamp")
    r = {x.split: (x.a, x.b) for x in t.groupBy("split").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).collect()}
    assert r["train"][1] <= r["valid"][0] and r["valid"][1] <= r["test"][0]


def test_demand_lags_folds_and_safety(spark):
    for h in (1, 7, 14, 28, 56, 336, 364, 400):
        lags = demand.lag_days(h)
        assert min(lags) >= h and len(lags) == len(set(lags)) and (364 in lags) == (h <= 364)
    with pytest.raises(ValueError):
        demand.lag_days(0)
    with pytest.raises(ValueError):
        demand.baseline_columns(10)
    a, b = dt.date(2023, 1, 1), dt.date(2023, 6, 30)
    folds = demand.rolling_origin_folds(a, b, 28, 3, 60)
    assert folds[-1].test_end == b and all((f.test_end - f.origin).days == 28 for f in folds)
    assert all(x.test_end < y.test_start for x, y in zip(folds, folds[1:]))
    with pytest.raises(ValueError):
        demand.rolling_origin_folds(a, b, 28, 3, 420)
    panel = generators.sales(spark, generators.SalesConfig(3, 150))
    full = demand.build_features(panel, 14).where("date <= '2021-04-30'")
    cut = demand.build_features(panel.where("date <= '2021-04-30'"), 14)
    assert sorted(map(str, full.collect())) == sorted(map(str, cut.collect()))


def test_ranking_literals(spark):
    recs = [(u, r + 1, i) for u, l in enumerate([[1, 5, 7, 9, 2], [8, 4, 6, 3, 0]]) for r, i in enumerate(l)]
    recs = spark.createDataFrame(recs, "user_id int, rank int, item_id int")
    truth = spark.createDataFrame([(0, 1), (0, 7), (1, 3)], "user_id int, item_id int")
    a5, a2 = recommend.accuracy(recs, truth, 5).first(), recommend.accuracy(recs, truth, 2).first()
    d = [1 / math.log2(k + 1) for k in range(1, 6)]
    assert a5.recall == 1.0 and a2.recall == 0.25 and a2.hit_rate == 0.5
    assert a5.ndcg == pytest.approx(((d[0] + d[2]) / (d[0] + d[1]) + d[3] / d[0]) / 2)
    assert a5.map == pytest.approx(((1 + 2 / 3) / 2 + 1 / 4) / 2)
    items = spark.range(20).select(F.col("id").alias("item_id"))
    train = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (1, 2, 1)], "user_id int, item_id int, play_count int")
    dist = recommend.distribution(recs, train, items, 5).first()
    assert dist.coverage == 0.5 and 0 <= dist.popularity_percentile <= 1


def test_popularity_counts_users_and_masks(spark):
    train = spark.createDataFrame([(0, 0, 100), (1, 1, 1), (2, 1, 1)], "user_id int, item_id int, play_count int")
    ranked = recommend.popularity_rank(train)
    assert [r.item_id for r in ranked.orderBy("place").collect()] == [1, 0]
    got = recommend.top_k_by_rank(train, ranked, train, 5).collect()
    assert {(r.user_id, r.item_id) for r in got} == {(0, 1), (1, 0), (2, 0)}


def test_leave_last_out(spark):
    t = lambda k: dt.datetime(2024, 1, 1 + k)
    rows = [(1, k, t(k), 1) for k in range(8)] + [(2, k, t(k), 1) for k in range(4)]
    s = recommend.leave_last_out(spark.createDataFrame(rows, "user_id int, item_id int, timestamp timestamp_ntz, play_count int"), 2, 5)
    assert {(r.user_id, r.item_id) for r in s.where("split = 'test'").collect()} == {(1, 6), (1, 7)}
    recommend.assert_no_leak(s.where("split = 'train'"), s.where("split = 'test'"))
    with pytest.raises(AssertionError):
        recommend.assert_no_leak(s, s)
    with pytest.raises(ValueError):
        recommend.leave_last_out(s, 0)


def test_item_products_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(products, "TILE", 7)
    rng = np.random.default_rng(5)
    m = rng.integers(0, 4, (30, 25)) * (rng.random((30, 25)) < 0.3)
    rows = [(int(u), int(i), int(m[u, i])) for u, i in zip(*np.nonzero(m))]
    got = products.item_products(spark.createDataFrame(rows, "u int, i int, v int"), "u", "i", "v").collect()
    want = m.T @ m
    assert {(r.src, r.dst): r["product"] for r in got} == {(i, j): float(want[i, j]) for i, j in zip(*np.nonzero(want))}


def test_als_descends_and_finds_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(u, i, 1 + int(rng.integers(5))) for u in range(60) for i in range(40) if (u < 30) == (i < 20) and rng.random() < 0.4]
    train = spark.createDataFrame(rows, "user_id bigint, item_id bigint, play_count int")
    losses = [als.als_objective(train, *als.fit_als(train, 8, n, 1.0, 10.0), 1.0, 10.0) for n in (1, 2, 4)]
    assert losses[0] >= losses[1] >= losses[2]
    users, items = als.fit_als(train, 8, 6, 1.0, 10.0)
    x = {r.id: np.array(r.f) for r in users.collect()}
    y = {r.id: np.array(r.f) for r in items.collect()}
    inside = np.mean([x[u] @ y[i] for u in x for i in y if (u < 30) == (i < 20)])
    across = np.mean([x[u] @ y[i] for u in x for i in y if (u < 30) != (i < 20)])
    assert inside > across + 0.1
    # the last half step solves the items' normal equations exactly
    g = sum(np.outer(v, v) for v in x.values())
    i0 = next(iter(y))
    a, b = g + np.eye(8), np.zeros(8)
    for u, i, r in rows:
        if i == i0:
            a, b = a + 10.0 * r * np.outer(x[u], x[u]), b + (1 + 10.0 * r) * x[u]
    assert np.allclose(np.linalg.solve(a, b), y[i0], atol=1e-6)
    top = als.als_top_k(users, items, train, 5, block=16).collect()
    seen = {(u, i) for u, i, _ in rows}
    assert len(top) == 300 and not {(r.user_id, r.item_id) for r in top} & seen
    best = {u: sorted((i for i in y if (u, i) not in seen), key=lambda i: (-(x[u] @ y[i]), i))[:5] for u in x}
    assert all(set(best[u]) == {r.item_id for r in top if r.user_id == u} for u in list(x)[:10])


def test_als_queries_fit_the_whole_model(spark, sf, monkeypatch):
    """32 factors and 15 rounds, as the operator's defaults."""
    asked = []
    one_round = lambda train, *a, **k: asked.append((a, k)) or fit(train, iterations=1)
    fit = als.fit_als
    monkeypatch.setattr(als, "fit_als", one_round)
    factors = rec_queries.als_factors(spark, sf).collect()
    rec_queries.als_objective(spark, sf), rec_queries.als_topk(spark, sf)
    assert asked == [((), {})] * 3 and {len(r.f) for r in factors} == {32}
    assert inspect.signature(fit).parameters["size"].default == 32 and inspect.signature(fit).parameters["iterations"].default == 15


@pytest.mark.parametrize("limits", [{}, {"MOST_BROADCAST": 0, "LIGHT": 10, "MOST_OPEN": 2}, {"MOST_ROWS": 3}])
def test_als_ways_to_the_sums_agree(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(als, name, value)
    rng = np.random.default_rng(7)
    m = (rng.random((50, 30)) < np.linspace(0.9, 0.1, 30)) * rng.integers(1, 5, (50, 30))
    rows = [(int(u), int(i), int(m[u, i])) for u, i in zip(*np.nonzero(m))]
    users, items = als.fit_als(spark.createDataFrame(rows, "user_id bigint, item_id bigint, play_count int"), 4, 2, 1.0, 10.0)
    x, y = {r.id: np.array(r.f) for r in users.collect()}, {r.id: np.array(r.f) for r in items.collect()}
    assert users.count() == len(x) == len({u for u, _, _ in rows}) and items.count() == len(y) == len({i for _, i, _ in rows})
    a = {i: sum(np.outer(v, v) for v in x.values()) + np.eye(4) for i in y}
    b = {i: np.zeros(4) for i in y}
    for u, i, r in rows:
        a[i], b[i] = a[i] + 10.0 * r * np.outer(x[u], x[u]), b[i] + (1 + 10.0 * r) * x[u]
    assert all(np.allclose(np.linalg.solve(a[i], b[i]), y[i], atol=1e-6) for i in y)


def test_item_knn_keeps_100_neighbours(spark, tmp_path):
    """One user with 130 items: each item has 129 neighbours."""
    rows = [(u, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for u in (1, 2) for i in range(130 * (u == 1) + 2 * (u == 2))]
    plays = spark.createDataFrame(rows, "user_id bigint, item_id bigint, timestamp timestamp_ntz").selectExpr("*", "1 as play_count", "timestamp as ingested_at")
    plays.write.parquet(f"{tmp_path}/interactions.parquet")
    plays.select("item_id").distinct().write.parquet(f"{tmp_path}/items.parquet")
    sizes = {r["count"] for r in rec_queries.QUERIES["item_knn_neighbours"](spark, str(tmp_path)).groupBy("src").count().collect()}
    assert sizes == {100}


def test_learned_models_forecast_every_fold(spark, sf):
    base, got = demand_queries.backtest_predictions(spark, sf), model_queries.tweedie_forecast(spark, sf)
    assert set(got.columns) == set(base.columns)
    keys = ["fold", "origin", "date", "sku_id", "days_ahead", "units"]
    want = sorted(tuple(r) for r in base.where("model = 'moving_average'").select(keys).collect())
    assert sorted(tuple(r) for r in got.select(keys).collect()) == want and len({r[0] for r in want}) == 3


def test_learned_models_are_fitted_on_all_rows_in_stock(spark, sf, monkeypatch):
    sizes = []

    class Counting(models.Model):
        def fit(self, train):
            sizes.append(train.count())
            return super().fit(train)

    monkeypatch.setattr(models, "Model", Counting)
    model_queries.tweedie_forecast(spark, sf)
    stocked, folds = demand.densify(tables.sales(spark, sf)).where("was_in_stock"), demand_queries.backtest_folds(spark, sf).orderBy("fold").collect()
    assert sizes == [stocked.where(F.col("date") <= F.lit(f.origin)).count() for f in folds]


def test_text_functions(spark):
    df = spark.createDataFrame([("How do I install Docker on Ubuntu?", "How do I install Docker on Ubuntu?"), ("Docker images", "guitar chords 7"), ("", "x"), ("ä1 b", "a" * 50_000)], "question1 string, question2 string")
    df = df.withColumn("pair_id", F.monotonically_increasing_id())
    f = {r.question1: r for r in textpairs.PairFeaturizer().fit(df).transform(df).join(df, "pair_id").collect()}
    same = f["How do I install Docker on Ubuntu?"]
    assert same.token_jaccard == same.content_jaccard == same.digit_overlap == 1.0 and same.abs_char_length_diff == 0 and same.unique_to_shorter == 0
    assert same.tfidf_word_cosine > 0.99 and same.tfidf_char_cosine > 0.99 and same.common_prefix_words == 7
    assert f["Docker images"].content_jaccard < 0.15 and f["Docker images"].digit_overlap == 0 and len(f) == 4
    swapped = {r.question2: r for r in textpairs.PairFeaturizer().fit(df).transform(df.selectExpr("pair_id", "question2 as question1", "question1 as question2")).join(df.selectExpr("pair_id", "question1 as question2"), "pair_id").collect()}
    assert all(f[k][n] == pytest.approx(swapped[k][n]) for k in f for n in textpairs.FEATURES)
    assert df.select(T.tokens(F.lit("Ä1 b'c-9"))).first()[0] == ["1", "b", "c", "9"]
    with pytest.raises(RuntimeError):
        textpairs.PairFeaturizer().transform(df)
    with pytest.raises(RuntimeError):
        textpairs.TargetEncoder().transform(df)


def test_target_encoding_of_unseen_questions(spark):
    train = spark.createDataFrame([(1, "a", "b", 1), (2, "a", "a", 0), (3, "c", None, 1)], "pair_id int, question1 string, question2 string, is_duplicate int")
    e = textpairs.TargetEncoder().fit(train)
    new = spark.createDataFrame([(9, "x", "y")], "pair_id int, question1 string, question2 string")
    r = e.transform(new).first()
    assert r.question_target_enc_min == r.question_target_enc_max == pytest.approx(2 / 3) and r.question_seen_count_max == 0
    assert e.unseen_share(new).first()[0] == 1.0
    seen = e.transform(train).where("pair_id = 2").first()
    assert seen.question_seen_count_min == 3 and seen.question_target_enc_min == pytest.approx((1 + 5 * 2 / 3) / 8)


def test_splits(spark):
    p = generators.question_pairs(spark, generators.PairConfig(2000, 100))
    s = textpairs.cluster_disjoint_split(p, 0.25, seed=3)
    test = {c for r in s.where("part = 'test'").collect() for c in (r.cluster1, r.cluster2)}
    train = {c for r in s.where("part = 'train'").collect() for c in (r.cluster1, r.cluster2)}
    assert test and train and not test & train
    r = textpairs.random_pair_split(p, 0.25)
    assert abs(r.where("part = 'test'").count() / 2000 - 0.25) < 0.04
    assert textpairs.question_overlap(r).limit(1).count() == 1
    with pytest.raises(AssertionError):
        textpairs.assert_no_question_overlap(r)
    b = textpairs.rebalance(p, 0.2, F.xxhash64("pair_id"))
    y = [x.is_duplicate for x in b.collect()]
    assert sum(y) / len(y) == pytest.approx(0.2, abs=0.01)
    assert textpairs.component_summary(spark.createDataFrame([(1, 2), (2, 3), (9, 8), (None, 4)], "u int, v int"), "u", "v").first()[:2] == (2, 5)


def test_generators(spark):
    t = generators.transactions(spark, generators.TransactionConfig(4000, 200, 0.05)).cache()
    assert t.count() == t.select("transaction_id").distinct().count() and t.where("is_fraud = 1").count() > 50
    a, b = (t.where(f"is_fraud = {k}").agg(F.avg("distance_from_home_km")).first()[0] for k in (1, 0))
    assert a > b
    again = generators.transactions(spark, generators.TransactionConfig(4000, 200, 0.05)).repartition(3)
    assert t.exceptAll(again).count() == 0
    panel = generators.sales(spark, generators.SalesConfig(4, 60))
    assert panel.count() == 240 and panel.where("not was_in_stock and units > 0").count() == 0
    q = generators.question_pairs(spark, generators.PairConfig(500, 60))
    assert q.where("(is_duplicate = 1) <> (cluster1 = cluster2)").count() == 0
    plays, items = generators.interactions(spark, generators.PlayConfig(200, 300, 20))
    assert plays.count() == plays.select("user_id", "item_id").distinct().count() and abs(items.agg(F.sum("popularity")).first()[0] - 1) < 1e-9
    assert plays.groupBy("user_id").count().agg(F.min("count")).first()[0] >= 8 and plays.select("user_id").distinct().count() == 200
    assert plays.exceptAll(generators.interactions(spark, generators.PlayConfig(200, 300, 20))[0].repartition(3)).count() == 0
    with pytest.raises(ValueError):
        generators.PairConfig(0)
    with pytest.raises(ValueError):
        generators.PlayConfig(min_plays=2)


def test_weighted_sample_is_that_of_draws_one_after_the_other():
    rng, p = np.random.default_rng(5), np.array([0.5, 0.3, 0.2])
    pairs = [frozenset(generators.weighted_sample(rng, p, 2).tolist()) for _ in range(20_000)]
    for a, b in ((0, 1), (0, 2), (1, 2)):
        want = p[a] * p[b] / (1 - p[a]) + p[b] * p[a] / (1 - p[b])
        assert pairs.count(frozenset((a, b))) / 20_000 == pytest.approx(want, abs=0.012)
    assert sorted(generators.weighted_sample(rng, p, 9)) == [0, 1, 2]


def test_sales_are_negative_binomial(spark):
    df = spark.range(4000).select(generators.negative_binomial(F.col("id"), F.lit(20.0), 6.0, 3).alias("n"))
    mean, var = df.agg(F.avg("n"), F.variance("n")).first()
    assert mean == pytest.approx(20, abs=0.6) and var == pytest.approx(20 + 400 / 6, rel=0.12)
    panel = generators.sales(spark, generators.SalesConfig(20, 200))
    assert abs(panel.agg(F.avg(F.col("on_promo").cast("int"))).first()[0] - 0.12) < 0.03
    assert panel.where("on_promo").agg(F.max(F.col("price") / F.col("base_price"))).first()[0] < 0.93
    with pytest.raises(ValueError):
        generators.SalesConfig(elasticity=0.1)


def test_slips_have_their_rate(spark):
    q = generators.question_pairs(spark, generators.PairConfig(4000, 200, typo_rate=0.0))
    t = generators.question_pairs(spark, generators.PairConfig(4000, 200))
    changed = q.select("pair_id", F.col("question1").alias("was")).join(t, "pair_id").where("was <> question1").count()
    assert abs(changed / 4000 - 0.06) < 0.02


def test_models_beat_chance(spark):
    t = generators.transactions(spark, generators.TransactionConfig(6000, 200, 0.05, 1.0))
    rows = history.build_features(t).join(t.select("transaction_id", F.col("is_fraud").alias("label")), "transaction_id").cache()
    train, test = rows.where("transaction_id < 4000"), rows.where("transaction_id >= 4000")
    m = models.Model(models.logistic(0.5), history.NUMERIC, ["merchant_category"], balanced=True).fit(train)
    assert metrics.ranking_metrics(m.score(test, ["label"]), "label", "score").first().roc_auc > 0.9
    with pytest.raises(RuntimeError):
        models.Model(models.logistic(), history.NUMERIC).score(test, ["label"])
    with pytest.raises(ValueError):
        models.Model(models.logistic(), history.NUMERIC, balanced=True).fit(train.where("label = 0"))


def test_scalar_functions(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (None,), (3.0,)], "x double")
    assert [r[0] for r in df.select(scalar.bin_of(F.col("x"), [1.0, 2.0])).collect()] == [0, 1, None, 2]
    assert df.select(scalar.display_label(F.lit("same_day"), {"a": "B"})).first()[0] == "Same Day"
    assert df.select(scalar.display_label(F.lit("a"), {"a": "B"})).first()[0] == "B"
    got = [df.select(scalar.corrupt(F.lit("Ab cd efg hijk"), F.lit(k), F.lit(2))).first()[0] for k in range(4)]
    assert got == ["A cd efg hijk", "Ab  cd efg hijk", "ab cd efg hijk", "Ab cd efg hijk"]
    assert df.select(scalar.corrupt(F.lit("Ab cd"), F.lit(0), F.lit(2))).first()[0] == "ab cd"
    days = ["2023-01-01", "2023-12-25", "2023-12-24", "2023-12-23", "2023-12-14", "2023-12-13", "2023-07-01", "2023-07-04", "2023-07-05"]
    lifts = spark.createDataFrame([(d,) for d in days], "d string").select(scalar.holiday_lift(F.col("d").cast("date"), generators.HOLIDAYS))
    want = [0.55, 0.30, 1.95, 1 + 0.95 * 10 / 11, 1 + 0.95 / 11, 1.0, 1 + 0.35 / 4, 1.35, 1.0]
    assert [r[0] for r in lifts.collect()] == pytest.approx(want)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "model string, auc double")
    sinks.write_metrics(str(tmp_path / "m.json"), {"models": df, "n": 3})
    m = sinks.read_metrics(str(tmp_path / "m.json"))
    page = sinks.html_report(m, "Report <1>", {"models": ("auc", True)})
    assert "class='best'><td>b" in page and "&lt;1&gt;" in page
    with pytest.raises(FileNotFoundError):
        sinks.read_metrics(str(tmp_path / "none.json"))
    sinks.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_metrics(str(tmp_path / "x.json"), {"big": spark.range(20).toDF("id")}, most_rows=10)


def test_streamed_history_equals_batch(spark, sf, tmp_path):
    t = tables.transactions(spark, sf).orderBy("timestamp", "transaction_id").toPandas()
    for k, part in enumerate(np.array_split(np.arange(len(t)), 3)):
        spark.createDataFrame(t.iloc[part]).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "b=0")).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = sh.stream_history(src, "account_id", "timestamp", "transaction_id", "amount").writeStream.format("memory").queryName("hist").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.id: r for r in spark.table("hist").collect()}
    want = history.with_history(spark.createDataFrame(t), "account_id", "timestamp", "transaction_id", "amount", "merchant_category").collect()
    assert len(got) == len(want)
    for w in want:
        g = got[w.transaction_id]
        assert (g.prior_count, g.count_1h, g.count_24h) == (w.prior_count, w.count_1h, w.count_24h) and g.sum_24h == pytest.approx(w.sum_24h)


def test_stream_windows(spark, tmp_path):
    rows = [(1, "a", dt.datetime(2024, 1, 1, 0, 5), 2.0), (2, "a", dt.datetime(2024, 1, 1, 0, 50), 3.0), (2, "a", dt.datetime(2024, 1, 1, 0, 50), 3.0), (3, "b", dt.datetime(2024, 1, 1, 9, 0), 1.0)]
    spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("id int, k string, ts timestamp_ntz, v double").parquet(str(tmp_path / "in"))
    q = sh.stream_windows(src, "ts", "k", "v").writeStream.format("memory").queryName("win").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.key, r.n, r.total) for r in spark.table("win").collect()] == [("a", 3, 8.0)]
    q = sh.stream_distinct(src, "id", "ts").writeStream.format("memory").queryName("dist").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("dist").collect()) == [1, 2, 3]


def test_quantiles_with_ties_and_a_heavy_tail(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate([np.full(4000, 2.5), rng.pareto(0.4, 6000), -rng.pareto(0.3, 500), np.zeros(1500)])
    df = spark.createDataFrame(pd.DataFrame({"x": values})).unionByName(spark.createDataFrame([(None,), (float("nan"),)], "x double"))
    probs = [0.0, 0.01, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    want = np.quantile(values, probs)
    for most in (100_000, 50):
        assert order.exact_quantiles(df, F.col("x"), probs, most=most) == pytest.approx(want.tolist())
    assert order.exact_quantiles(df.limit(0), F.col("x"), [0.5]) == [None]
    assert order.exact_quantiles(df.where("x = 2.5"), F.col("x"), [0.1, 0.9], most=5) == [2.5, 2.5]


def test_best_model_and_column_model(spark):
    t = spark.createDataFrame([("a", 0.5), ("b", 0.7), ("c", 0.7), ("d", None)], "model string, auc double")
    best = lambda order, more: [r.model for r in models.mark_best(t, "auc", "model", order, more).where("is_best").collect()]
    assert best(["a", "c", "b", "d"], True) == ["c"] and best(["d", "c", "b", "a"], False) == ["a"]
    m = models.Expression("x").fit(spark.createDataFrame([(1.5,)], "x double"))
    assert m.score(spark.createDataFrame([(7, 1.5), (8, -1.0), (9, 0.25)], "i int, x double"), ["i"]).collect() == [(7, 1.0), (8, 0.0), (9, 0.25)]
    with pytest.raises(KeyError):
        models.Expression("nope").fit(t)


def test_stages_are_dropped_and_clusters_need_a_shared_folder(spark, monkeypatch):
    import os

    from tidemark import session

    keep = session.Stage(spark.range(3))
    with session.drop_stages():
        inner = session.Stage(spark.range(5))
        path = inner.path.removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.isdir(path) and keep.df.count() == 3

    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(type("Spark", (), {"sparkContext": Context()})())


def test_report_has_sections_and_figures(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setitem(report.PROJECTS, "Fraud", {"tables": {"weight": (txn_queries.pos_weight, "weight", True)}, "figures": report.PROJECTS["Fraud"]["figures"]})
    page = report.write_report(spark, sf, str(tmp_path), ("Fraud",)).read_text()
    assert "<section><h1>Fraud</h1>" in page and "<polyline" in page and "class='best'" in page
    assert "tables" in sinks.read_metrics(f"{tmp_path}/metrics.json")["Fraud"]
    assert sinks.svg_lines([], "a", "b") == "<p>no data</p>"


def test_sparse_dots():
    rng = np.random.default_rng(9)
    rows = [[{"k": int(k), "w": float(rng.normal())} for k in sorted(rng.choice(30, rng.integers(0, 12), replace=False))] if rng.random() < 0.8 else None for _ in range(80)]
    kind = pa.list_(pa.struct([("k", pa.int32()), ("w", pa.float64())]))
    a, b = pa.array(rows[:40], kind), pa.array(rows[40:], kind)
    want = [sum(x["w"] * y["w"] for x in p or [] for y in q or [] if x["k"] == y["k"]) for p, q in zip(rows[:40], rows[40:], strict=True)]
    assert textpairs.sparse_dots(a, b) == pytest.approx(want)
    assert textpairs.sparse_dots(a[3:20], b[3:20]) == pytest.approx(want[3:20])
    assert len(textpairs.sparse_dots(a[:0], b[:0])) == 0 and not textpairs.sparse_dots(pa.array([None], kind), b[:1]).any()
