"""Rolling totals, per-key statistics, hot-key joins, running totals and quantiles against brute force, with dirty input."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import order
from tidemark.operators.rolling import rolling_totals
from tidemark.operators.skew import per_key_stats, split_hot_join

A, B = dt.date(2024, 1, 1), dt.date(2024, 2, 20)


def test_rolling_totals_brute_force(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"e{rng.randrange(5)}", A + dt.timedelta(days=rng.randrange(-40, 60)), rng.choice([None, 1, 5, -2])) for _ in range(400)]
    rows += [(None, A, 1), ("e1", None, 1), ("quiet", A, None)]
    df = spark.createDataFrame(rows, "ent string, day date, v int").selectExpr("ent", "day", "v", "1 as e", "2 as x", "3 as t7")
    got = {(r.ent, r.day): (r.total_7d, r.total_30d, r.avg_7d) for r in rolling_totals(df, "ent", "day", "v", A, B).collect()}
    ents = {e for e, d, _ in rows if e and d}
    days = [A + dt.timedelta(days=k) for k in range((B - A).days + 1)]
    assert len(got) == len(ents) * len(days)
    for e in ents:
        for d in days:
            t = [sum(v or 0 for x, y, v in rows if x == e and y and 0 <= (d - y).days < w) for w in (7, 30)]
            assert got[e, d] == (t[0], t[1], t[0] / 7)


def test_rolling_totals_empty_and_errors(spark):
    df = spark.createDataFrame([], "ent string, day date, v int")
    assert rolling_totals(df, "ent", "day", "v", A, B).count() == 0
    with pytest.raises(ValueError):
        rolling_totals(df, "ent", "day", "v", B, A)
    with pytest.raises(ValueError):
        rolling_totals(df, "ent", "day", "v", A, B, (0,))
    with pytest.raises(KeyError):
        rolling_totals(df, "no", "day", "v", A, B)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_per_key_stats_brute_force(spark, kind):
    rng = np.random.default_rng(2)
    n = 5000
    key = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 60, n)).astype(object)
    key[rng.random(n) < 0.05] = None
    t = rng.integers(0, 10**9, n).astype(object)
    t[rng.random(n) < 0.05] = None
    v = rng.integers(0, 9, n).astype(object)
    v[rng.random(n) < 0.1] = None
    rows = [(k if k is None or kind == "bigint" else f"k{k}", a, b) for k, a, b in zip(key.tolist(), t.tolist(), v.tolist(), strict=True)]
    df = spark.createDataFrame(rows, f"key {kind}, t bigint, v bigint").selectExpr("key", "t", "v", "1 as n", "2 as k", "true as isnull").repartition(6)
    got = {r.key: tuple(r)[1:] for r in per_key_stats(df, "key", "t", "v").collect()}
    want: dict = {}
    for k, a, b in rows:
        want.setdefault(k, []).append((a, b))
    assert set(got) == set(want)
    for k, xs in want.items():
        ts = sorted(a for a, _ in xs if a is not None)
        gap = max((b - a for a, b in zip(ts, ts[1:])), default=0)
        vs = [b for _, b in xs if b is not None]
        assert got[k] == (len(xs), len(vs), float(sum(vs)), ts[0] if ts else None, ts[-1] if ts else None, gap), k


def test_per_key_stats_cuts_the_hot_key(spark):
    """No partition may hold a large part of the rows, although one key does."""
    df = spark.range(40_000).selectExpr("if(id % 10 < 6, 1, id) as k", "id as t", "1 as v")
    sizes = df.repartitionByRange(8, "k", "t").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 12_000
    r = per_key_stats(df, "k", "t", "v").where("k = 1").first()
    assert (r.n_rows, r.total, r.max_gap_us) == (24_000, 24_000.0, 5)


def test_per_key_stats_empty(spark):
    assert per_key_stats(spark.createDataFrame([], "k bigint, t timestamp_ntz, v int"), "k", "t", "v").count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_split_hot_join(spark, how):
    big = spark.range(3000).selectExpr("case when id % 3 = 0 then 1 when id % 50 = 0 then null else id end as k", "id")
    small = spark.range(2000).selectExpr("id as k", "id * 2 as w")
    got = split_hot_join(big, small, "k", how, most=20)
    want = big.join(small, "k", how)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 2, 2, 3]), rng.choice([None, 1, 4])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, s int, v int").repartition(5)
    got = {r.id: (r.rank, r.tot) for r in order.running_totals(df, [F.desc("s"), F.asc("id")], {"rank": F.lit(1), "tot": F.col("v")}).collect()}
    total = 0
    for k, (i, _, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += v or 0
        assert got[i] == (k, total)
    assert order.running_totals(df.limit(0), [F.asc("id")], {"rank": F.lit(1)}).count() == 0


def test_exact_quantiles(spark):
    x = np.r_[np.random.default_rng(4).lognormal(0, 3, 3000), np.zeros(1500), [1e12]]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).union(spark.createDataFrame([(None,), (float("nan"),)], "x double"))
    ps = [0, 0.01, 0.3, 0.5, 0.777, 0.99, 1]
    assert np.allclose(order.exact_quantiles(df, F.col("x"), ps, cells=50, most=40), np.quantile(x, ps), rtol=1e-12)
    assert order.exact_quantiles(df.limit(0), F.col("x"), [0.5]) == [None]
