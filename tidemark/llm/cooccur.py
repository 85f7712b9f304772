"""Items that appear together: exact pair counts, and how surprising they are."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import split_hot_join
from tidemark.session import Stage, require_columns

#: Items in a tile side; items up to which the item numbers are broadcast; steps of -ln p in which discoveries are counted;
#: rows of a pair of tiles that are counted together.
TILE, MOST_BROADCAST, P_STEP, ROWS = 1500, 500_000, 1 / 64, 200_000


def _bins(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of like degree: exact up to 200, then half a per cent wide, so their number is bounded by the degrees' logarithm."""
    cell = np.where(values <= 200, values, 200 + np.floor(np.log(np.maximum(values, 200) / 200) / 0.005)).astype(np.int64)
    _, at = np.unique(cell, return_inverse=True)
    n = np.bincount(at, weights=counts)
    return np.bincount(at, weights=counts * values) / n, n


def fit_null(item_deg: np.ndarray, item_n: np.ndarray, size: np.ndarray, size_n: np.ndarray, rounds: int = 2000, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """x of each item class and y of each basket class so that P(item in basket) = xy / (1 + xy) gives every item its expected
    number of baskets and every basket its expected number of items (bipartite configuration model)."""
    total = float((item_deg * item_n).sum())
    if total <= 0:
        return np.zeros(len(item_deg)), np.zeros(len(size))
    x, y = item_deg / math.sqrt(total), size / math.sqrt(total)
    for _ in range(rounds):
        nx = item_deg / ((size_n * y) / (1 + np.outer(x, y))).sum(1)
        ny = size / ((item_n * nx)[:, None] / (1 + np.outer(nx, y))).sum(0)
        # an item in every basket, or a basket with every item, has no finite solution
        nx, ny = np.minimum(nx, 1e12), np.minimum(ny, 1e12)
        change = max(np.abs(nx / x - 1).max(), np.abs(ny / y - 1).max())
        x, y = nx, ny
        if change < tol:
            break
    return x, y


def poisson_binomial_log_tail(n: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """ln P(X >= n) for X the number of successes in ``m[s]`` trials of probability ``q[:, s]`` each: the saddlepoint
    approximation of the Poisson-binomial tail with lattice correction (Lugannani and Rice)."""
    n = n.astype(float)
    q = np.clip(q, 1e-300, 1 - 1e-12)
    mean, most = (q * m).sum(1), m.sum()
    target = np.minimum(n, most - 0.5)
    t = np.log(np.maximum(target, 1e-9) / np.maximum(mean, 1e-300))
    for _ in range(60):
        e = q * np.exp(np.clip(t, -700, 700))[:, None]
        p = e / (1 - q + e)
        step = ((p * m).sum(1) - target) / np.maximum((p * (1 - p) * m).sum(1), 1e-300)
        t = np.clip(t - np.clip(step, -2, 2), -690, 690)
        if np.abs(step).max(initial=0) < 1e-10:
            break
    e = q * np.exp(t)[:, None]
    p = e / (1 - q + e)
    k = (m * np.log1p(q * np.expm1(t)[:, None])).sum(1)
    var = np.maximum((p * (1 - p) * m).sum(1), 1e-300)
    w = np.sign(t) * np.sqrt(np.maximum(2 * (t * target - k), 0))
    u = -np.expm1(-t) * np.sqrt(var)
    out = np.empty(len(n))
    for i in range(len(n)):
        if abs(t[i]) < 1e-4 or abs(w[i]) < 1e-4:  # at the mean: the normal tail with continuity correction
            z = (n[i] - 0.5 - mean[i]) / math.sqrt(max((q[i] * (1 - q[i]) * m).sum(), 1e-300))
            out[i] = math.log(max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300))
        elif w[i] > 6:
            tail = 1 / u[i] - 1 / w[i] ** 3 + 3 / w[i] ** 5
            out[i] = -(w[i] ** 2) / 2 - 0.5 * math.log(2 * math.pi) + math.log(max(tail, 1e-300))
        else:
            phi = math.exp(-(w[i] ** 2) / 2) / math.sqrt(2 * math.pi)
            out[i] = math.log(min(max(0.5 * math.erfc(w[i] / math.sqrt(2)) + phi * (1 / u[i] - 1 / w[i]), 1e-300), 1))
    return out


def _count_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pair counts of a task, tile by tile. A row holds a basket's item numbers in two tiles, as 16-bit places."""
    tile, m = None, None

    def flush() -> pd.DataFrame:
        i, j = np.nonzero(m)
        return pd.DataFrame({"ta": tile[0], "ia": i, "tb": tile[1], "ib": j, "n": m[i, j]})

    for pdf in batches:
        for key, part in pdf.groupby(["ta", "tb"], sort=False):
            if key != tile:
                if tile is not None:
                    yield flush()
                tile, m = key, np.zeros((64, 64), np.int64)
            la, lb = part["a"].tolist(), part["b"].tolist()
            top = 1 + max(max(int(x.max()) for x in la), max(int(x.max()) for x in lb))
            if top > len(m):
                m = np.pad(m, (0, max(top, 2 * len(m)) - len(m)))
            side, inside = len(m), tile[0] == tile[1]
            sizes = np.array([len(x) for x in la])
            for k in np.unique(sizes) if inside else ():
                if 2 <= k <= 64:
                    rows = np.sort(np.stack([la[i] for i in np.flatnonzero(sizes == k)]), axis=1)
                    i, j = np.triu_indices(k, 1)
                    for lo in range(0, len(rows), max(1, 4_000_000 // len(i))):
                        r = rows[lo : lo + max(1, 4_000_000 // len(i))]
                        m += np.bincount((r[:, i] * side + r[:, j]).ravel(), minlength=side * side).reshape(side, side)
            for x, y in zip(la, lb, strict=True):
                if not inside:
                    m[np.ix_(x, y)] += 1
                elif len(x) > 64:
                    x = np.sort(x)
                    m[np.ix_(x, x)] += np.triu(np.ones((len(x), len(x)), np.int64), 1)
    if tile is not None:
        yield flush()


def co_occurrence(df: DataFrame, basket: Sequence[str], item: str, min_count: int = 5, min_share: Fraction = Fraction(0), alpha: float = 0.05) -> DataFrame:
    """Pairs of items that stand together in at least ``min_count`` baskets and in at least ``min_share`` of all baskets.

    Output: item_a < item_b, n_a, n_b, n_ab, n_baskets, ratio (n_ab over what independence gives), expected (under the null
    below), ln_p (of n_ab or more), significant (at false-discovery rate ``alpha``).

    Method. Baskets are reduced to their different items. An item in fewer baskets than a pair must have cannot be in a
    pair, so only the others are numbered, in tiles of a bounded side. A basket's items are gathered by tile, and each such piece is
    sent to the pairs of tiles that it is part of. Each task counts the pairs of its baskets in a tile's
    matrix, so pairs are added up before anything is shuffled and no list of pairs is ever emitted. The null is the bipartite
    configuration model fitted to the items' frequencies and the basket sizes (by classes of like degree); the surprise is
    the upper tail of the Poisson-binomial count under it, by saddlepoint (an exact sum over billions of baskets isn't
    practicable). Discoveries: the step-up rule over all pairs of numbered items, at steps of 1/64 in ln p, on the safe side.

    Defined cases: rows with a null item or basket column are left out; repeated items in a basket count once; baskets of
    one item count for ``n_baskets``. Empty input: no rows. Other columns are ignored.
    """
    require_columns(df, item, *basket)
    spark = df.sparkSession
    b = [f"b{k}" for k in range(len(basket))]
    entries = Stage(df.select(*(F.col(c).alias(n) for c, n in zip(basket, b, strict=True)), F.col(item).alias("item")).dropna().distinct()).df
    degrees = Stage(entries.groupBy("item").agg(F.count("*").alias("n"))).df
    # the different degrees of a graph with E edges are fewer than sqrt(2 E), so these two tables are small for any input
    item_hist = degrees.groupBy("n").agg(F.count("*").alias("c")).toPandas().sort_values("n")
    size_hist = entries.groupBy(*b).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c")).toPandas().sort_values("n")
    n_baskets = int(size_hist["c"].sum())
    least = max(min_count, math.ceil(min_share * n_baskets), 1)
    deg, deg_n = _bins(item_hist["n"].to_numpy(float), item_hist["c"].to_numpy(float)) if len(item_hist) else (np.ones(1), np.zeros(1))
    size, size_n = _bins(size_hist["n"].to_numpy(float), size_hist["c"].to_numpy(float)) if len(size_hist) else (np.ones(1), np.zeros(1))
    x, y = fit_null(deg, deg_n, size, size_n)

    frequent = degrees.where(F.col("n") >= least)
    n_frequent = int(item_hist.loc[item_hist["n"] >= least, "c"].sum())
    tiles = max(1, math.ceil(n_frequent / TILE))
    numbered = frequent.withColumn("tile", F.pmod(F.xxhash64("item"), F.lit(tiles)).cast("int")).withColumn(
        "place", F.row_number().over(Window.partitionBy("tile").orderBy("item")) - 1
    )
    numbered = Stage(numbered).df
    names = numbered.select("item", "tile", "place")
    kept = entries.join(F.broadcast(names), "item") if n_frequent <= MOST_BROADCAST else split_hot_join(entries, names, "item", "inner")
    pieces = Stage(kept.groupBy(*b, "tile").agg(F.collect_list("place").alias("a"))).df
    # every piece goes to the pairs of its tile with the basket's tiles, row by row: the pieces of a large basket never stand
    # in one task, and meet again by (basket, pair of tiles)
    tiles_of = pieces.groupBy(*b).agg(F.collect_set("tile").alias("ts"))
    sent = pieces.join(tiles_of, b).select(*b, "tile", "a", F.explode("ts").alias("other"))
    sent = sent.select(*b, F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile", "a")
    met = sent.groupBy(*b, "ta", "tb").agg(F.max(F.when(F.col("tile") == F.col("ta"), F.col("a"))).alias("a"), F.max(F.when(F.col("tile") == F.col("tb"), F.col("a"))).alias("b"))
    work = met.where("ta < tb or size(a) > 1")
    # a pair of tiles has at most one row per basket, so this bounds the rows that a task counts together
    salts = -(-n_baskets // ROWS) or 1
    work = work.withColumn("salt", F.pmod(F.xxhash64(*b), F.lit(salts))).repartition("ta", "tb", "salt").sortWithinPartitions("ta", "tb").select("ta", "tb", "a", "b")
    counts = (
        work.mapInPandas(_count_tiles, "ta int, ia int, tb int, ib int, n bigint")
        .groupBy("ta", "ia", "tb", "ib").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    )
    named = lambda s: numbered.select(F.col("tile").alias(f"t{s}"), F.col("place").alias(f"i{s}"), F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"))
    pairs = counts.join(named("a"), ["ta", "ia"]).join(named("b"), ["tb", "ib"])
    lower = F.col("item_a") < F.col("item_b")
    pairs = pairs.select(
        F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"),
        F.when(lower, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(lower, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"), F.col("n").alias("n_ab"),
    )

    log_deg, log_x = np.log(deg), np.log(np.maximum(x, 1e-300))

    def surprise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000].copy()
                pa, pb = (np.exp(np.interp(np.log(part[c].to_numpy(float)), log_deg, log_x))[:, None] * y for c in ("n_a", "n_b"))
                q = pa / (1 + pa) * (pb / (1 + pb))
                part["expected"] = (q * size_n).sum(1)
                part["ln_p"] = poisson_binomial_log_tail(part["n_ab"].to_numpy(), q, size_n)
                yield part

    kind = df.schema[item].dataType.simpleString()
    scored = Stage(pairs.mapInPandas(surprise, f"item_a {kind}, item_b {kind}, n_a bigint, n_b bigint, n_ab bigint, expected double, ln_p double")).df
    tests = max(n_frequent * (n_frequent - 1) // 2, 1)
    cell = F.ceil(F.greatest(F.col("ln_p"), F.lit(-700.0)) / P_STEP)  # the upper end of the step
    steps = scored.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
    cut = steps.where(F.col("cell") * P_STEP <= F.log(F.lit(alpha) * F.col("upto") / tests)).agg(F.max("cell")).first()[0]
    ratio = F.col("n_ab").cast("double") * n_baskets / (F.col("n_a").cast("double") * F.col("n_b"))
    return scored.select(
        "item_a", "item_b", "n_a", "n_b", "n_ab", F.lit(n_baskets).cast("bigint").alias("n_baskets"), ratio.alias("ratio"), "expected", "ln_p",
        F.lit(False).alias("significant") if cut is None else (cell <= cut).alias("significant"),
    )
