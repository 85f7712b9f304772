"""Products of a sparse matrix with itself: sums over common groups for every pair of items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import Stage, require_columns

#: Items along a side of a tile; rows of a pair of tiles that are added up together.
TILE, ROWS = 1000, 200_000


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring groups of about ``most`` in sum."""
    upto, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _add_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the outer products of the groups' value vectors in a dense tile; gives the non-zero cells of each tile once."""
    tile, m = None, None

    def flush() -> pd.DataFrame:
        i, j = np.nonzero(m)
        return pd.DataFrame({"ta": tile[0], "ia": i, "tb": tile[1], "ib": j, "v": m[i, j]})

    for pdf in batches:
        for key, part in pdf.groupby(["ta", "tb"], sort=False):
            if key != tile:
                if tile is not None:
                    yield flush()
                n = int(max(part["na"].max(), part["nb"].max()))
                tile, m = key, np.zeros((n, n))
            na, nb = (part[c].map(len).to_numpy() for c in ("a", "b"))
            for lo, hi in _runs(na * nb, 4_000_000):
                p, a_len, b_len = part.iloc[lo:hi], na[lo:hi], nb[lo:hi]
                a, x, b, y = (np.concatenate(p[c].to_list()) for c in ("a", "x", "b", "y"))
                # every place of a meets all places of b of its own group
                times = np.repeat(b_len, a_len)
                first = np.repeat(np.cumsum(b_len) - b_len, a_len)
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
                side = m.shape[1]
                cells = np.repeat(a.astype(np.int64), times) * side + b[at]
                m += np.bincount(cells, np.repeat(x, times) * y[at], m.size).reshape(m.shape)
    if tile is not None:
        yield flush()


def item_products(df: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """src, dst, product: for items with a common group, the sum over groups of value(src) * value(dst); both orders and src = dst.

    (group, item) must be unique and without nulls. Items are numbered in tiles of bounded side by hash; a group's values are
    gathered per tile, so at most TILE or so at once; each task adds its groups up in the tile's matrix before anything is
    shuffled, so no list of pairs is emitted, whatever the size of a group.
    """
    require_columns(df, group, item, value)
    rows = Stage(df.select(F.col(group).alias("g"), F.col(item).alias("item"), F.col(value).cast("double").alias("v"))).df
    n_items = rows.select("item").distinct().count()
    tiles = max(1, -(-n_items // TILE))
    numbered = rows.select("item").distinct().withColumn("t", F.pmod(F.xxhash64("item"), F.lit(tiles)).cast("int"))
    numbered = Stage(numbered.withColumn("p", (F.row_number().over(Window.partitionBy("t").orderBy("item")) - 1).cast("int"))).df
    sides = numbered.groupBy("t").agg((F.max("p") + 1).alias("n"))
    named = rows.join(numbered, "item")
    pieces = Stage(named.groupBy("g", "t").agg(F.collect_list(F.struct("p", "v")).alias("l")).join(F.broadcast(sides), "t").select("g", "t", "n", "l.p", "l.v")).df
    # every piece goes to the pairs of its tile with the group's tiles, row by row: the pieces of a large group never stand in
    # one task, and meet again by (group, pair of tiles)
    tiles_of = pieces.groupBy("g").agg(F.collect_set("t").alias("ts"))
    sent = pieces.join(tiles_of, "g").select("g", F.explode("ts").alias("o"), "t", F.struct("n", "p", "v").alias("l"))
    sent = sent.select("g", F.least("t", "o").alias("ta"), F.greatest("t", "o").alias("tb"), "t", "l")
    met = sent.groupBy("g", "ta", "tb").agg(F.max(F.when(F.col("t") == F.col("ta"), F.col("l"))).alias("x"), F.max(F.when(F.col("t") == F.col("tb"), F.col("l"))).alias("y"))
    # a pair of tiles has at most one row per group, so this bounds the rows that a task adds up together
    salts = -(-rows.select("g").distinct().count() // ROWS) or 1
    work = met.withColumn("salt", F.pmod(F.xxhash64("g"), F.lit(salts))).repartition("ta", "tb", "salt").sortWithinPartitions("ta", "tb")
    work = work.select("ta", "tb", F.col("x.n").alias("na"), F.col("x.p").alias("a"), F.col("x.v").alias("x"), F.col("y.n").alias("nb"), F.col("y.p").alias("b"), F.col("y.v").alias("y"))
    sums = work.mapInPandas(_add_tiles, "ta int, ia int, tb int, ib int, v double").groupBy("ta", "ia", "tb", "ib").agg(F.sum("v").alias("v"))
    half = sums.unionAll(sums.where("ta < tb").select("tb", "ib", "ta", "ia", "v"))
    name = lambda s: numbered.select(F.col("t").alias(f"t{s}"), F.col("p").alias(f"i{s}"), F.col("item").alias("src" if s == "a" else "dst"))
    return half.join(name("a"), ["ta", "ia"]).join(name("b"), ["tb", "ib"]).select("src", "dst", F.col("v").alias("product"))
