"""Implicit alternating least squares with a fixed regularisation, and its objective."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.recommend import masked_top_k
from tidemark.session import Stage, require_columns

#: Factor values up to which one side is broadcast; rows up to which an id's rows are brought together rather than their sums;
#: rows of an id in one partition of the ratings; ids whose sums a task holds at once; users that are scored together.
MOST_BROADCAST, LIGHT, MOST_ROWS, MOST_OPEN, MOST_USERS = 2_000_000, 400, 100_000, 4000, 20_000


def _init(ids: DataFrame, factors: int, seed: int, scale: float = 0.01) -> DataFrame:
    """Normal start values from hashes (Box-Muller), the same on every run and partitioning."""
    unit = lambda j, s: (F.pmod(F.xxhash64("id", F.lit(j), F.lit(s)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    normal = [F.sqrt(-2 * F.log(unit(j, seed))) * F.cos(unit(j, seed + 1) * 2 * np.pi) * scale for j in range(factors)]
    return ids.select("id", F.array(*normal).alias("f"))


def gram(factors: DataFrame, size: int) -> np.ndarray:
    """Sum of the outer products of all factor rows: one size x size matrix per task, added on the driver."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((size, size))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["f"].to_numpy())
                g += x.T @ x
        yield pd.DataFrame({"g": [g.ravel()]})

    rows = factors.select("f").mapInPandas(part, "g array<double>").select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").collect()
    return np.array([r.v for r in rows]).reshape(size, size) if rows else np.zeros((size, size))


def _by(ratings: DataFrame, me: str, other: str) -> DataFrame:
    """id, o, r and n, the id's rows: written with an id's rows side by side, in several partitions only beyond ``MOST_ROWS``."""
    n = ratings.groupBy(me).agg(F.count("*").alias("n"))
    rows = ratings.join(n, me).select(F.col(me).alias("id"), F.col(other).alias("o"), "r", "n")
    return Stage(rows.repartition("id", F.pmod(F.xxhash64("o"), F.ceil(F.col("n") / MOST_ROWS))).sortWithinPartitions("id")).df


def _solve(ratings: DataFrame, fixed: DataFrame, size: int, reg: float, alpha: float) -> Stage:
    """Factors of the ids of ``ratings`` (id, o, r, n) given those of the o.

    A task adds up the normal equations of the rows it has. An id with all its n rows there is solved at once; the sums of
    the others (so an id with a third of all rows is shared by many tasks) are brought together by id and solved. A small
    ``fixed`` is broadcast to the rows as they lie; otherwise the rows of ids with few of them are brought together first.
    """
    base = gram(fixed, size) + reg * np.eye(size)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, list] = {}
        ids, sums = [], []

        def solved() -> pd.DataFrame:
            a = np.stack([x for x, _ in sums]) + base
            out = pd.DataFrame({"id": ids, "f": list(np.linalg.solve(a, np.stack([x for _, x in sums])[:, :, None])[:, :, 0]), "s": None})
            ids.clear(), sums.clear()
            return out

        def unsolved() -> pd.DataFrame:
            out = pd.DataFrame({"id": list(acc), "f": None, "s": [np.r_[a.ravel(), b] for _, a, b in acc.values()]})
            acc.clear()
            return out

        for pdf in batches:
            if not len(pdf):
                continue
            p = pdf.sort_values("id", kind="stable")
            y, r, own, n = np.stack(p["f"].to_numpy()), p["r"].to_numpy(float), p["id"].to_numpy(), p["n"].to_numpy()
            wy, wb = y * (alpha * r)[:, None], y * (1 + alpha * r)[:, None]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for lo, hi, b in zip(starts, [*starts[1:], len(p)], np.add.reduceat(wb, starts), strict=True):
                key, a, k = int(own[lo]), wy[lo:hi].T @ y[lo:hi], hi - lo
                if k < n[lo]:
                    before = acc.pop(key, (0, 0.0, 0.0))
                    k, a, b = k + before[0], a + before[1], b + before[2]
                if k == n[lo]:
                    ids.append(key)
                    sums.append((a, b))
                else:
                    acc[key] = [k, a, b]
            if len(ids) >= 500:
                yield solved()
            if len(acc) > MOST_OPEN:
                yield unsolved()
        if ids:
            yield solved()
        if acc:
            yield unsolved()

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total = None, np.zeros(size * size + size)

        def done(ids: list, sums: np.ndarray) -> pd.DataFrame:
            a = sums[:, : size * size].reshape(-1, size, size) + base
            return pd.DataFrame({"id": ids, "f": list(np.linalg.solve(a, sums[:, size * size :, None])[:, :, 0])})

        for pdf in batches:
            if not len(pdf):
                continue
            ids, s = pdf["id"].to_numpy(), np.stack(pdf["s"].to_numpy())
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            sums, keys = np.add.reduceat(s, starts), list(ids[starts])
            if last is not None:
                if keys[0] == last:
                    sums[0] += total
                else:
                    yield done([last], total[None])
            if len(keys) > 1:
                yield done(keys[:-1], sums[:-1])
            last, total = keys[-1], sums[-1]
        if last is not None:
            yield done([last], total[None])

    known = fixed.select(F.col("id").alias("o"), "f")
    if fixed.count() * size <= MOST_BROADCAST:
        rows = ratings.join(F.broadcast(known), "o").select("id", "r", "n", "f")
    else:
        joined = ratings.join(known.hint("merge"), "o").select("id", "r", "n", "f")
        rows = joined.where(F.col("n") <= LIGHT).repartition("id").sortWithinPartitions("id").unionAll(joined.where(F.col("n") > LIGHT))
    first = Stage(rows.mapInPandas(partial, "id bigint, f array<double>, s array<double>"))
    sums = first.df.where("s is not null").select("id", "s")
    rest = sums.repartition("id").sortWithinPartitions("id").mapInPandas(finish, "id bigint, f array<double>")
    out = Stage(first.df.where("f is not null").select("id", "f").unionAll(rest))
    first.drop()
    return out


def fit_als(train: DataFrame, size: int = 32, iterations: int = 15, reg: float = 60.0, alpha: float = 8.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """User and item factors (id, f): x = (Y'Y + reg I + sum alpha r y y')^-1 sum (1 + alpha r) y, users first, then items.

    ``train``: user_id, item_id, play_count, one row per pair. Each half step is written to the shared folder. Ids without a
    row have no factors. The built-in ALS scales the regularisation with an id's rows, which is another objective.
    """
    require_columns(train, "user_id", "item_id", "play_count")
    ratings = Stage(train.select("user_id", "item_id", F.col("play_count").cast("double").alias("r"))).df
    by_user, by_item = _by(ratings, "user_id", "item_id"), _by(ratings, "item_id", "user_id")
    items = Stage(_init(ratings.select(F.col("item_id").alias("id")).distinct(), size, seed))
    users: Stage | None = None
    for _ in range(iterations):
        new_users = _solve(by_user, items.df, size, reg, alpha)
        new_items = _solve(by_item, new_users.df, size, reg, alpha)
        for old in (users, items):
            if old:
                old.drop()
        users, items = new_users, new_items
    return users.df, items.df


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def als_objective(train: DataFrame, users: DataFrame, items: DataFrame, reg: float = 60.0, alpha: float = 8.0) -> float:
    """The objective over all cells, seen or not; the unseen ones through the trace of the product of the two Gram matrices."""
    size = len(items.first().f)
    gx, gy = gram(users, size), gram(items, size)
    rows = train.select("user_id", "item_id", F.col("play_count").cast("double").alias("r"))
    cells = rows.join(users.select(F.col("id").alias("user_id"), F.col("f").alias("x")), "user_id").join(items.select(F.col("id").alias("item_id"), F.col("f").alias("y")), "item_id")
    s, w = _dot("x", "y"), 1 + alpha * F.col("r")
    seen = cells.select((w * (1 - s) * (1 - s) - s * s).alias("l")).agg(F.coalesce(F.sum("l"), F.lit(0.0))).first()[0]
    return float(seen + np.trace(gx @ gy) + reg * (np.trace(gx) + np.trace(gy)))


def als_top_k(users: DataFrame, items: DataFrame, seen: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """user_id, rank, item_id, score: the ``k`` best unseen items by dot product.

    All users are scored against the items in blocks of ``block`` items (a stated query set against all rows): each task
    multiplies its users with one block at a time and keeps, of each block, k plus the number of the user's seen items.
    """
    n_seen = seen.groupBy("user_id").agg(F.count("*").alias("n"))
    left = users.select(F.col("id").alias("user_id"), "f").join(n_seen, "user_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n_blocks = max(1, -(-items.count() // block))
    blocks = items.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("b"), F.struct("id", "f").alias("e")).groupBy("b").agg(F.collect_list("e").alias("es"))
    work = left.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))

    def cogroup(us: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(us) and len(its):
            es = its["es"].iloc[0]
            ids, y = np.array([e["id"] for e in es], np.int64), np.array([e["f"] for e in es], float)
            for lo in range(0, len(us), 512):
                part = us.iloc[lo : lo + 512]
                s = np.stack(part["f"].to_numpy()) @ y.T
                keep = np.minimum(part["n"].to_numpy() + k, len(ids))
                order = np.argsort(-s, axis=1, kind="stable")
                row, place = np.nonzero(np.arange(len(ids)) < keep[:, None])
                top = order[row, place]
                out.append(pd.DataFrame({"user_id": part["user_id"].to_numpy()[row], "item_id": ids[top], "score": s[row, top]}))
        return pd.concat(out) if out else pd.DataFrame({"user_id": [], "item_id": [], "score": []})

    # so many users of a task stand against a block at once, however many there are
    salts = F.lit(-(-users.count() // MOST_USERS) or 1)
    salted = work.withColumn("salt", F.pmod(F.xxhash64("user_id"), salts))
    many = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts.cast("bigint") - 1)))
    scores = salted.groupBy("b", "salt").cogroup(many.groupBy("b", "salt")).applyInPandas(cogroup, "user_id bigint, item_id bigint, score double")
    return masked_top_k(scores, seen, k)
