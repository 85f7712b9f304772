"""Streaming counterparts of the history features (an extension: the batch operators are the measure)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import micros

_DAY_US, _HOUR_US = 86_400_000_000, 3_600_000_000


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, s, q, last, recent_t, recent_v = state.get if state.exists else (0, 0.0, 0.0, None, [], [])
    rows = pd.concat(list(batches)).sort_values(["t", "id"], kind="stable")
    t, v = rows["t"].to_numpy(np.int64), rows["v"].to_numpy(float)
    all_t, all_v = np.r_[np.array(recent_t, np.int64), t], np.r_[np.array(recent_v, float), v]
    order = np.argsort(all_t, kind="stable")
    all_t, total = all_t[order], np.r_[0.0, np.cumsum(all_v[order])]
    before = np.searchsorted(all_t, t, "left")
    day, hour = np.searchsorted(all_t, t - _DAY_US, "left"), np.searchsorted(all_t, t - _HOUR_US, "left")
    k = n + np.arange(len(t))
    cs, cq = s + np.r_[0.0, np.cumsum(v)[:-1]], q + np.r_[0.0, np.cumsum(v * v)[:-1]]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(k > 0, cs / k, np.nan)
        std = np.where(k > 1, np.sqrt(np.maximum(cq - cs * cs / k, 0) / (k - 1)), np.nan)
    prev = np.r_[np.nan if last is None else float(last), t[:-1].astype(float)]
    yield pd.DataFrame(
        {"entity": key[0], "id": rows["id"].to_numpy(), "prior_count": k, "prior_mean": mean, "prior_std": std, "minutes_since_prev": (t - prev) / 6e7,
         "count_1h": before - hour, "count_24h": before - day, "sum_24h": total[before] - total[day]}
    )
    keep = all_t >= t[-1] - _DAY_US
    state.update((int(n + len(t)), float(s + v.sum()), float(q + (v * v).sum()), int(t[-1]), all_t[keep].tolist(), all_v[order][keep].tolist()))


def stream_history(events: DataFrame, entity: str, ts: str, id: str, value: str) -> DataFrame:
    """Prior statistics and 1 h / 24 h windows of each event of a stream, from the events of earlier micro-batches and earlier rows.

    Events must arrive in time order per entity, up to their order within a micro-batch. State per entity: totals and the last
    day's events. Rows with a null entity, time or value are left out.
    """
    rows = events.select(F.col(entity).cast("bigint").alias("entity"), F.col(id).cast("bigint").alias("id"), micros(ts).alias("t"), F.col(value).cast("double").alias("v")).dropna()
    return rows.groupBy("entity").applyInPandasWithState(
        _step,
        "entity bigint, id bigint, prior_count bigint, prior_mean double, prior_std double, minutes_since_prev double, count_1h bigint, count_24h bigint, sum_24h double",
        "n bigint, s double, q double, last bigint, recent_t array<bigint>, recent_v array<double>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def stream_windows(events: DataFrame, ts: str, key: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums per key and time window; rows later than ``late`` behind the newest are dropped, as a watermark does."""
    e = events.select(F.col(ts).cast("timestamp").alias("ts"), F.col(key).alias("key"), F.col(value).alias("v")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", size, slide), "key").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "key", "n", "total")


def stream_distinct(events: DataFrame, id: str, ts: str, late: str = "2 hours") -> DataFrame:
    """Drops copies of an id that arrive within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([id])
