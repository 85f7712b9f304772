"""Filling containers of fixed capacity with items of varying length."""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import Stage, require_columns

#: Bytes of text looked at together; different lengths in a plan; shares of the capacity that a container may leave unused.
SLICE, MOST_LENGTHS, SLACKS = 1 << 20, 8192, (0, 1 / 64, 1 / 32, 1 / 16, 3 / 32, 1 / 8)


#: Classes of bytes: white space, A-Z a-z 0-9 and _, anything else (all bytes of characters outside ASCII).
_CLASS = np.full(256, 2, np.uint8)
_CLASS[list(b" \t\n\v\f\r")] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = 1


def count_runs(texts: pa.Array) -> np.ndarray:
    """Number of word-punctuation tokens of each text, many texts at once: places where the class of the bytes changes to one
    that isn't white space. Null: 0."""
    t = pc.fill_null(texts, "").cast(pa.large_binary())
    if not len(t):
        return np.zeros(0, np.int64)
    _, offsets, data = t.buffers()
    at = np.frombuffer(offsets, np.int64)[t.offset : t.offset + len(t) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    out, lo = np.zeros(len(t), np.int64), 0
    while lo < len(t):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, "right")) - 1)
        c = _CLASS[raw[at[lo] : at[hi]]]
        start = c != 0
        start[1:] &= c[1:] != c[:-1]
        first = at[lo:hi] - at[lo]
        inside = first < at[lo + 1 : hi + 1] - at[lo]
        start[first[inside]] = c[first[inside]] != 0  # a text begins anew whatever stands before it
        upto = np.concatenate([[0], np.cumsum(start)])
        out[lo:hi] = upto[at[lo + 1 : hi + 1] - at[lo]] - upto[first]
        lo = hi
    return out


def word_punct_tokens(text: Column | str) -> Column:
    """Number of word-punctuation tokens: runs of A-Z, a-z, 0-9 and _, or of other characters that aren't white space. Null: 0."""

    @F.arrow_udf("bigint")
    def count(t: pa.Array) -> pa.Array:
        return pa.array(count_runs(t))

    return count(F.col(text) if isinstance(text, str) else text)


def bpe_tokens(df: DataFrame, id: str, text: str, ranks_path: str) -> DataFrame:
    """id and n_tokens under a byte-pair tokenizer. The ranks file (base64 token and rank per line, a few MB) is read where the
    query is made and goes to the tasks with the job, so executors need not have it."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks_path).read_bytes().splitlines())}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        # fixed value: the public splitting pattern of this family of tokenizers
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["t"]]})

    out = df.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("t")).mapInPandas(count, "id bigint, n_tokens bigint")
    return out.withColumnRenamed("id", id)


def _choose(sizes: list[int], left: dict[int, int], room: int, slack: int) -> dict[int, int]:
    """The multiset of remaining lengths whose sum comes closest to ``room``, as uses per length; a sum that leaves at most
    ``slack`` is close enough, and the first that is found so has the longest lengths.

    Bit k of ``reach`` says that the sum k can be made. Lengths come in falling order, each with its remaining count in
    binary portions; the states passed through allow to trace back which portions were used.
    """
    mask, goal = (1 << (room + 1)) - 1, max(room - slack, 0)
    reach, trail = 1, []
    for size in sizes if goal else ():
        if size > room or not left[size]:
            continue
        n, portion = min(left[size], room // size), 1
        while n > 0:
            k = min(portion, n)
            after = (reach | (reach << (size * k))) & mask
            if after != reach:
                trail.append((size, k, reach))
                reach = after
            n -= k
            portion *= 2
        if reach >> goal:
            break
    at, uses = reach.bit_length() - 1, {}
    for size, k, before in reversed(trail):
        if not before >> at & 1:
            uses[size] = uses.get(size, 0) + k
            at -= size * k
    return uses


def minimum_slack_patterns(counts: dict[int, int], capacity: int, slack: int = 0) -> list[tuple[dict[int, int], int]]:
    """Fills containers for items counted by length; (uses per length, number of such containers) each.

    The longest remaining length opens a container; the rest of it is filled by the multiset of remaining lengths that comes
    closest to the room left, or within ``slack`` of it, and the pattern is repeated while its lengths last.
    """
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    sizes, out = sorted(left, reverse=True), []
    while sizes:
        top = sizes[0]
        left[top] -= 1
        uses = _choose(sizes, left, capacity - top, slack)
        left[top] += 1
        uses[top] = uses.get(top, 0) + 1
        times = min(left[s] // u for s, u in uses.items())
        for s, u in uses.items():
            left[s] -= u * times
        out.append((uses, times))
        if not all(left[s] for s in uses):
            sizes = [s for s in sizes if left[s] > 0]
    return out


def plan(spark: SparkSession, counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The minimum-slack plan with the fewest containers among those of ``SLACKS``, which are made side by side, one a task.

    Without any slack the short lengths are spent on early containers and the last ones stay half full; a little slack while
    long lengths are left saves them. Which slack is best depends on the lengths only, so all are tried on all inputs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"]:
                made = minimum_slack_patterns(counts, capacity, int(capacity * SLACKS[k]))
                yield pd.DataFrame({"k": [k], "n": [sum(t for _, t in made)], "plan": [pickle.dumps(made)]})

    tried = spark.range(0, len(SLACKS), 1, len(SLACKS)).mapInPandas(run, "k bigint, n bigint, plan binary")
    best = tried.orderBy("n", "k").first()
    return pickle.loads(best.plan)


def pack(lengths: DataFrame, id: str, n_tokens: str, capacity: int) -> DataFrame:
    """Assigns items to containers of ``capacity`` tokens with little room left over.

    Output: id, piece (from 0), first_token, tokens, container_id. An item is cut only if it is longer than a container:
    into full containers and one rest. One row per piece.

    Method: minimum bin slack on the counts of pieces by length (at most ``MOST_LENGTHS`` rows, whatever the data), by bitset
    subset sums with the counts traced back; a pattern is used as often as its lengths last, so the plan doesn't grow with
    the number of items. Several allowed slacks are tried and the plan of the fewest containers is kept (``plan``). For a
    capacity above ``MOST_LENGTHS`` the lengths are rounded up to a grid of capacity / ``MOST_LENGTHS`` tokens for the plan.
    The pieces of a length are numbered without bringing them together (numbers within hashed chunks, plus the chunks'
    running totals), and a number's place in the plan gives its container.

    Defined cases: an item of no tokens, or null, takes no room and gets one row with container_id null; ids may repeat
    (each row is an item of its own); a null id is kept. Empty input: no rows. Other columns are dropped.
    """
    require_columns(lengths, id, n_tokens)
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n = F.coalesce(F.col(n_tokens).cast("bigint"), F.lit(0))
    items = Stage(lengths.select(F.col(id).alias("id"), F.greatest(n, F.lit(0)).alias("n"), F.monotonically_increasing_id().alias("row"))).df
    cut = items.where("n > 0").select("id", "row", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {capacity}"))).alias("piece"))
    pieces = cut.select("id", "row", F.col("piece").cast("int").alias("piece"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size"))
    grid = -(-capacity // MOST_LENGTHS)
    whole = capacity // grid
    # a piece longer than all whole grid steps fills its container alone
    pieces = pieces.withColumn("unit", F.least(F.expr(f"(size - 1) div {grid} + 1"), F.lit(whole)).cast("int"))
    total = int(pieces.count())
    chunks = max(16, total // 200_000)
    pieces = pieces.withColumn("chunk", F.pmod(F.xxhash64("row", "piece"), F.lit(chunks)).cast("int"))
    cells = Stage(pieces.groupBy("unit", "chunk").agg(F.count("*").alias("n"))).df
    counts = {r.unit: int(r.n) for r in cells.groupBy("unit").agg(F.sum("n").alias("n")).collect()}
    ranges, base = [], 0
    used: dict[int, int] = dict.fromkeys(counts, 0)
    for uses, times in plan(lengths.sparkSession, counts, whole):
        for s, u in uses.items():
            ranges.append((s, used[s], u, base))
            used[s] += u * times
        base += times
    # (length, first number of the range): sorted, so a piece finds its range by bisection
    ranges.sort()
    p_unit, p_from, p_uses, p_base = (np.array(x, np.int64) for x in (zip(*ranges, strict=True) if ranges else ((), (), (), ())))
    key = p_unit * (total + 1) + p_from

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.searchsorted(key, pdf["unit"].to_numpy(np.int64) * (total + 1) + pdf["number"].to_numpy(np.int64), "right") - 1
            pdf["container_id"] = p_base[at] + (pdf["number"].to_numpy(np.int64) - p_from[at]) // p_uses[at]
            yield pdf[["id", "row", "piece", "size", "container_id"]]

    running = F.sum("n").over(Window.partitionBy("unit").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.select("unit", "chunk", F.coalesce(running, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("unit", "chunk").orderBy("row", "piece")) - 1
    numbered = pieces.withColumn("within", within).join(offsets, ["unit", "chunk"]).select("id", "row", "piece", "size", "unit", (F.col("within") + F.col("offset")).alias("number"))
    kind = items.schema["id"].dataType.simpleString()

    placed = numbered.withColumn("id", F.col("id").cast("string")).mapInPandas(place, "id string, row bigint, piece int, size int, container_id bigint")
    out = placed.select(
        F.col("id").cast(kind).alias(id), "piece", (F.col("piece").cast("bigint") * capacity).alias("first_token"), F.col("size").cast("bigint").alias("tokens"), "container_id"
    )
    none = items.where("n = 0").select(
        F.col("id").alias(id), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("bigint").alias("container_id")
    )
    return out.unionByName(none)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, least number of containers that could hold them, share of the room left unused."""
    each = packed.where("container_id is not null").agg(F.countDistinct("container_id").alias("n_containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"))
    return each.select(
        "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"),
        F.when(F.col("n_containers") > 0, 1 - F.col("n_tokens") / (F.col("n_containers") * capacity)).otherwise(0.0).alias("unused_share"),
    )


def packing_faults(packed: DataFrame, lengths: DataFrame, id: str, n_tokens: str, capacity: int, most_extra: float = 0.015) -> DataFrame:
    """One row that says whether a packing holds what it must: n_items, n_tokens and n_pieces placed; n_over (containers beyond
    the capacity), n_wrong (items of which a token is missing or placed twice, or which are cut although they fit), and is_tight
    (containers at most ``most_extra``, and one, above what the tokens need at least). Ids must be unique."""
    there = packed.where("container_id is not null")
    per = there.groupBy(id).agg(F.sum("tokens").alias("t"), F.count("*").alias("p"), F.countDistinct("first_token").alias("d"), F.max(F.col("first_token") + F.col("tokens")).alias("end"))
    items = lengths.where(F.col(n_tokens) > 0).select(F.col(id), F.col(n_tokens).cast("bigint").alias("n"))
    right = (F.col("t") == F.col("n")) & (F.col("p") == F.ceil(F.col("n") / capacity)) & (F.col("d") == F.col("p")) & (F.col("end") == F.col("n"))
    wrong = items.join(per, id, "full").agg(F.count(F.when(~F.coalesce(right, F.lit(False)), 1)).alias("n_wrong"))
    bins = there.groupBy("container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("p"))
    whole = bins.agg(F.count("*").alias("c"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pieces"), F.count(F.when(F.col("t") > capacity, 1)).alias("n_over"))
    tight = F.col("c") <= F.ceil(F.ceil(F.col("n_tokens") / capacity) * (1 + most_extra)) + 1
    return items.agg(F.count("*").alias("n_items")).join(F.broadcast(whole)).join(F.broadcast(wrong)).select("n_items", "n_tokens", "n_pieces", "n_over", "n_wrong", tight.alias("is_tight"))
