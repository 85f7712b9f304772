"""Connected components of very large graphs, in two ways, and splits that keep components whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import Stage, require_columns

MOST_ROUNDS = 100


def min_label_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """The smallest node id that each node is linked with, directly or through others. Output: node, component.

    Method: every round each node takes the smallest label among itself and its neighbours (minimum propagated across the
    edges, combined before the shuffle), then labels follow their labels' labels (pointer jumping), and the edges are
    rewritten to the labels of their ends, which merges copies and drops edges within a group. Each round is written to the
    shared folder; it ends when no edge between different labels is left. The largest tables are joined with one row per
    node, so a hub's edges may be split by Spark's skew join at will.

    Defined cases: an edge with a null end is left out; a loop makes a node of its own; repeated edges count once. Empty
    input: no rows. Node ids must be orderable; other columns are ignored.
    """
    require_columns(edges, src, dst)
    base = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct()
    first = Stage(base)
    labels: Stage | None = None
    current = first
    for _ in range(MOST_ROUNDS):
        live = current.df.where("u <> v")
        both = live.select("u", "v").unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # a label's label twice over: each jump doubles the distance that a label travels
        one = Stage(step)
        jump = lambda t: t.alias("a").join(one.df.alias("b"), F.col("a.m") == F.col("b.u"), "left").select("a.u", F.coalesce("b.m", "a.m").alias("m"))
        hop = Stage(jump(jump(one.df)))
        to = hop.df
        moved = (
            current.df.where("u <> v").join(to.select("u", F.col("m").alias("mu")), "u").join(to.select(F.col("u").alias("v"), F.col("m").alias("mv")), "v")
            .where("mu <> mv").select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct()
        )
        if labels is None:
            nodes = current.df.select(F.col("u").alias("node")).unionAll(current.df.select(F.col("v").alias("node"))).distinct()
            relabelled = nodes.join(to.select(F.col("u").alias("node"), "m"), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
        else:
            relabelled = labels.df.join(to.select(F.col("u").alias("component"), "m"), "component", "left").select("node", F.coalesce("m", "component").alias("component"))
        after, rest = Stage(relabelled), Stage(moved)
        for old in (labels, current, one, hop):
            if old:
                old.drop()
        labels, current = after, rest
        if current.df.isEmpty():
            return labels.df
    raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")


def star_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """As ``min_label_components``, by alternating large-star and small-star. Output: node, component.

    Large-star links every larger neighbour of a node with the smallest node of its neighbourhood; small-star links a node
    and its smaller neighbours with the smallest of them. Both keep the components and no round adds edges beyond the
    number of nodes' links; when a round changes nothing, every node is linked with the smallest node of its component. Each
    round is written to the shared folder. Only the minimum of each neighbourhood is computed per node (combined before the
    shuffle); a neighbourhood itself is never collected.

    Defined cases: as in ``min_label_components``.
    """
    require_columns(edges, src, dst)
    given = Stage(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct())
    nodes = given.df.select(F.col("u").alias("node")).unionAll(given.df.select(F.col("v").alias("node"))).distinct()
    # kept as (larger, smaller)
    current = Stage(given.df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(current.df)
    for _ in range(MOST_ROUNDS):
        e = current.df
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = Stage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        own = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(own, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(own.select("u", F.col("m").alias("v")))
        after = Stage(small.distinct())
        current.drop()
        large.drop()
        current, before, mark = after, mark, _mark(after.df)
        if mark == before:
            return nodes.join(current.df.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
    raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")


def _mark(e: DataFrame) -> tuple:
    """Number of edges and two checksums that don't depend on their order."""
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(7)))).first())


def split_of(component: Column, shares: Sequence[tuple[str, float]] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)), seed: int = 0) -> Column:
    """The split of a component: its hash falls into one of the ranges that divide the hash values by ``shares``."""
    if abs(sum(s for _, s in shares) - 1) > 1e-9:
        raise ValueError("shares must add up to 1")
    at, edge, out = F.pmod(F.xxhash64(component, F.lit(seed)), F.lit(1_000_000)), 0.0, None
    for name, share in shares[:-1]:
        edge += share
        hit = at < F.lit(round(edge * 1_000_000))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(shares[-1][0]) if out is None else out.otherwise(shares[-1][0])


def assign_splits(df: DataFrame, record: str, entities: Sequence[str], shares=(("train", 0.8), ("validation", 0.1), ("test", 0.1)), seed: int = 0) -> DataFrame:
    """A split for each record such that records that share a value of any entity column, directly or through others, share it.

    Output: record, component (smallest record id), split.

    Method: records and entity values are the nodes of one graph; its components come from ``star_components``; the hash of
    the component id picks the split. The given shares are met up to the size of the components: one that holds most records
    puts them all into one split, which no assignment can avoid.

    Defined cases: values of different entity columns are one domain (equal values are the same entity); a null value links
    nothing; a record without any value is a component alone; null record ids are left out; repeated records get one row.
    """
    require_columns(df, record, *entities)
    base = df.select(F.col(record).cast("bigint").alias("r"), *(F.unhex(F.md5(F.col(c).cast("string"))).alias(f"h{k}") for k, c in enumerate(entities))).where("r is not null")
    ids = entity_ids(base, "r", [f"h{k}" for k in range(len(entities))])
    parts = [ids.select("r", F.coalesce(F.col(f"h{k}"), "r").alias("t")) for k in range(len(entities))]
    links = parts[0]
    for p in parts[1:]:
        links = links.unionAll(p)
    comp = star_components(links, "r", "t")
    out = base.select("r").distinct().join(comp.withColumnRenamed("node", "r"), "r")
    return out.select(F.col("r").alias(record), "component", split_of(F.col("component"), shares, seed).alias("split"))


def entity_ids(df: DataFrame, record: str, hashes: Sequence[str]) -> DataFrame:
    """Replaces each hash column by the smallest record id that has the same hash in any of the columns (null stays null)."""
    rows = df.select(record, *hashes)
    long = rows.select(F.col(record).alias("r"), F.explode(F.array(*hashes)).alias("h")).where("h is not null")
    least = long.groupBy("h").agg(F.min("r").alias("id"))
    for c in hashes:
        rows = rows.join(least.select(F.col("h").alias(c), F.col("id").alias(f"id_{c}")), c, "left")
    return rows.select(record, *(F.col(f"id_{c}").alias(c) for c in hashes))


def same_text(c: str) -> Column:
    """A text lower-cased, trimmed and with white space collapsed, as a 16-byte digest."""
    return F.unhex(F.md5(clean_text(c)))


def clean_text(c: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), "^ | $", "")
