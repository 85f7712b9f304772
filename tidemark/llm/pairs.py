"""Groups of matching question records, and the check of a given split column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import min_label_components, same_text, star_components
from tidemark.session import Stage, require_columns


def split_name(c: str) -> Column:
    """A split name, trimmed and lower-cased; null and empty belong to no split."""
    s = F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    return F.when(s != "", s)


def _text_ids(df: DataFrame, record: str, a: str, b: str) -> DataFrame:
    """record, u, v: for each of the two texts its id, twice the smallest record that has the text, plus 1 if only as ``b``.

    So the smallest text id of a group of texts names the smallest record of the group: it is the half of it.
    """
    rows = df.select(F.col(record).cast("bigint").alias("r"), same_text(a).alias("h1"), same_text(b).alias("h2")).where("r is not null")
    half = lambda h, side: rows.select(F.col(h).alias("h"), F.shiftleft("r", 1).bitwiseOR(F.lit(side)).alias("t"))
    least = half("h1", 0).unionAll(half("h2", 1)).where("h is not null").groupBy("h").agg(F.min("t").alias("t"))
    for h, t in (("h1", "u"), ("h2", "v")):
        rows = rows.join(least.select(F.col("h").alias(h), F.col("t").alias(t)), h, "left")
    return rows.select("r", "u", "v")


def match_groups(df: DataFrame, record: str, a: str, b: str) -> DataFrame:
    """Consolidates matches: each record says that its texts ``a`` and ``b`` match. Output: record, group_id, n_records.

    Records belong to one group if they share a text, directly or through other records; ``group_id`` is the smallest record
    id of the group. Texts are equal if they are so after lower-casing, trimming and collapsing white space. The groups come
    from ``min_label_components`` over the texts.

    Defined cases: a record with one null text is linked by the other; with two it is a group alone; an empty text is a text
    like any other; null record ids are left out; repeated rows count once. Empty input: no rows.
    """
    require_columns(df, record, a, b)
    ids = Stage(_text_ids(df, record, a, b).distinct()).df
    comp = min_label_components(ids.select(F.coalesce("u", "v").alias("u"), F.coalesce("v", "u").alias("v")))
    own = ids.select("r", F.coalesce("u", "v").alias("node"))
    grouped = own.join(comp, "node", "left").select("r", F.coalesce(F.shiftright("component", 1), "r").alias("group_id"))
    sizes = grouped.groupBy("group_id").agg(F.countDistinct("r").alias("n_records"))
    return grouped.join(sizes, "group_id").select(F.col("r").alias(record), "group_id", "n_records").distinct()


def split_leaks(df: DataFrame, record: str, a: str, b: str, linked: Column, split: str) -> DataFrame:
    """Records with a split of which a text belongs to a group that occurs in several splits. Output: record, split.

    Texts are joined into groups by the records for which ``linked`` holds, by alternating large-star and small-star; any
    other text is a group alone. A group occurs in a split if a record of that split has one of its texts.

    Defined cases: null texts belong to no group; a null ``linked`` is no link; records without a split count for the links
    only; null record ids are left out.
    """
    require_columns(df, record, a, b, split)
    base = df.withColumn("__linked", F.coalesce(linked, F.lit(False)))
    ids = _text_ids(base, record, a, b)
    marks = base.select(F.col(record).cast("bigint").alias("r"), "__linked", split_name(split).alias("split"))
    rows = Stage(ids.join(marks, "r")).df
    comp = star_components(rows.where("__linked and u is not null and v is not null"))
    texts = rows.where("split is not null").select("r", "split", F.explode(F.array("u", "v")).alias("node")).where("node is not null")
    placed = texts.join(comp, "node", "left").select("r", "split", F.coalesce("component", "node").alias("g"))
    leaky = placed.groupBy("g").agg(F.min("split").alias("s1"), F.max("split").alias("s2")).where("s1 <> s2").select("g")
    return placed.join(leaky, "g", "left_semi").select(F.col("r").alias(record), "split").distinct()
