"""Scalar expressions shared by the operators."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position within a period."""
    angle = x * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def bin_of(x: Column, inner_edges: Column | Sequence[float]) -> Column:
    """Number of inner edges that are not above ``x`` (bins closed on the left); null for a null ``x``."""
    edges = inner_edges if isinstance(inner_edges, Column) else F.array(*(F.lit(float(e)) for e in inner_edges))
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e <= x)))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def fixed(x: Column, digits: int = 5) -> Column:
    """Rounded for comparison; the small shift keeps decimal ties off the rounding edge, where systems differ."""
    return F.round(x + 3.3e-7, digits)


def display_label(name: Column, known: dict[str, str]) -> Column:
    """A display name: that of ``known``, else the name in title case with blanks for underscores."""
    plain = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    if not known:
        return plain
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), name), plain)


def holiday_lift(date: Column, table: Sequence[tuple[int, int, float, int]]) -> Column:
    """Multiplier of demand around holidays (month, day, lift, lead): the product of the holidays' own. A holiday's is its lift on
    its day, and rises (or falls) linearly towards it over ``lead`` days before, not below 0.2. Days are counted within the year."""
    out = F.lit(1.0)
    for month, day, lift, lead in table:
        gap = dt.date(2021, month, day).timetuple().tm_yday - F.dayofyear(date)
        ramp = F.greatest(1 + (lift - 1) * (lead + 1 - gap) / (lead + 1), F.lit(0.2))
        here = (F.month(date) == month) & (F.dayofmonth(date) == day)
        out = out * F.when(here, lift).otherwise(1.0) * F.when((gap > 0) & (gap <= lead), ramp).otherwise(1.0)
    return out


def corrupt(text: Column, kind: Column, at: Column) -> Column:
    """A slip in a text: 0 drops the character at ``at`` (texts of up to 12 characters are lower-cased instead), 1 doubles the
    first blank, 2 lower-cases, else unchanged."""
    dropped = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text)))
    long = F.length(text) > 12
    return F.when((kind == 0) & long, dropped).when(kind == 1, F.regexp_replace(text, "^([^ ]*) ", "$1  ")).when(kind.isin(0, 2), F.lower(text)).otherwise(text)
