"""Token functions of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without topical content, in their usual order.
STOP_WORDS = (
    "a an the is are was were do does did i my me you your it its of to in on for with at by from how what why when where which who whom can could should "
    "would will shall there here that this these those and or but if then than as be been being have has had not no any some best easiest way ways get "
    "someone anyone"
).split()


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order; other letters part words. Null: null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content(toks: Column) -> Column:
    """Different tokens that aren't stop words."""
    return F.array_distinct(F.array_except(toks, F.array(*map(F.lit, STOP_WORDS))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def word_grams(text: Column) -> Column:
    """Words of two characters or more of the lower-cased text, and pairs of neighbouring ones joined by a blank."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    two = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.when(F.size(w) > 1, F.concat(w, two)).otherwise(w)


def char_grams(text: Column, least: int = 3, most: int = 5) -> Column:
    """Pieces of ``least`` to ``most`` characters within the words of the lower-cased text, each word with a blank on either side."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def pieces(w: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1)))
        return F.when(F.length(w) >= n, F.transform(at, lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.flatten(F.array(*(pieces(w, n) for n in range(least, most + 1))))))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal elements at the start of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    first = F.array_position(same, F.lit(False))
    return F.when(n == 0, 0).when(first == 0, n).otherwise((first - 1).cast("int"))
