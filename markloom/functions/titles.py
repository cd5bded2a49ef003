"""Title evidence: letter pairs and the numbers printed in a title."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom import constants as K


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is named (inside a lambda: for every element)."""
    return F.transform(F.array(value), use)[0]


def letter_pairs(normed: Column) -> Column:
    """Distinct character pairs with spaces removed; a single character stands for itself."""

    def pairs(t: Column) -> Column:
        size = F.length(t)
        each = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(size > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return once(F.regexp_replace(normed, f"[{K.WHITESPACE}]+", ""), pairs)


def title_numbers(normed: Column) -> Column:
    """Distinct integers of up to four digits; longer runs separate nothing and are left out."""
    runs = F.regexp_extract_all(normed, F.lit("[0-9]+"), F.lit(0))
    short = F.filter(runs, lambda r: F.length(r) <= K.MAX_TITLE_DIGITS)
    return F.array_distinct(F.transform(short, lambda r: r.cast("bigint")))


def dice(a: Column, b: Column) -> Column:
    def share(both: Column) -> Column:
        x, y = both["a"], both["b"]
        hit = F.size(F.array_intersect(x, y))
        return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * hit / (F.size(x) + F.size(y))).otherwise(F.lit(0.0))

    return once(F.struct(a.alias("a"), b.alias("b")), share)


def jaccard(a: Column, b: Column) -> Column:
    hit = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - hit
    return F.when((F.size(a) > 0) & (F.size(b) > 0), hit.cast("double") / union).otherwise(F.lit(0.0))


def blend(same: Column, letters: Column, shared: Column, na: Column, nb: Column) -> Column:
    """Score from letter-pair Dice, shared numbers and the two number-set sizes."""
    weighted = K.LETTER_WEIGHT * letters + K.NUMBER_WEIGHT * (shared.cast("double") / F.nullif(na + nb - shared, F.lit(0)))
    return (
        F.when(same, F.lit(1.0))
        .when((na == 0) | (nb == 0), letters)
        .when(shared == 0, F.lit(0.0))
        .otherwise(weighted)
    )


def title_score(a: Column, b: Column) -> Column:
    """Similarity of two normalised titles, 0-1."""
    da, db = title_numbers(a), title_numbers(b)
    shared = F.size(F.array_intersect(da, db))
    score = blend(a == b, dice(letter_pairs(a), letter_pairs(b)), shared, F.size(da), F.size(db))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(score)
