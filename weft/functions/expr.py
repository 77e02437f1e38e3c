"""Column functions that the operators share; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_rank(namespace: str, *keys: str | Column) -> Column:
    """A number below 2^60 from the SHA-256 of ``namespace:key:...``: the order of every hashed sample."""
    parts = [F.lit(namespace), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 15), 16, 10).cast("long")


def hash_rank_sql(namespace: str, *keys: str) -> str:
    """The same number in DuckDB's SQL."""
    return f"('0x' || substr(sha256(concat_ws(':', '{namespace}', {', '.join(keys)})), 1, 15))::BIGINT"


def rank_unit(rank: Column) -> Column:
    """A hash rank as a number in (0, 1)."""
    return (rank + F.lit(1.0)) / F.lit(float((1 << 60) + 1))


def r6(value: Column) -> Column:
    """Rounded to six decimals, with no negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole in double precision, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it for every element of an array."""
    return F.transform(F.array(value), body)[0]


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def regexp_groups(text: Column, pattern: str, groups: int) -> Column:
    """All matches of a pattern, in order, as an array of arrays of its groups."""
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(every, lambda m: F.array(*[F.regexp_extract(m, pattern, g) for g in range(1, groups + 1)]))


def first_match(text: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """The first pattern, in order of priority, that matches: its group; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def char_grams(text: Column, n: int) -> Column:
    """Distinct character n-grams of a text in order of first place; none below n characters.

    A look-ahead match at every place: linear in the text, where substrings by place are not.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets held in arrays; 0 for two empty ones."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def set_prf(pred: Column, gold: Column, both_empty: float = 0.0) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two sets; ``both_empty`` is the value where neither has a member."""
    hit, p, g = F.size(F.array_intersect(pred, gold)), F.size(F.array_distinct(pred)), F.size(F.array_distinct(gold))
    empty = (p == 0) & (g == 0)
    rate = lambda part, whole: F.when(empty, F.lit(both_empty)).otherwise(ratio(part, whole))
    return rate(hit, p), rate(hit, g), rate(2 * hit, p + g)


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    odd = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, x.isNull() != y.isNull())), True)
    return F.when(odd > 0, odd - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def is_subsequence(short: Column, whole: Column) -> Column:
    """Whether all of ``short`` appears in ``whole`` in order: one fold with a pointer."""
    matched = F.aggregate(whole, F.lit(0), lambda at, x: F.when((at < F.size(short)) & (F.try_element_at(short, at + 1) == x), at + 1).otherwise(at))
    return matched == F.size(short)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short arrays: the row-by-row recurrence as folds."""
    zero = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))

    def row(previous: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            F.array(F.lit(0)),
            lambda done, j: F.concat(done, F.array(F.when(F.element_at(b, j) == x, F.element_at(previous, j) + 1).otherwise(F.greatest(F.element_at(previous, j + 1), F.element_at(done, j))))),
        )

    full = F.aggregate(a, zero, row, lambda done: F.element_at(done, -1))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(full)
