"""Range buckets of rows by an id and, where an id repeats very often or is missing, by a hash as well.

The bounds are quantiles of the id alone.  An id that several quantiles fall on holds several buckets' worth
of rows; these are parted further by even ranges of the hash, and so are the rows without an id, which come
first.  Only rows that agree in id and hash stay together at any number.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More buckets than this would make the list of bounds, which is part of the plan, too long; buckets grow instead.
MOST = 20_000
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _parts(key: int, count: int) -> list[tuple[int, int]]:
    """Bounds that part the hashes of one id into ``count`` ranges, the first of which begins at the lowest."""
    return [(key, _LOW + (i << 64) // count) for i in range(count)]


def bounds(df: DataFrame, key: str, rows_per_bucket: int, most: int = MOST) -> list[tuple[int, int]]:
    """Ascending bounds (id, hash) that part the rows into buckets of about ``rows_per_bucket`` rows, or into ``most`` larger ones."""
    n, known = df.agg(F.count(F.lit(1)), F.count(key)).first()
    k = min(-(-n // rows_per_bucket), most)
    if k < 2:
        return []
    out = _parts(_LOW, round(k * (n - known) / n))[1:]  # missing ids count as the lowest
    k = round(k * known / n)
    if k > 1:
        fractions = [i / k for i in range(1, k)]
        got = Counter(df.agg(F.percentile_approx(key, fractions, min(20 * k, 200_000))).first()[0])
        for value, count in got.items():
            out += [*_parts(value, count + 1), (value + 1, _LOW)] if count > 1 and value < _HIGH else [(value, _LOW)]
    return sorted(set(out))


def by_hash(ends: list[tuple[int, int]]) -> bool:
    """Whether some id is parted by its rows' hashes."""
    return any(h != _LOW for _, h in ends)


def mark(key: Column, hashed: Column) -> tuple[Column, Column]:
    """(id, hash) as numbers: a missing id counts as the lowest, before rows that have the lowest as their id."""
    low = F.lit(_LOW).cast("long")
    high = F.lit(_HIGH).cast("long")
    return F.coalesce(key, low), F.when(key.isNull(), F.least(hashed, F.lit(_HIGH - 1))).when(key == low, high).otherwise(hashed)


def bucket(key: Column, hashed: Column, ends: list[tuple[int, int]]) -> Column:
    """How many bounds are at or below the row, by binary search."""
    if not ends:
        return F.lit(0)
    steps = [1 << i for i in range(len(ends).bit_length() - 1, -1, -1)]
    ids, hashes = (F.expr("array(" + ", ".join("(-9223372036854775807L - 1L)" if x == _LOW else f"{x}L" for x in xs) + ")") for xs in zip(*ends, strict=True))
    own, place = mark(key, hashed)

    def below(at: Column) -> Column:
        bound = F.try_element_at(ids, at)
        return (bound < own) | ((bound == own) & (F.try_element_at(hashes, at) <= place))

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when((at + step <= len(ends)) & below(at + step), at + step).otherwise(at))
