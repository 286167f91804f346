"""Vector functions as column expressions.

Vectors are arrays of float or double; all arithmetic is in double and in array
order, so results don't depend on partitioning. A null vector gives null. Two
vectors of different length are compared over their common prefix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def vec(v: Column | str) -> Column:
    """The vector in double."""
    return col(v).cast("array<double>")


def checked(v: Column | str, dims: int | None = None) -> Column:
    """The vector in double; an empty one, or one of another length than ``dims``, fails the query. Null stays null."""
    v = vec(v)
    wrong = F.size(v) == 0 if dims is None else F.size(v) != dims
    fault = F.concat(F.lit(f"a vector must have {dims or 'some'} members, not "), F.size(v).cast("string"))
    return F.when(v.isNotNull() & wrong, F.raise_error(fault).cast("array<double>")).otherwise(v)


def total(v: Column) -> Column:
    """Sum in array order; nulls count as nothing."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def clamp01(x: Column) -> Column:
    """x held to 0..1; null stays null (greatest and least would pass over it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product over the common prefix."""
    return total(F.zip_with(vec(a), vec(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(vec(v), lambda x: x * x)))


def normalize(v: Column | str) -> Column:
    """The unit vector; a zero vector stays zero."""
    v = vec(v)
    # the norm is made a one-element array first, so it is worked out once and not for each member
    return F.flatten(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine over the common prefix, norms too; 0 where a norm is 0."""
    a, b = vec(a), vec(b)
    aa = total(F.zip_with(a, b, lambda x, y: F.when(y.isNotNull(), x * x)))
    bb = total(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull(), y * y)))
    low = F.sqrt(aa) * F.sqrt(bb)
    return F.when(low == 0, 0.0).otherwise(dot(a, b) / low)


def cosine01(a: Column | str, b: Column | str) -> Column:
    """Cosine moved to 0..1; a zero vector gives 0.5."""
    return clamp01((cosine(a, b) + 1.0) / 2.0)


def fold(v: Column | str, dims: int) -> Column:
    """Member i added to place i mod dims; not normalised."""
    v = vec(v)
    return F.when(v.isNotNull(), F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda k: F.when(k < F.size(v), F.aggregate(F.sequence(k, F.greatest(k, F.size(v) - 1), F.lit(dims)), F.lit(0.0), lambda s, i: s + F.get(v, i))).otherwise(0.0),
    ))


def resize(v: Column | str, dims: int) -> Column:
    """Fold to ``dims`` places and normalise; a vector of that length is left as it is."""
    if dims <= 0:
        raise ValueError("dimension must be positive")
    v = vec(v)
    return F.when(F.size(v) == dims, v).otherwise(normalize(fold(v, dims)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def blend(vectors: list[Column | str], dims: int) -> Column:
    """The unit vector of the sum of the resized vectors; of none, zeros. Null vectors are left out."""
    zeros = F.array_repeat(F.lit(0.0), dims)
    return normalize(reduce(add, [F.coalesce(resize(v, dims), zeros) for v in vectors], zeros))


def effective(summary: Column | str, metadata: Column | str, dims: int) -> Column:
    """The summary with a share of its metadata; without metadata the resized summary as it is."""
    s, m = resize(summary, dims), resize(metadata, dims)
    return F.when(vec(metadata).isNull(), s).otherwise(normalize(F.zip_with(s, m, lambda x, y: 0.78 * x + 0.22 * y)))


def traversal_vector(summary: Column | str, metadata: Column | str, dims: int = 16) -> Column:
    return F.when(vec(metadata).isNull(), resize(summary, dims)).otherwise(blend([summary, metadata], dims))


def edge_vector(src: Column | str, dst: Column | str, dims: int = 16) -> Column:
    """What tells dst from src: unit vector of tanh(0.8 (dst - src) + 0.4 src dst)."""
    return normalize(F.zip_with(resize(src, dims), resize(dst, dims), lambda s, d: F.tanh(0.8 * (d - s) + 0.4 * s * d)))


def negate(v: Column | str) -> Column:
    return F.transform(vec(v), lambda x: -x)


def flip_alternating(v: Column | str) -> Column:
    """Members at even places negated."""
    return F.transform(vec(v), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))


def rounded(v: Column | str, places: int = 6) -> Column:
    """Every member rounded; a zero is never negative."""
    return F.transform(vec(v), lambda x: F.round(x, places) + F.lit(0.0))


def traversal_scalars(confidence: Column | str, hop: Column | str, size: int = 2) -> Column:
    """[confidence, hop / 3], both held to 0..1, padded with zeros or cut to ``size``."""
    both = F.array(clamp01(col(confidence).cast("double")), clamp01(col(hop).cast("double") / 3.0))
    return F.slice(F.concat(both, F.array_repeat(F.lit(0.0), max(0, size - 2))), 1, size)
