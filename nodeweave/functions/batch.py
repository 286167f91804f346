"""Vector kernels over Arrow batches: many comparisons a row in one pass of numpy.

The column forms in vectors.py are interpreted member by member; where a plan
compares several vectors of each row, one scalar Arrow function over the row's
vectors costs a fraction of that. All arithmetic is in double. A null vector
gives null, null members count as 0, vectors of different length are compared
over their common prefix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweave.functions.vectors import col, vec


@dataclass
class Rows:
    """Vectors of a batch, one a row, padded with zeros to one width."""

    x: np.ndarray
    size: np.ndarray
    there: np.ndarray


def rows_of(a: pa.Array) -> Rows:
    size = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    there = a.is_valid().to_numpy(zero_copy_only=False)
    flat = a.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    width = int(size.max()) if len(size) else 0
    if (size == width).all():
        return Rows(flat.reshape(len(size), width), size, there)
    x = np.zeros((len(size), width))
    x[np.arange(width) < size[:, None]] = flat
    return Rows(x, size, there)


def cosine01(a: Rows, b: Rows) -> np.ndarray:
    """Cosine over the common prefix, norms too, moved to 0..1; NaN where a vector is missing."""
    w = min(a.x.shape[1], b.x.shape[1])
    x, y = a.x[:, :w], b.x[:, :w]
    if (a.size != b.size).any():
        common = np.arange(w) < np.minimum(a.size, b.size)[:, None]
        x, y = x * common, y * common
    low = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
    c = np.divide(np.einsum("ij,ij->i", x, y), low, out=np.zeros(len(x)), where=low > 0)
    return np.where(a.there & b.there, np.clip((c + 1.0) / 2.0, 0.0, 1.0), np.nan)


def product(a: Rows, b: Rows) -> np.ndarray:
    """Inner product over the common prefix, members added in array order."""
    w = min(a.x.shape[1], b.x.shape[1])
    total = np.add.accumulate(a.x[:, :w] * b.x[:, :w], axis=1)[:, -1] if w else np.zeros(len(a.x))
    return np.where(a.there & b.there, total, np.nan)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def resize(a: Rows, dims: int) -> Rows:
    """Folded to ``dims`` places and normalised; vectors of that length stay as they are."""
    if (a.size == dims).all():
        return a
    folded = np.pad(a.x, ((0, 0), (0, -a.x.shape[1] % dims))).reshape(len(a.x), -1, dims).sum(1) if a.x.shape[1] else np.zeros((len(a.x), dims))
    same = (a.size == dims)[:, None]
    kept = np.pad(a.x[:, :dims], ((0, 0), (0, max(0, dims - a.x.shape[1]))))
    return Rows(np.where(same, kept, unit(folded)), np.full(len(a.x), dims), a.there)


def effective(summary: Rows, metadata: Rows, dims: int) -> Rows:
    """The summary with a share of its metadata, where there is any."""
    s, m = resize(summary, dims), resize(metadata, dims)
    mixed = unit(0.78 * s.x + 0.22 * m.x) if len(s.x) else s.x
    return Rows(np.where(m.there[:, None], mixed, s.x), s.size, s.there)


def listed(a: Rows) -> pa.Array:
    """Rows of one width back as a list array."""
    width = a.x.shape[1]
    offsets = pa.array(np.arange(len(a.x) + 1, dtype=np.int32) * width)
    made = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(a.x).reshape(-1)))
    return made if a.there.all() else pa.compute.if_else(pa.array(a.there), made, pa.scalar(None, made.type))


def numbers(x: np.ndarray) -> pa.Array:
    """Doubles with null for NaN."""
    return pa.array(x, mask=np.isnan(x))


def effective_column(summary: Column | str, metadata: Column | str, dims: int) -> Column:
    """vectors.effective as one Arrow function."""

    @F.arrow_udf("array<double>")
    def run(s: pa.Array, m: pa.Array) -> pa.Array:
        return listed(effective(rows_of(s), rows_of(m), dims))

    return run(vec(summary), vec(metadata))


def resize_column(v: Column | str, dims: int) -> Column:
    """vectors.resize as one Arrow function."""

    @F.arrow_udf("array<double>")
    def run(a: pa.Array) -> pa.Array:
        return listed(resize(rows_of(a), dims))

    return run(vec(v))


def unit_column(v: Column | str) -> Column:
    """vectors.normalize as one Arrow function."""

    @F.arrow_udf("array<double>")
    def run(a: pa.Array) -> pa.Array:
        r = rows_of(a)
        if (r.size != r.x.shape[1]).any():
            flat = unit(r.x)[np.arange(r.x.shape[1]) < r.size[:, None]]
            offsets = pa.array(np.concatenate(([0], np.cumsum(r.size))).astype(np.int32), mask=None)
            made = pa.ListArray.from_arrays(offsets, pa.array(flat))
            return pa.compute.if_else(pa.array(r.there), made, pa.scalar(None, made.type))
        return listed(Rows(unit(r.x), r.size, r.there))

    return run(vec(v))


def with_scores(df: DataFrame, vectors: Sequence[str], plain: Sequence[str], names: Sequence[str], score: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """df with one double column for each of ``names``, from score(vectors..., numbers...) over whole batches.

    Only the named inputs travel to Python; a NaN comes back as null. Columns of
    df with a score's name are replaced. Inputs must not be made by functions with
    lambdas in the same plan (the planner leaves such Python functions in place):
    make them with this module's functions, or write the table first.
    """

    @F.arrow_udf("struct<" + ", ".join(f"{n}: double" for n in names) + ">")
    def run(*given: pa.Array) -> pa.Array:
        parts = [rows_of(a) for a in given[: len(vectors)]]
        rest = [a.cast(pa.float64()).to_numpy(zero_copy_only=False) for a in given[len(vectors) :]]
        got = score(*parts, *rest)
        return pa.StructArray.from_arrays([numbers(got[n]) for n in names], list(names))

    held = df.withColumn("_scores", run(*[vec(v) for v in vectors], *[col(p).cast("double") for p in plain]))
    return held.select(*[c for c in df.columns if c not in names], *[F.col("_scores").getField(n).alias(n) for n in names])
