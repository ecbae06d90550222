"""Small symmetric matrices as array columns: sums of products and the sweep operator.

A k x k matrix is an ``array<array<double>>`` of its rows. One row of a table holds
one matrix, of whatever size, so thousands of small fits are one projection: nothing
leaves the JVM and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-10      # of a term's own sum of squares that must be left for it to enter


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(values: Column, i: Column | int) -> Column:
    return F.get(values, F.lit(i) if isinstance(i, int) else i)


def last(values: Column) -> Column:
    return F.element_at(values, -1)


def none(kind: str = "double") -> Column:
    return F.array().cast(f"array<{kind}>")


def upto(n: Column, first: int = 0) -> Column:
    """first, first + 1, ... of n numbers; none for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(first), F.lit(first - 1) + n)).otherwise(none("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def gram_sums(terms: Sequence[Column]) -> Column:
    """Aggregate: the matrix of summed products of the terms (a null product counts as 0)."""
    k = len(terms)
    sums = {(i, j): F.coalesce(F.sum(terms[i] * terms[j]), F.lit(0.0)) for i in range(k) for j in range(i, k)}
    return F.array(*[F.array(*[sums[min(i, j), max(i, j)] for j in range(k)]) for i in range(k)])


def add_outer(matrix: Column, z: Column) -> Column:
    """The matrix plus z z'."""
    return F.zip_with(matrix, z, lambda row, x: F.zip_with(row, z, lambda v, y: v + x * y))


def sweep(matrix: Column, pivots: Column, tolerance: float = TOLERANCE) -> Column:
    """The matrix, of unit diagonal, swept on each pivot (0-based) in turn. A pivot of which less than
    ``tolerance`` is left by those before it is passed over."""
    def step(a: Column, p: Column) -> Column:
        def swept(row: Column) -> Column:
            d = F.get(row, p)
            # With one less than the pivot at its own place, the same line also serves the pivot's column.
            meets = F.transform(row, lambda x, j: F.when(j == p, x - 1.0).otherwise(x))
            own = F.transform(row, lambda x, j: F.when(j == p, F.lit(-1.0)).otherwise(x) / d)
            return F.when(d > tolerance, let(meets, lambda m: F.transform(a, lambda r, i: F.when(i == p, own).otherwise(
                let(F.get(r, p) / d, lambda f: F.zip_with(r, m, lambda x, y: x - f * y)))))).otherwise(a)
        return let(F.get(a, p), swept)

    return F.aggregate(pivots, matrix, step)


def sizes(matrix: Column) -> Column:
    """Roots of the diagonal: 0 for a variable that is 0 throughout."""
    return F.transform(matrix, lambda row, i: F.sqrt(F.greatest(F.get(row, i), F.lit(0.0))))


def unit(matrix: Column, size: Column) -> Column:
    """The matrix over both variables' sizes. A variable of size 0 has a row of 0, so it never enters."""
    return F.zip_with(matrix, size, lambda row, x: F.zip_with(row, size, lambda v, y: F.when((x > 0) & (y > 0), v / x / y).otherwise(0.0)))


def solve(matrix: Column, pivots: Column, tolerance: float = TOLERANCE) -> Column:
    """Least squares of the last variable on those named by ``pivots`` (0-based, in order of entry).

    struct(coef, inverse, rss, rank): ``coef`` and ``inverse`` (the diagonal of the inverse of the used
    products) have an entry for each variable but the last, null where it is not used; ``rss`` is at least 0.
    """
    def scaled(size: Column) -> Column:
        def read(a: Column) -> Column:
            # What is swept is at most -1 on the diagonal, what isn't is no less than 0 but for rounding.
            each = F.slice(F.transform(a, lambda row, i: F.struct(F.get(row, i).alias("own"), last(row).alias("y"), F.get(size, i).alias("size"))),
                           1, F.size(a) - 1)
            return F.struct(
                F.transform(each, lambda v: F.when(v["own"] < -0.5, v["y"] * last(size) / v["size"])).alias("coef"),
                F.transform(each, lambda v: F.when(v["own"] < -0.5, -v["own"] / (v["size"] * v["size"]))).alias("inverse"),
                F.greatest(last(last(a)) * last(size) * last(size), F.lit(0.0)).alias("rss"),
                F.size(F.filter(each, lambda v: v["own"] < -0.5)).alias("rank"))
        return let(sweep(unit(matrix, size), pivots, tolerance), read)

    return let(sizes(matrix), scaled)
