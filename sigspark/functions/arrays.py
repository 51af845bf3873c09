"""Column helpers on arrays: recordings are ``array<array<double>>`` with the lead outermost."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(col: Column, digits: int = 8) -> Column:
    """Rounded double without a negative zero."""
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def indices(n: Column) -> Column:
    """``[0 … n-1]``; empty for n = 0 (``sequence(0, -1)`` would count down)."""
    n = n.cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def at(array: Column, i: Column) -> Column:
    """Element at a zero-based index."""
    return F.element_at(array, (i + 1).cast("int"))


def fold_sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def mean(array: Column) -> Column:
    return fold_sum(array) / F.size(array)


def dot(left: Column, right: Column) -> Column:
    return fold_sum(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def map_leads(ecg: Column, f) -> Column:
    """Apply ``f`` to every sample of every lead."""
    return F.transform(ecg, lambda lead: F.transform(lead, f))


def shifted(array: Column, by: int) -> Column:
    """Array moved so that element i is the old element i+by; null outside."""
    if by >= 0:
        return F.concat(F.slice(array, by + 1, F.size(array)), F.array_repeat(F.lit(None), by))
    return F.concat(F.array_repeat(F.lit(None), -by), F.slice(array, 1, F.greatest(F.size(array) + by, F.lit(0))))


def unrolled(df: DataFrame, keep: list, array: Column, value: str, pos: str | None = None) -> DataFrame:
    """One row per array element, with ``keep`` columns and, if named, its position.

    For a plain generator the optimiser adds a filter on the array's size and
    pushes it down, so a computed array is computed twice. The outer generator
    has no such filter; the row it adds for an empty array is dropped here.
    """
    place = pos or "_pos"
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, value)).filter(F.col(place).isNotNull())
    return rows if pos else rows.drop(place)


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def square_deviation(array: Column) -> Column:
    """Sum of squared deviations from the mean."""
    return let(mean(array), lambda m: fold_sum(F.transform(array, lambda x: (x - m) * (x - m))))
