"""Array helpers that stay inside one row and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def running_starts(sizes: Column) -> Column:
    """Start of every piece when pieces of the given sizes are laid end to end.

    The result has one element more than the input; the last one is the total.
    """
    return F.aggregate(
        sizes,
        F.array(F.lit(0).cast("long")),
        lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n),
    )


def tally(values: Column, value: str, n: str) -> Column:
    """Different values of an array and how often each occurs, as an array of structs.

    One pass over the sorted array.  The inner arrays are bound to lambda variables, since an
    expression inside a lambda would be evaluated again for every element.
    """

    def runs(s: Column) -> Column:
        size = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), size), lambda i: (i == 0) | (i == size) | (F.get(s, i) != F.get(s, i - 1)))
        return F.flatten(
            F.transform(
                F.array(starts),
                lambda p: F.transform(
                    F.slice(p, F.lit(1), F.size(p) - 1),
                    lambda i, k: F.struct(F.get(s, i).alias(value), (F.get(p, k + 1) - i).cast("long").alias(n)),
                ),
            )
        )

    return F.flatten(F.transform(F.array(F.sort_array(values)), runs))
