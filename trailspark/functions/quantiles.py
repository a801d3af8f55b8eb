"""Exact interpolated percentiles without holding a group in one task."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from trailspark.functions.ordered import before, in_cells


CELLS = 4096


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: Mapping[str, float],
) -> DataFrame:
    """``percentile_cont`` per key; ``points`` maps output column to fraction.

    The built-in ``percentile`` merges the value counts of a group in one task.
    Here equal values are counted first (map side combined), the distinct
    values are numbered in cells, and only the two rows around each wanted
    position are kept. There are CELLS cells per doubling, so fractional values
    spread out as well, and a key has some ten thousand cells at most.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__c")
    )
    everything = (Window.unboundedPreceding, Window.unboundedFollowing)
    placed = in_cells(
        counted, keys, [value],
        cell=F.floor(F.signum(value) * F.log2(F.abs(F.col(value)) + 1) * CELLS),
        local={"__upto": lambda w: F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))},
        summary={"__cell_n": F.sum("__c")},
        inherited={
            "__before": lambda w: F.sum("__cell_n").over(w.rowsBetween(*before)),
            "__n": lambda w: F.sum("__cell_n").over(w.rowsBetween(*everything)),
        },
    ).withColumn("__end", F.col("__upto") + F.coalesce("__before", F.lit(0)))

    def at(position):
        covers = (position >= F.col("__end") - F.col("__c")) & (position < F.col("__end"))
        return F.max(F.when(covers, F.col(value)))

    sides, result = [], []
    for name, fraction in points.items():
        position = (F.col("__n") - 1) * F.lit(fraction)
        sides += [
            at(F.floor(position)).alias(f"__lo_{name}"),
            at(F.ceil(position)).alias(f"__hi_{name}"),
        ]
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        result.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    found = placed.groupBy(*keys).agg(F.max("__n").alias("__n"), *sides)
    return found.select(*keys, *result)
