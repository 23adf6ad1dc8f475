"""Exact interpolated quantiles per key in bounded memory.

``percentile`` keeps every distinct value of a key in one task.  Here a grid of approximate quantiles
brackets each wanted rank, rows below the bracket are counted, and only those inside go on; when few
are left, they are counted by value and the ranks are read off.  Each pass is one aggregation with partial
sums, whatever the number of rows of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .scans import null_safe

GRID = 128
#: Rank error of the grid, as a share of the values it is taken from: a tenth of a step.
ACCURACY = 10 * GRID


def _narrowed(rows: DataFrame, brackets: DataFrame | None, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """The next bracket of every wanted rank: ``lo_, hi_`` per name, with ``n_`` values in all."""
    inside, out = {}, []
    held = rows if brackets is None else null_safe(rows, brackets, keys, "inner")
    for name in wanted:
        v = F.col(f"_v_{name}")
        inside[name] = v if brackets is None else F.when((v >= F.col(f"lo_{name}")) & (v <= F.col(f"hi_{name}")), v)
        grid = F.percentile_approx(inside[name], [k / GRID for k in range(GRID + 1)], ACCURACY)
        n = F.count(v) if brackets is None else F.max(f"n_{name}")
        below = F.lit(0).cast("long") if brackets is None else F.count_if(v < F.col(f"lo_{name}"))
        out += [n.alias(f"n_{name}"), below.alias(f"below_{name}"), F.count(inside[name]).alias(f"in_{name}"), F.min(inside[name]).alias(f"min_{name}"), F.max(inside[name]).alias(f"max_{name}"), grid.alias(f"grid_{name}")]
    found = held.groupBy(*keys).agg(*out)
    named = [F.col(k) for k in keys]
    for name, (_, p) in wanted.items():
        rank = F.floor(F.lit(p) * (F.col(f"n_{name}") - 1)) - F.col(f"below_{name}")  # of the lower value, among those inside
        among = F.nullif(F.col(f"in_{name}"), F.lit(0))
        at = F.floor(rank * GRID / among).cast("int")
        last = F.ceil((rank + 2) * GRID / among).cast("int")
        low = F.when(at >= 1, F.get(f"grid_{name}", at - 1)).otherwise(F.col(f"min_{name}"))
        high = F.when(last + 1 <= GRID, F.get(f"grid_{name}", last + 1)).otherwise(F.col(f"max_{name}"))
        named += [F.col(f"n_{name}"), low.alias(f"lo_{name}"), high.alias(f"hi_{name}"), F.col(f"in_{name}")]
    return found.select(*named)


def _read_off(rows: DataFrame, brackets: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """The values at the wanted ranks, from the values inside the brackets and the number below."""
    held = null_safe(rows, brackets, keys, "inner")
    each = []
    for name, (_, p) in wanted.items():
        v = F.col(f"_v_{name}")
        place = F.lit(p) * (F.col(f"n_{name}") - 1)
        known = (v <= F.col(f"hi_{name}")) & v.isNotNull()
        each.append(F.when(known, F.struct(F.lit(name).alias("name"), place.alias("place"), F.when(v >= F.col(f"lo_{name}"), v).alias("v"))))
    listed = held.select(*keys, F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))
    counted = listed.groupBy(*keys, "name", "place", "v").agg(F.count("*").alias("c"))  # v null: below the bracket
    w = Window.partitionBy(*keys, "name").orderBy(F.asc_nulls_first("v"))
    upto = counted.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.floor("place"), F.ceil("place")
    at = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank), F.col("v")))
    ends = upto.groupBy(*keys, "name", "place").agg(at(low).alias("a"), at(high).alias("b"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((high - F.col("place")) * F.col("a") + (F.col("place") - low) * F.col("b"))
    return ends.groupBy(*keys).pivot("name", list(wanted)).agg(F.max(value))


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], *, keys: list[str], few: int = 100_000) -> DataFrame:
    """One row per key of ``df`` with the quantile of each wanted (column, share), null where the column has no value.

    Nulls do not count.  Keys of at most ``few`` rows, if no other are there, take ``percentile`` itself, whose
    memory is then bounded; the results are the same.
    """
    rows = df.select(*keys, *(v.cast("double").alias(f"_v_{n}") for n, (v, _) in wanted.items()))
    longest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest <= few:
        return rows.groupBy(*keys).agg(*(F.percentile(f"_v_{n}", F.lit(p)).alias(n) for n, (_, p) in wanted.items()))
    brackets, left = None, longest
    while left > few:
        brackets = materialize(_narrowed(rows, brackets, keys, wanted), "quantile-brackets")
        left = left * 5 // GRID
    found = _read_off(rows, brackets, keys, wanted)
    return null_safe(brackets.select(*keys), found.select(*keys, *wanted), keys, "left")
