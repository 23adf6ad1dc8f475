"""Windows over series of any length: a series is cut into chunks, and what passes a border is carried over it.

No window holds more than one chunk of one series, so a series with a third of all rows is spread over
as many tasks as it has chunks.  What is carried has a row per chunk.  Null keys are a key of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join in which null keys meet; the right side's keys are dropped."""
    other = right.select(*(F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns))
    met = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on))
    return left.join(other, met, how).drop(*(f"_r_{c}" for c in on))


def running_sums(df: DataFrame, values: dict[str, Column], *, key: list[str], chunk: Column, by: list[Column]) -> DataFrame:
    """``df`` with the sums of ``values`` over the rows of its key up to and with each row.

    The order is that of ``chunk`` and then ``by``, so ``chunk`` must not fall along ``by`` (a null chunk
    comes first).  Nulls count as 0; rows that ``by`` leaves tied come in any order.
    """
    rows = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*key, "_chunk").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    inside = rows.select("*", *(F.sum(zero(v)).over(w).alias(f"_in_{n}") for n, v in values.items()))
    totals = rows.groupBy(*key, "_chunk").agg(*(F.sum(zero(v)).alias(f"_all_{n}") for n, v in values.items()))
    before = Window.partitionBy(*key).orderBy(F.asc_nulls_first("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*key, "_chunk", *(F.sum(f"_all_{n}").over(before).alias(f"_before_{n}") for n in values))
    joined = null_safe(inside, offsets, [*key, "_chunk"], "left")
    return joined.select(*df.columns, *((zero(F.col(f"_before_{n}")) + F.col(f"_in_{n}")).alias(n) for n in values))


def neighbours(df: DataFrame, values: dict[str, Column], *, key: list[str], chunk: Column, by: list[str], after: bool = True) -> DataFrame:
    """``df`` with ``before_<name>`` and ``after_<name>``: ``values`` of the rows next to each in its series, null at the ends.

    The order is that of ``chunk`` and then ``by``, as in ``running_sums``; ``by`` should leave no ties.
    """
    rows = df.withColumns({"_chunk": chunk, "_v": F.struct(*(v.alias(n) for n, v in values.items()))})
    w, place = Window.partitionBy(*key, "_chunk").orderBy(*by), F.struct(*by)
    inside = rows.select("*", F.lag("_v").over(w).alias("_b"), *([F.lead("_v").over(w).alias("_a")] if after else []))
    edges = rows.groupBy(*key, "_chunk").agg(F.max_by("_v", place).alias("_last"), *([F.min_by("_v", place).alias("_first")] if after else []))
    along = Window.partitionBy(*key).orderBy(F.asc_nulls_first("_chunk"))
    around = edges.select(*key, "_chunk", F.lag("_last").over(along).alias("_eb"), *([F.lead("_first").over(along).alias("_ea")] if after else []))
    joined = null_safe(inside, around, [*key, "_chunk"], "left")
    out = [F.coalesce("_b", "_eb")[n].alias(f"before_{n}") for n in values]
    if after:
        out += [F.coalesce("_a", "_ea")[n].alias(f"after_{n}") for n in values]
    return joined.select(*df.columns, *out)


def framed(df: DataFrame, aggregates: list[Column], *, key: list[str], at: Column, back: int, ahead: int, width: int) -> DataFrame:
    """``df`` with ``aggregates`` over the rows of its key whose integer ``at`` lies from ``at - back`` to ``at + ahead``.

    A row near a border is copied into the chunks that need it; ``width`` is a chunk's, no less than the frame's.
    """
    width = max(width, back + ahead + 1)
    own, place = F.floor(at / width), at.cast("long")
    rows = df.withColumns({"_at": place, "_own": own})
    copies = rows.withColumn("_chunk", F.explode(F.coalesce(F.sequence(F.floor((F.col("_at") - ahead) / width), F.floor((F.col("_at") + back) / width)), F.array(F.lit(None).cast("long")))))
    w = Window.partitionBy(*key, "_chunk").orderBy("_at").rangeBetween(-back, ahead)
    names = [f"_f{k}" for k in range(len(aggregates))]
    found = copies.select(*df.columns, "_own", "_chunk", *(a.over(w).alias(n) for a, n in zip(aggregates, names)))
    return found.filter(F.col("_own").eqNullSafe(F.col("_chunk"))).drop("_own", "_chunk")


def framed_sums(df: DataFrame, sums: dict[str, Column], *, key: list[str], at: Column, back: int, ahead: int) -> DataFrame:
    """``df`` with ``sums`` (aggregates that add up) over the rows of its key whose integer ``at`` lies from ``at - back`` to ``at + ahead``.

    Chunks are as wide as the frame, so a frame is the end of one chunk and the beginning of the next: two running
    sums instead of a pass over every row's frame.  Nothing is subtracted, so a NaN stays within its frames.
    """
    width, names = back + ahead + 1, list(sums)
    rows = df.withColumn("_at", at.cast("long"))
    cells = rows.groupBy(*key, "_at").agg(*(v.alias(n) for n, v in sums.items()))
    held = F.struct(F.col("_at").alias("_p"), F.lit(None).cast("long").alias("_ref"), F.lit(0).alias("_end"), *names)

    def asked(place: Column, end: int) -> Column:
        return F.struct(place.alias("_p"), F.col("_at").alias("_ref"), F.lit(end).alias("_end"), *(F.lit(None).cast(cells.schema[n].dataType).alias(n) for n in names))

    first, last = F.col("_at") - back, F.col("_at") + ahead
    # from the beginning of a chunk on, a frame is that chunk
    ends = F.when(F.floor(first / width) != F.floor(last / width), asked(last, 2))
    points = cells.select(*key, F.explode(F.filter(F.array(held, asked(first, 1), ends), lambda x: x.isNotNull())).alias("x")).select(*key, "x.*")
    points = points.withColumn("_chunk", F.floor(F.col("_p") / width))
    along = Window.partitionBy(*key, "_chunk")
    up, down = (along.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("_p").asc(), F.col("_p").desc()))
    sided = points.select(*key, "_ref", "_end", *(F.when(F.col("_end") == 2, F.sum(n).over(up)).otherwise(F.sum(n).over(down)).alias(n) for n in names))
    found = sided.filter("_end > 0").groupBy(*key, F.col("_ref").alias("_at")).agg(*(F.sum(n).alias(n) for n in names))
    return null_safe(rows, found, [*key, "_at"], "left").select(*df.columns, *names)
