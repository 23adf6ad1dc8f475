"""Neighbours in time: steps, gaps, runs, day rollover, centred means, dense grids.

Every operator works per ``key``; a series is ordered by its time and then by ``tie``.  Series are cut into
chunks of ``chunk_us`` microseconds (see ``scans``), so that a long one is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import bucket, from_micros, micros
from ..scratch import materialize
from .scans import framed_sums, neighbours, null_safe, running_sums

HOUR = 3_600_000_000


def order(key: str | list[str], *by: str):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*by)


def time_chunk(ts: str, chunk_us: int) -> Column:
    return F.floor(micros(ts) / chunk_us)


def beside(df: DataFrame, values: dict[str, Column], *, key: str, ts: str, tie: str, chunk_us: int = HOUR, after: bool = True) -> DataFrame:
    """``before_<name>`` and ``after_<name>`` of the rows next to each in time."""
    return neighbours(df, values, key=[key], chunk=time_chunk(ts, chunk_us), by=[ts, tie], after=after)


def with_dt(df: DataFrame, *, key: str, ts: str, tie: str, chunk_us: int = HOUR) -> DataFrame:
    """``dt``: seconds since the row before, null for the first."""
    rows = beside(df, {"us": micros(ts)}, key=key, ts=ts, tie=tie, chunk_us=chunk_us, after=False)
    return rows.select(*df.columns, ((micros(ts) - F.col("before_us")) / F.lit(1e6)).alias("dt"))


def gaps(df: DataFrame, *, key: str, ts: str, tie: str, longer_than: float, chunk_us: int = HOUR) -> DataFrame:
    """Stretches without rows of over ``longer_than`` seconds: ``key, gap_start, gap_end, gap_s``."""
    rows = beside(df.select(key, ts, tie), {"ts": F.col(ts)}, key=key, ts=ts, tie=tie, chunk_us=chunk_us, after=False)
    gap = (micros(ts) - micros("before_ts")) / F.lit(1e6)
    return rows.select(key, F.col("before_ts").alias("gap_start"), F.col(ts).alias("gap_end"), gap.alias("gap_s")).filter(F.col("gap_s") > longer_than)


def first_of_time(df: DataFrame, *, key: str, ts: str, tie: str) -> DataFrame:
    """Of rows at the same time the one of the least ``tie``."""
    return df.withColumn("_n", F.row_number().over(order([key, ts], tie))).filter("_n = 1").drop("_n")


def spread_repeats(df: DataFrame, *, key: str, ts: str, tie: str, unit_us: int = 1_000_000, out: str = "spread_us") -> DataFrame:
    """Rows that share a time are spread evenly over the unit that follows (microseconds)."""
    rank, total = (F.row_number().over(order([key, ts], tie)) - 1).cast("long"), F.count("*").over(Window.partitionBy(key, ts))
    return df.withColumn(out, micros(ts) + F.floor(rank * F.lit(unit_us) / total).cast("long"))


def _numbered_runs(marked: DataFrame, *, key: str, ts: str, tie: str, chunk_us: int) -> DataFrame:
    """``marked`` without ``_changed``, with ``run`` and ``run_length``: run numbers pass chunk borders as sums of changes, lengths are counted per chunk and added up per run."""
    kept = [c for c in marked.columns if c != "_changed"]
    marked = materialize(marked, "runs")  # read by the rows, the sums and the lengths
    numbered = running_sums(marked, {"run": F.col("_changed")}, key=[key], chunk=time_chunk(ts, chunk_us), by=[F.col(ts), F.col(tie)])
    numbered = numbered.select(*kept, "run", time_chunk(ts, chunk_us).alias("_chunk"))
    parts = numbered.groupBy(key, "_chunk", "run").agg(F.count("*").alias("_n"))
    lengths = parts.select(key, "_chunk", "run", F.sum("_n").over(Window.partitionBy(key, "run")).alias("run_length"))
    return null_safe(numbered, lengths, [key, "_chunk", "run"], "left").select(*kept, "run", "run_length")


def runs(df: DataFrame, state: Column, *, key: str, ts: str, tie: str, chunk_us: int = HOUR) -> DataFrame:
    """``run`` (number within the key) and ``run_length`` of stretches of equal ``state``."""
    marked = beside(df.withColumn("_s", state), {"s": F.struct(F.col("_s").alias("s"))}, key=key, ts=ts, tie=tie, chunk_us=chunk_us, after=False)
    changed = F.when(F.col("before_s").isNotNull() & F.col("before_s.s").eqNullSafe(F.col("_s")), 0).otherwise(1)
    return _numbered_runs(marked.select(*df.columns, changed.cast("long").alias("_changed")), key=key, ts=ts, tie=tie, chunk_us=chunk_us)


def fill_joint_zeros(df: DataFrame, axes: list[str], *, key: str, ts: str, tie: str, least: int = 3, chunk_us: int = HOUR) -> DataFrame:
    """Rows of zeros on all axes in runs of at least ``least`` become the mean of their original neighbours.

    The inside of a run has zeros as neighbours and stays zero; at either end of a series the one
    neighbour counts.  ``filled`` marks the rows.
    """

    def zero(of: str) -> Column:
        out = F.lit(True)
        for a in axes:
            out = out & F.coalesce(F.col(f"{of}{a}") == 0, F.lit(False))
        return out

    near = beside(df, {a: F.col(a) for a in axes} | {"row": F.lit(True)}, key=key, ts=ts, tie=tie, chunk_us=chunk_us)
    changed = F.when(F.col("before_row") & (zero("before_") == zero("")), 0).otherwise(1)
    out = _numbered_runs(near.withColumn("_changed", changed.cast("long")), key=key, ts=ts, tie=tie, chunk_us=chunk_us)
    filled = zero("") & (F.col("run_length") >= least)
    mean = {a: (F.coalesce(f"before_{a}", f"after_{a}") + F.coalesce(f"after_{a}", f"before_{a}")) / 2 for a in axes}
    kept = [c for c in df.columns if c not in axes]
    return out.select(*kept, *(F.when(filled, mean[a]).otherwise(F.col(a)).alias(a) for a in axes), filled.alias("filled"))


def centred_mean(df: DataFrame, values: list[str], *, key: str, ts: str, half_us: int = 1_000_000, chunk_us: int = HOUR) -> DataFrame:
    """``<value>_mean`` over the rows after t - half and up to t + half, in time that does not grow with the rows in a frame.

    Chunks are as wide as the frame, whatever ``chunk_us``.
    """
    sums = {f"_s{k}": F.sum(F.col(v).cast("double")) for k, v in enumerate(values)} | {f"_n{k}": F.count(v) for k, v in enumerate(values)} | {"rows_in_frame": F.count("*")}
    found = framed_sums(df, sums, key=[key], at=micros(ts), back=half_us - 1, ahead=half_us)
    means = (F.when(F.col(f"_n{k}") > 0, F.col(f"_s{k}") / F.col(f"_n{k}")).alias(f"{v}_mean") for k, v in enumerate(values))
    return found.select(*df.columns, *means, "rows_in_frame")


def filled(df: DataFrame, values: list[str], *, key: str, ts: str, tie: str, chunk_us: int = HOUR) -> DataFrame:
    """Nulls of ``values`` become the next value of the series, and after its last one the last."""
    rows = df.withColumn("_chunk", time_chunk(ts, chunk_us))
    w, place = Window.partitionBy(key, "_chunk").orderBy(ts, tie), F.struct(ts, tie)
    ahead, back = (w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0))
    inside = rows.select("*", *(F.first(v, ignorenulls=True).over(ahead).alias(f"_a_{v}") for v in values), *(F.last(v, ignorenulls=True).over(back).alias(f"_b_{v}") for v in values))
    held = lambda v: F.when(F.col(v).isNotNull(), place)
    ends = rows.groupBy(key, "_chunk").agg(*(F.min_by(v, held(v)).alias(f"_first_{v}") for v in values), *(F.max_by(v, held(v)).alias(f"_last_{v}") for v in values))
    along = Window.partitionBy(key).orderBy(F.asc_nulls_first("_chunk"))
    later, earlier = along.rowsBetween(1, Window.unboundedFollowing), along.rowsBetween(Window.unboundedPreceding, -1)
    around = ends.select(key, "_chunk", *(F.first(f"_first_{v}", ignorenulls=True).over(later).alias(f"_later_{v}") for v in values), *(F.last(f"_last_{v}", ignorenulls=True).over(earlier).alias(f"_earlier_{v}") for v in values))
    joined = null_safe(inside, around, [key, "_chunk"], "left")
    return joined.select(*(F.coalesce(f"_a_{c}", f"_later_{c}", f"_b_{c}", f"_earlier_{c}").alias(c) if c in values else F.col(c) for c in df.columns))


def thin_slots(df: DataFrame, *, ts: str, width: str, least: int, key: str | None = None) -> DataFrame:
    """``[key,] slot, n, thin`` of a series' slots but the first and the last, which it fills in part only; ``thin`` are those of fewer than ``least`` rows."""
    keys = [key] if key else []
    slots = dense_counts(df, ts=ts, width=width, key=key)
    ends = slots.groupBy(*keys).agg(F.min("slot").alias("_a"), F.max("slot").alias("_b"))
    inner = null_safe(slots, ends, keys, "inner") if keys else slots.join(F.broadcast(ends), F.lit(True))  # one row
    return inner.filter("slot > _a and slot < _b").select(*keys, "slot", "n", (F.col("n") < least).alias("thin"))


def rollover_days(df: DataFrame, *, key: str | list[str], clock_us: str, tie: str | list[str], back_s: float = 0.0, midnight: bool = False, chunk: Column | None = None) -> DataFrame:
    """``days``: midnights passed since the series began, from a clock that starts over.

    A step back of over ``back_s`` seconds is a midnight; with ``midnight``, so is one of over half
    an hour that leaves the last half hour of a day for the first of the next.  ``chunk`` cuts long series;
    it must not fall along ``tie`` (a file's block, say).
    """
    keys, by, chunk = [key] if isinstance(key, str) else key, [tie] if isinstance(tie, str) else tie, F.lit(0) if chunk is None else chunk
    near = neighbours(df, {"clock": F.col(clock_us)}, key=keys, chunk=chunk, by=by, after=False)
    step = F.col(clock_us) - F.col("before_clock")
    crossed = step < -int(back_s * 1e6)
    if midnight:
        late, early = F.col("before_clock") >= 84_600_000_000, F.col(clock_us) <= 1_800_000_000
        crossed = crossed | ((step < -1_800_000_000) & late & early)
    marked = near.withColumn("crossed", F.coalesce(crossed, F.lit(False)))
    summed = running_sums(marked, {"days": F.col("crossed").cast("int")}, key=keys, chunk=chunk, by=[F.col(c) for c in by])
    return summed.select(*df.columns, F.col("days").cast("int").alias("days"), "crossed")


def rollover_triggers(df: DataFrame, *, key: str, clock_us: str, tie: str | list[str], back_s: float = 0.0, midnight: bool = False, chunk: Column | None = None, shown: int = 10) -> DataFrame:
    """The first ``shown`` rows of each series that count as a midnight: ``key, number, row, before_us, clock_us, rule``; ``row`` is the place in the series, from 0."""
    by, chunk = [tie] if isinstance(tie, str) else tie, F.lit(0) if chunk is None else chunk
    rolled = rollover_days(df, key=key, clock_us=clock_us, tie=tie, back_s=back_s, midnight=midnight, chunk=chunk)
    placed = running_sums(rolled, {"_row": F.lit(1)}, key=[key], chunk=chunk, by=[F.col(c) for c in by])
    seen = neighbours(placed, {"clock": F.col(clock_us)}, key=[key], chunk=chunk, by=by, after=False)
    before = F.col("before_clock")
    natural = F.lit(midnight) & (before >= 84_600_000_000) & (F.col(clock_us) <= 1_800_000_000) & (F.col(clock_us) - before < -1_800_000_000)
    named = [F.col("days").alias("number"), (F.col("_row") - 1).cast("int").alias("row"), before.alias("before_us"), F.col(clock_us).alias("clock_us"), F.when(natural, "midnight").otherwise("long_step").alias("rule")]
    return seen.filter(F.col("crossed") & (F.col("days") <= shown)).select(key, *named)


def rollover_log(df: DataFrame, *, key: str, clock_us: str, tie: str | list[str], back_s: float = 0.0, midnight: bool = False, chunk: Column | None = None) -> DataFrame:
    """Per series ``rows, crossings, first_us, last_us`` and ``odd``: a file of one day passes one midnight at most."""
    rolled = rollover_days(df, key=key, clock_us=clock_us, tie=tie, back_s=back_s, midnight=midnight, chunk=chunk)
    place = F.struct(*([tie] if isinstance(tie, str) else tie))
    counted = rolled.groupBy(key).agg(F.count("*").alias("rows"), F.count_if("crossed").alias("crossings"), F.min_by(clock_us, place).alias("first_us"), F.max_by(clock_us, place).alias("last_us"))
    return counted.withColumn("odd", F.col("crossings") >= 2)


def dense_counts(df: DataFrame, *, ts: str, width: str, key: str | None = None, chunk: int = 4096) -> DataFrame:
    """``[key,] slot, n`` for every ``width`` between a series' first and last row, empty ones too.

    The grid is laid out ``chunk`` slots at a time, so no row holds a whole series' slots.
    """
    keys = [key] if key else []
    counts = df.groupBy(*keys, bucket(ts, width).alias("slot")).agg(F.count("*").alias("n"))
    ends = counts.groupBy(*keys).agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    step = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', TIMESTAMP_NTZ'1970-01-01 00:00:00' + interval {width})")
    spans = ends.select(*keys, micros("a").alias("_a"), step.alias("_step"), F.floor((micros("b") - micros("a")) / step).cast("long").alias("_last"))
    chunks = spans.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"), F.lit(chunk).cast("long"))).alias("_from"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks.repartition(tasks, *keys, "_from")  # else a series' slots would all come out of one row's task
    places = chunks.select("*", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (chunk - 1), F.col("_last")))).alias("_k"))
    grid = places.select(*keys, from_micros(F.col("_a") + F.col("_k") * F.col("_step")).alias("slot"))
    return grid.join(counts, [*keys, "slot"], "left").select(*keys, "slot", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
