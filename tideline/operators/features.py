"""Per-slot features: distribution statistics natively, spectra and sample entropy by numpy over batches of slots.

A slot is a second of a recording, some ten samples; ``distribution`` and ``sample_entropy_of_any_size`` take slots without a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..scratch import materialize
from .quantiles import exact_quantiles
from .scans import neighbours, null_safe, running_sums
from .timeline import HOUR, time_chunk


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, null if either is constant."""
    return _ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def distribution(df: DataFrame, value: str, *, slot: list[str], ts: str, tie: str, chunk_us: int = HOUR) -> DataFrame:
    """Moments, quantiles, zero crossings, peaks and autocorrelation of slots of any size.

    Rows find their neighbours chunk by chunk, quantiles are exact by selection, and the rest are sums.
    """
    x = F.col(value)
    near = neighbours(df.select(*slot, ts, tie, value), {"x": x}, key=slot, chunk=time_chunk(ts, chunk_us), by=[ts, tie])
    tops = null_safe(near, df.groupBy(*slot).agg(F.max(value).alias("_top")), slot, "left")
    before, after = F.col("before_x"), F.col("after_x")
    rows = tops.select(*slot, value, before.alias("_b"), F.coalesce((x > before) & (x > after) & (x > 0.5 * F.col("_top")), F.lit(False)).cast("long").alias("_peak"), F.abs(F.signum(x) - F.signum(before)).alias("_turn"))
    n, mean, sd = F.count(value).cast("double"), F.avg(value), F.stddev_pop(value)
    g1, g2 = F.skewness(value), F.kurtosis(value)
    skew = F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0)))
    kurt = F.when(n >= 4, (n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1.0)) * ((n + 1) * g2 + 6))
    pair = F.col("_b").isNotNull()
    own, last = F.when(pair, x), F.when(pair, F.col("_b"))
    sums = rows.groupBy(*slot).agg(
        F.count(value).alias("n"), mean.alias("mean"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.max(value).alias("high"), F.min(value).alias("low"), F.stddev_samp(value).alias("sd"),
        F.coalesce(_ratio(sd, mean), F.lit(0.0)).alias("cv"), F.coalesce(skew, F.lit(0.0)).alias("skew"), F.coalesce(kurt, F.lit(0.0)).alias("kurt"), F.sqrt(F.avg(x * x)).alias("rms"),
        (F.coalesce(F.sum("_turn"), F.lit(0.0)) / 2).alias("crossings"), F.sum("_peak").alias("peaks"), F.when(n >= 2, correlation(own, last)).otherwise(F.when(n > 0, F.lit(0.0))).alias("autocorr"),
    )
    return null_safe(sums, exact_quantiles(df, {"p25": (x, 0.25), "p75": (x, 0.75)}, keys=slot), slot, "left")


def spectrum(x: np.ndarray, rate: float, edges: tuple[float, float] = (1.0, 4.0)) -> np.ndarray:
    """Of each row of ``x``: spectral entropy over all bins, the strongest positive frequency below half the rate, and power shares of three bands."""
    m, n = x.shape
    out = np.zeros((m, 5))
    if n < 3:
        return out
    power = np.abs(np.fft.fft(x, axis=1)) ** 2
    total = power.sum(1, keepdims=True)
    share = np.divide(power, total, out=np.zeros_like(power), where=total > 0)
    out[:, 0] = np.where(total[:, 0] > 0, -(share * np.log2(share + 1e-10)).sum(1), 0.0)
    k = np.arange(1, (n - 1) // 2 + 1)
    positive, freq = power[:, k], k * rate / n
    # ties in floating sums go to the lower frequency
    out[:, 1] = freq[np.argmax(positive >= positive.max(1, keepdims=True) * (1 - 1e-9), axis=1)]
    whole = positive.sum(1)
    for j, band in enumerate((freq < edges[0], (freq >= edges[0]) & (freq < edges[1]), freq >= edges[1]), 2):
        out[:, j] = np.divide(positive[:, band].sum(1), whole, out=np.zeros(m), where=whole > 0)
    return out


def sample_entropy(x: np.ndarray, r: float = 0.2, cells: int = 1 << 22) -> np.ndarray:
    """Of each row of ``x``: -ln of the share of matching pairs of two values that match with the third too; 0 where undefined."""
    m, n = x.shape
    out = np.zeros(m)
    if n < 4:
        return out
    radius, step = r * x.std(axis=1), max(1, cells // (n * n))
    for a in range(0, m, step):
        part, limit = x[a : a + step], radius[a : a + step, None]
        pairs, triples = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for lag in range(1, n - 1):  # templates so many places apart
            close = np.abs(part[:, lag:] - part[:, :-lag]) < limit
            two = close[:, :-1] & close[:, 1:]
            pairs += two.sum(1)
            triples += (two[:, :-1] & close[:, 2:]).sum(1)
        known = (pairs > 0) & (triples > 0) & (limit[:, 0] > 0)
        out[a : a + step][known] = -np.log(triples[known] / pairs[known])
    return out


def turns(x: np.ndarray) -> np.ndarray:
    """Of each row of ``x``: zero crossings, peaks over half its maximum, and the correlation of neighbours (nan if either side is constant, 0 for one value)."""
    m, n = x.shape
    out = np.zeros((m, 3))
    if n >= 2:
        out[:, 0] = np.abs(np.diff(np.sign(x), axis=1)).sum(1) / 2
        a, b = x[:, :-1], x[:, 1:]
        da, db = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        varied = (a.max(1) > a.min(1)) & (b.max(1) > b.min(1))
        out[:, 2] = np.divide((da * db).sum(1), np.sqrt((da * da).sum(1) * (db * db).sum(1)), out=np.full(m, np.nan), where=varied)
    if n >= 3:
        mid = x[:, 1:-1]
        out[:, 1] = ((mid > x[:, :-2]) & (mid > x[:, 2:]) & (mid > 0.5 * x.max(1, keepdims=True))).sum(1)
    return out


#: Features of a slot's values in order of time, by kind.
KINDS = {"waves": ("entropy", "frequency", "power_low", "power_mid", "power_high"), "sample": ("sample_entropy",), "turns": ("crossings", "peaks", "autocorr")}


def in_order(value: Column, ts: str, tie: str) -> Column:
    """Aggregate: a slot's values that are no null, in order of time; for slots of bounded size."""
    listed = F.sort_array(F.collect_list(F.when(value.isNotNull() & ~F.isnan(value), F.struct(F.col(ts).alias("t"), F.col(tie).alias("i"), value.cast("double").alias("x")))))
    return listed["x"]


def with_shapes(slots: DataFrame, arrays: dict[str, tuple[str, float | None, tuple[str, ...]]]) -> DataFrame:
    """``slots`` with ``<prefix><feature>`` of its array columns, which go: prefix to (column, rate, kinds).

    A null rate is the number of values.  A batch's slots of one length are computed together.
    """
    kept = [f for f in slots.schema if f.name not in {c for c, _, _ in arrays.values()}]
    added = {p: [n for k in kinds for n in KINDS[k]] for p, (_, _, kinds) in arrays.items()}
    schema = StructType([*kept, *(StructField(p + n, DoubleType()) for p, names in added.items() for n in names)])

    def shapes(column: pa.Array, rate: float | None, kinds: tuple[str, ...], width: int) -> np.ndarray:
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        flat, edge = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros((len(sizes), width))
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            x = flat[edge[own][:, None] + np.arange(n)]
            of = {"waves": lambda x=x, n=n: spectrum(x, n if rate is None else rate), "sample": lambda x=x: sample_entropy(x)[:, None], "turns": lambda x=x: turns(x)}
            out[own] = np.concatenate([of[k]() for k in kinds], axis=1) if n else 0.0
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, names = [batch.column(f.name) for f in kept], [f.name for f in kept]
            for prefix, (name, rate, kinds) in arrays.items():
                out = shapes(batch.column(name), rate, kinds, len(added[prefix]))
                columns += [pa.array(out[:, j], from_pandas=True) for j in range(out.shape[1])]  # nan becomes null
                names += [prefix + n for n in added[prefix]]
            yield pa.record_batch(columns, names)

    return slots.mapInArrow(run, schema)


def spectra(df: DataFrame, value: str, *, slot: list[str], ts: str, tie: str, rate: float, waves: bool = True, sample: bool = True) -> DataFrame:
    """Spectral features (``waves``) and sample entropy (``sample``) of each slot; slots are of bounded size, a second or an hour."""
    kinds = tuple(k for k, on in (("waves", waves), ("sample", sample)) if on)
    slots = df.groupBy(*slot).agg(in_order(F.col(value), ts, tie).alias("_x"))
    return with_shapes(slots, {"": ("_x", rate, kinds)})


def sample_entropy_of_any_size(df: DataFrame, value: str, *, slot: list[str], ts: str, tie: str, r: float = 0.2, chunk_us: int = HOUR) -> DataFrame:
    """``sample_entropy`` of slots without a bound, from joins alone.

    Templates lie in cells as wide as the radius, by their first two values; only templates of neighbouring cells
    are compared, and the matches are counted where they arise.
    """
    held = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*slot, ts, tie, F.col(value).cast("double").alias("x0"))
    along = {"key": slot, "chunk": time_chunk(ts, chunk_us)}
    rows = running_sums(held, {"_place": F.lit(1).cast("long")}, by=[F.col(ts), F.col(tie)], **along).select(*slot, F.col("_place").alias("i"), "x0")
    # a template's second and third value are those of the places after it
    ahead = lambda k: rows.select(*slot, (F.col("i") - k).alias("i"), F.col("x0").alias(f"x{k}"))
    radius = held.groupBy(*slot).agg((r * F.stddev_pop("x0")).alias("r"), F.count("*").alias("n"))
    cell = lambda c: F.floor(F.col(c) / F.col("r"))
    whole = null_safe(null_safe(rows, ahead(1), [*slot, "i"], "inner"), ahead(2), [*slot, "i"], "left")
    placed = null_safe(whole, radius.filter("n >= 4 and r > 0"), slot, "inner").select(*slot, "i", "r", "x0", "x1", "x2", cell("x0").alias("c0"), cell("x1").alias("c1"))
    placed = materialize(placed, "templates")  # both sides of the join
    near = [F.struct((F.col("c0") + a).alias("c0"), (F.col("c1") + b).alias("c1")) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    other = placed.select(*slot, F.col("i").alias("j"), *(F.col(f"x{k}").alias(f"y{k}") for k in range(3)), F.inline(F.array(*near)))
    close = lambda k: F.abs(F.col(f"x{k}") - F.col(f"y{k}")) < F.col("r")
    met = null_safe(placed, other, [*slot, "c0", "c1"], "inner").filter((F.col("i") < F.col("j")) & close(0) & close(1))
    counts = met.groupBy(*slot).agg(F.count("*").alias("pairs"), F.count_if(close(2)).alias("triples"))
    share = F.when((F.col("pairs") > 0) & (F.col("triples") > 0), -F.log(F.col("triples") / F.col("pairs")))
    return null_safe(df.select(*slot).distinct(), counts, slot, "left").select(*slot, F.coalesce(share, F.lit(0.0)).alias("sample_entropy"))
