"""Queries on the driver's tables that exercise the operators, each with its DuckDB SQL.

The tables hold no recordings: ``events`` stands in, a user being a series, half an hour a slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import second_tables
from .functions import times, vectors
from .operators import anomaly, beats, features, quality, quantiles, signals, timeline
from .plans import movement, report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SERIES = {"key": "user_id", "ts": "ts", "tie": "event_id"}
_US = "epoch_us(ts)"
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.dense_counts(events(spark, sf_dir), ts="ts", width="30 minutes").withColumn("status", quality.rate_status(F.col("n")))


_SLOTS = """WITH c AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS slot, count(*) AS n FROM events GROUP BY 1),
g AS (SELECT unnest(generate_series(min(slot), max(slot), INTERVAL '30 minutes')) AS slot FROM c),
s AS (SELECT g.slot, coalesce(c.n, 0) AS n, CASE WHEN coalesce(c.n, 0) = 0 THEN 'missing' WHEN c.n < 5 THEN 'too_low' WHEN c.n > 15 THEN 'too_high' ELSE 'normal' END AS status FROM g LEFT JOIN c USING (slot))"""
_PIVOT = "count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'too_low') AS too_low, count(*) FILTER (status = 'normal') AS normal, count(*) FILTER (status = 'too_high') AS too_high"


@register(f"{_SLOTS} SELECT CAST(slot AS DATE) AS day, {_PIVOT} FROM s GROUP BY 1")
def sampling_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.status_by(_slots(spark, sf_dir), F.to_date("slot"), "day")


@register(f"{_SLOTS}, p AS (SELECT CAST(slot AS DATE) AS day, {_PIVOT} FROM s GROUP BY 1) SELECT *, too_low + too_high AS score FROM p WHERE too_low + too_high > 0 ORDER BY score DESC, day LIMIT 10")
def sampling_worst_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.worst(sampling_quality(spark, sf_dir), "day")


@register(f"{_SLOTS} SELECT status, count(*) AS slots FROM s GROUP BY 1")
def sampling_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).groupBy("status").agg(F.count("*").alias("slots"))


@register(f"{_SLOTS} SELECT CAST(slot AS DATE) AS day, CAST(hour(slot) AS INTEGER) AS hour, round(100.0 * count(*) / 2, 6) AS span_pct, round(100.0 * count(*) FILTER (n > 0) / 2, 6) AS data_pct FROM s GROUP BY 1, 2")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.completeness(_slots(spark, sf_dir), 2)


@register(f"""{_SLOTS}, b AS (SELECT slot, date_trunc('hour', slot) AS h, count(*) OVER (PARTITION BY date_trunc('hour', slot)) AS k FROM s WHERE status IN ('too_low', 'too_high'))
SELECT CAST(h AS TIMESTAMP) AS start, count(*) AS slots FROM b WHERE k = 2 GROUP BY 1 UNION ALL SELECT slot, 1 FROM b WHERE k < 2""")
def abnormal_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.abnormal_stretches(_slots(spark, sf_dir), 2)


@register(f"WITH d AS (SELECT user_id, lag(ts) OVER {_W} AS gap_start, ts AS gap_end, ({_US} - lag({_US}) OVER {_W}) / 1e6 AS gap_s FROM events) SELECT user_id, gap_start, gap_end, round(gap_s, 6) AS gap_s FROM d WHERE gap_s > 86400")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.gaps(events(spark, sf_dir), **SERIES, longer_than=86_400, chunk_us=86_400_000_000).withColumn("gap_s", r6("gap_s"))


@register(f"SELECT event_id, round(avg(value) OVER f, 6) AS value_mean, count(*) OVER f AS rows_in_frame FROM events WINDOW f AS (PARTITION BY user_id ORDER BY {_US} RANGE BETWEEN 43199999999 PRECEDING AND 43200000000 FOLLOWING)")
def centred_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.centred_mean(events(spark, sf_dir), ["value"], key="user_id", ts="ts", half_us=43_200_000_000)
    return out.select("event_id", r6("value_mean").alias("value_mean"), "rows_in_frame")


_RUNS = f"""WITH a AS (SELECT *, event_type = 'error' AS st FROM events), c AS (SELECT *, CASE WHEN lag(st) OVER {_W} IS NOT DISTINCT FROM st AND row_number() OVER {_W} > 1 THEN 0 ELSE 1 END AS ch FROM a),
r AS (SELECT *, sum(ch) OVER {_W} AS run FROM c)"""


@register(f"{_RUNS} SELECT event_id, CAST(run AS BIGINT) AS run, count(*) OVER (PARTITION BY user_id, run) AS run_length FROM r")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.runs(events(spark, sf_dir), F.col("event_type") == "error", **SERIES, chunk_us=86_400_000_000).select("event_id", "run", "run_length")


@register(f"""WITH e AS (SELECT *, CASE WHEN value > 60 THEN 0.0 ELSE value END AS v FROM events), a AS (SELECT *, v = 0 AS st FROM e), c AS (SELECT *, CASE WHEN lag(st) OVER {_W} IS NOT DISTINCT FROM st AND row_number() OVER {_W} > 1 THEN 0 ELSE 1 END AS ch FROM a),
r AS (SELECT *, sum(ch) OVER {_W} AS run FROM c), l AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS k, lag(v) OVER {_W} AS b, lead(v) OVER {_W} AS n FROM r)
SELECT event_id, round(CASE WHEN st AND k >= 3 THEN (coalesce(b, n) + coalesce(n, b)) / 2 ELSE v END, 6) AS v, st AND k >= 3 AS filled FROM l""")
def zero_runs_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("v", F.when(F.col("value") > 60, 0.0).otherwise(F.col("value")))
    return timeline.fill_joint_zeros(rows, ["v"], **SERIES, chunk_us=86_400_000_000).select("event_id", r6("v").alias("v"), "filled")


@register("""WITH e AS (SELECT *, epoch_us(date_trunc('day', ts)) AS d FROM events)
SELECT event_id, d + CAST(floor((row_number() OVER (PARTITION BY user_id, d ORDER BY event_id) - 1) * 1000000 / count(*) OVER (PARTITION BY user_id, d)) AS BIGINT) AS spread_us FROM e""")
def repeats_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("day", F.to_date("ts").cast("timestamp_ntz"))
    return timeline.spread_repeats(rows, key="user_id", ts="day", tie="event_id").select("event_id", "spread_us")


@register("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) = 1")
def first_of_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn("series", F.struct("user_id", "event_type"))
    return timeline.first_of_time(rows, key="series", ts="day", tie="event_id").select("user_id", "event_type", "event_id")


_CLOCK = f"""WITH e AS (SELECT *, epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS full_us FROM events), c AS (SELECT *, full_us - full_us % 1000 AS clock FROM e), s AS (SELECT *, clock - lag(clock) OVER {_W} AS step, lag(clock) OVER {_W} AS b FROM c)"""


@register(f"{_CLOCK} SELECT event_id, clock, CAST(sum(CASE WHEN coalesce(step < -7200000000 OR (step < -1800000000 AND b >= 84600000000 AND clock <= 1800000000), false) THEN 1 ELSE 0 END) OVER {_W} AS INTEGER) AS days FROM s")
def clock_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = times.clock_micros(F.date_format("ts", "HH:mm:ss.SSS"))
    rows = events(spark, sf_dir).withColumn("clock", clock)
    return timeline.rollover_days(rows, key="user_id", clock_us="clock", tie=["ts", "event_id"], back_s=7200, midnight=True, chunk=timeline.time_chunk("ts", 86_400_000_000)).select("event_id", "clock", "days")


_THRESHOLDS = "SELECT event_type, quantile_cont(value, 0.75) FILTER (value > 1) AS active_base, greatest(quantile_cont(value, 0.99) FILTER (value > 1), 50) AS suspicious FROM events GROUP BY 1"


def _speeds(df: DataFrame) -> DataFrame:
    return anomaly.speed_thresholds(df, "value", key="event_type", floor=50.0, suspicious_p=0.99)


@register(f"SELECT event_type, round(active_base, 6) AS active_base, round(suspicious, 6) AS suspicious FROM ({_THRESHOLDS})")
def speed_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speeds(events(spark, sf_dir)).select("event_type", r6("active_base").alias("active_base"), r6("suspicious").alias("suspicious"))


_STATUS = f"""WITH t AS ({_THRESHOLDS}), e AS (SELECT *, greatest(coalesce(lag(value) OVER {_W}, 0), coalesce(lead(value) OVER {_W}, 0)) AS near FROM events),
a AS (SELECT e.*, value / (near + 1) AS isolation, CASE WHEN value > suspicious AND (near > active_base OR value / (near + 1) < 10) THEN 'Real_Activity' WHEN value > suspicious AND near < active_base AND value / (near + 1) > 10 THEN 'Artifact' ELSE 'Normal' END AS status FROM e JOIN t USING (event_type))"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return anomaly.activity_status(rows, "value", _speeds(rows), key="event_type", series="user_id", ts="ts", tie="event_id")


@register(f"{_STATUS} SELECT event_id, status, round(isolation, 6) AS isolation FROM a")
def activity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).select("event_id", "status", r6("isolation").alias("isolation"))


@register(f"{_STATUS}, f AS (SELECT user_id, min(ts) AS centre FROM a WHERE status = 'Real_Activity' GROUP BY 1) SELECT event_id, centre FROM a JOIN f USING (user_id) WHERE ts BETWEEN centre - INTERVAL '86400 seconds' AND centre + INTERVAL '86400 seconds'")
def around_first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.around_first(_status(spark, sf_dir), F.col("status") == "Real_Activity", key="user_id", ts="ts", seconds=86_400).select("event_id", "centre")


@register(f"""{_STATUS}, l AS (SELECT event_type, greatest(1.5 * quantile_cont(value, 0.5) FILTER (status <> 'Artifact') / 4, 0.01) AS f, least(quantile_cont(value, 0.999) FILTER (status <> 'Artifact'), 300.0) AS c FROM a GROUP BY 1)
SELECT event_id, round(CASE WHEN x > c THEN c ELSE x END, 6) AS effort FROM (SELECT *, CASE WHEN x0 < f THEN 0.0 ELSE x0 END AS x FROM (SELECT a.event_id, f, c, CASE WHEN status = 'Artifact' OR value < 0.2 THEN 0.0 ELSE value END AS x0 FROM a JOIN l USING (event_type)))""")
def cleaned_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _status(spark, sf_dir)
    limits = anomaly.effort_limits(rows, "value", key="event_type", factor=1.5 / 4, highest=300.0).toDF("event_type", "f", "c")
    v = F.col("value")
    return rows.join(limits, "event_type").select("event_id", r6(anomaly.cleaned_effort(v, F.col("status"), v, F.col("f"), F.col("c"))).alias("effort"))


@register("SELECT event_type, round(coalesce(quantile_cont(value, 0.33) FILTER (value > 0), 0.01), 6) AS low, round(coalesce(quantile_cont(value, 0.75) FILTER (value > 0), 0.05), 6) AS high, round(least(greatest(quantile_cont(abs(value), 0.9), 40), 80), 6) AS lying, round(coalesce(quantile_cont(value, 0.75) FILTER (value > 1), 10), 6) AS active FROM events GROUP BY 1")
def behaviour_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anomaly.behaviour_thresholds(events(spark, sf_dir), key="event_type", effort="value", roll="value", speed="value")
    return out.select("event_type", *(r6(c).alias(c) for c in ("low", "high", "lying", "active")))


@register(f"""WITH p AS (SELECT *, row_number() OVER {_W} AS i, lag(value) OVER {_W} AS b, lead(value) OVER {_W} AS a, max(value) OVER (PARTITION BY user_id) AS top FROM events)
SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, round(max(value), 6) AS high, round(min(value), 6) AS low, round(stddev_samp(value), 6) AS sd, round(stddev_pop(value) / avg(value), 6) AS cv,
round(CASE WHEN count(value) >= 3 THEN coalesce(CASE WHEN stddev_pop(value) > 0 THEN skewness(value) END, 0) ELSE 0 END, 6) AS skew, round(CASE WHEN count(value) >= 4 THEN coalesce(CASE WHEN stddev_pop(value) > 0 THEN kurtosis(value) END, 0) ELSE 0 END, 5) AS kurt,
round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(sqrt(avg(value * value)), 6) AS rms, round(coalesce(sum(abs(sign(value) - sign(b))), 0) / 2, 6) AS crossings,
CAST(count(*) FILTER (value > b AND value > a AND value > 0.5 * top) AS BIGINT) AS peaks, round(CASE WHEN stddev_pop(value) FILTER (b IS NOT NULL) > 0 AND stddev_pop(b) > 0 THEN covar_pop(value, b) / (stddev_pop(value) FILTER (b IS NOT NULL) * stddev_pop(b)) WHEN count(value) = 1 THEN 0 END, 6) AS autocorr FROM p GROUP BY 1""")
def slot_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.distribution(events(spark, sf_dir), "value", slot=["user_id"], ts="ts", tie="event_id", chunk_us=86_400_000_000)
    digits = {"total": 4, "kurt": 5}
    return out.select("user_id", "n", "peaks", *(F.round(c, digits.get(c, 6)).alias(c) for c in out.columns if c not in ("user_id", "n", "peaks")))


@register(f"""WITH p AS (SELECT user_id, value AS x, row_number() OVER {_W} - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events), k AS (SELECT DISTINCT user_id, n, unnest(range(0, n)) AS k FROM p),
f AS (SELECT p.user_id, p.n, k.k, pow(sum(x * cos(2 * pi() * ((t * k.k) % p.n) / p.n)), 2) + pow(sum(x * sin(2 * pi() * ((t * k.k) % p.n) / p.n)), 2) AS w FROM p JOIN k ON p.user_id = k.user_id WHERE p.n >= 3 GROUP BY 1, 2, 3),
e AS (SELECT user_id, -sum(w / total * log2(w / total + 1e-10)) AS entropy FROM (SELECT *, sum(w) OVER (PARTITION BY user_id) AS total FROM f) GROUP BY 1),
q AS (SELECT *, k * 10.0 / n AS freq, max(w) OVER (PARTITION BY user_id) AS top FROM f WHERE k BETWEEN 1 AND (n - 1) // 2),
d AS (SELECT user_id, min(freq) FILTER (w >= top * (1 - 1e-9)) AS frequency, coalesce(sum(w) FILTER (freq < 1), 0) / sum(w) AS a, coalesce(sum(w) FILTER (freq >= 1 AND freq < 4), 0) / sum(w) AS b, coalesce(sum(w) FILTER (freq >= 4), 0) / sum(w) AS c FROM q GROUP BY 1)
SELECT u.user_id, round(coalesce(entropy, 0), 5) AS entropy, round(coalesce(frequency, 0), 6) AS frequency, round(coalesce(a, 0), 5) AS power_low, round(coalesce(b, 0), 5) AS power_mid, round(coalesce(c, 0), 5) AS power_high FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN e USING (user_id) LEFT JOIN d USING (user_id)""")
def slot_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's whole history is a slot."""
    out = features.spectra(events(spark, sf_dir), "value", slot=["user_id"], ts="ts", tie="event_id", rate=10.0, sample=False)
    return out.select("user_id", *(F.round(c, 6 if c == "frequency" else 5).alias(c) for c in ("entropy", "frequency", "power_low", "power_mid", "power_high")))


@register(f"""WITH p AS (SELECT user_id, value AS x, row_number() OVER {_W} AS i, count(*) OVER (PARTITION BY user_id) AS n, 0.2 * stddev_pop(value) OVER (PARTITION BY user_id) AS r, lead(value) OVER {_W} AS x1, lead(value, 2) OVER {_W} AS x2 FROM events),
m AS (SELECT a.user_id, count(*) FILTER (a.i <= a.n - 1 AND b.i <= a.n - 1 AND greatest(abs(a.x - b.x), abs(a.x1 - b.x1)) < a.r) AS bb, count(*) FILTER (a.i <= a.n - 2 AND b.i <= a.n - 2 AND greatest(abs(a.x - b.x), abs(a.x1 - b.x1), abs(a.x2 - b.x2)) < a.r) AS aa FROM p a JOIN p b ON a.user_id = b.user_id AND a.i < b.i WHERE a.n >= 4 AND a.r > 0 GROUP BY 1)
SELECT u.user_id, round(CASE WHEN aa > 0 AND bb > 0 THEN -ln(aa / bb) ELSE 0 END, 6) AS sample_entropy FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN m USING (user_id)""")
def slot_sample_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's whole history is a slot, so no slot is gathered anywhere."""
    out = features.sample_entropy_of_any_size(events(spark, sf_dir), "value", slot=["user_id"], ts="ts", tie="event_id", chunk_us=86_400_000_000)
    return out.select("user_id", r6("sample_entropy").alias("sample_entropy"))


@register("""WITH e AS (SELECT user_id, date_trunc('hour', ts) AS h, value FROM events WHERE event_type = 'purchase') SELECT user_id, h AS hour, count(*) AS beats, round(sum(value), 4) AS total FROM e GROUP BY 1, 2""")
def hourly_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).filter("event_type = 'purchase'")
    return rows.groupBy("user_id", times.bucket("ts", "1 hour").alias("hour")).agg(F.count("*").alias("beats"), F.round(F.sum("value"), 4).alias("total"))


_FACTORS = [" ".join(f"WHEN m >= {a} THEN {f[k]}" for a, *f in reversed(beats.INTERVAL_BANDS)) for k in (0, 1)]


@register(f"""WITH e AS (SELECT event_id, user_id, ({_US} - lag({_US}) OVER {_W}) / 1000.0 / 40000 AS rr FROM events), m AS (SELECT user_id, avg(rr) AS m FROM e WHERE rr BETWEEN 200 AND 3000 GROUP BY 1)
SELECT event_id, round(rr, 9) AS rr_ms, round(m, 6) AS reference_ms, coalesce(rr < m * CASE {_FACTORS[0]} END OR rr > m * CASE {_FACTORS[1]} END, false) AS abnormal FROM e LEFT JOIN m USING (user_id)""")
def beat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand in for beats, 40 s for a millisecond."""
    out = beats.beat_intervals(events(spark, sf_dir), key="user_id", ts="ts", tie="event_id", unit_us=40_000_000.0, chunk_us=86_400_000_000)
    return out.select("event_id", F.round("rr_ms", 9).alias("rr_ms"), r6("reference_ms").alias("reference_ms"), "abnormal")


@register("""SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_tax * l_tax + l_discount * l_discount), 6) AS magnitude, round(degrees(atan2(l_tax, sqrt(l_quantity * l_quantity + l_discount * l_discount))), 6) AS roll, round(degrees(atan2(l_quantity, abs(l_discount))), 6) AS pitch FROM lineitem""")
def posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", r6(vectors.magnitude(x, y, z)).alias("magnitude"), r6(vectors.roll(x, y, z)).alias("roll"), r6(vectors.pitch(x, y, z)).alias("pitch"))


@register(f"""WITH a AS (SELECT event_id, (value * 7) % 360 - 180 AS g, user_id, ts FROM events), d AS (SELECT event_id, g - lag(g) OVER {_W} AS d FROM a) SELECT event_id, round(CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END, 6) AS turn FROM d""")
def wrapped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts", ((F.col("value") * 7) % 360 - 180).alias("g"))
    near = timeline.beside(rows, {"g": F.col("g")}, **SERIES, chunk_us=86_400_000_000, after=False)
    return near.select("event_id", r6(vectors.wrapped(F.col("g") - F.col("before_g"))).alias("turn"))


@register("""SELECT user_id, round(quantile_cont(value, 0.5) FILTER (hour(ts) >= 23 OR hour(ts) < 4), 6) AS zero_value, count(*) FILTER (hour(ts) >= 23 OR hour(ts) < 4) AS n_samples FROM events GROUP BY 1""")
def posture_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movement.posture_zero(events(spark, sf_dir), key="user_id", ts="ts", axes=["value"]).select("user_id", r6("zero_value").alias("zero_value"), "n_samples")


_FILES = "SELECT strftime(ts, '%Y%m%d') || '_B' || (user_id % 7) AS folder, 'IMU B' || (user_id % 2 + user_id % 7) || ' ' || strftime(ts + INTERVAL '1 hour', '%Y-%m-%d') || '.txt' AS file_name FROM events"


_FOLDERS = f"""WITH f AS ({_FILES}), p AS (SELECT folder, file_name, regexp_extract(folder, '^(\\d{{8}})', 1) AS date, replace(regexp_extract(file_name, '(\\d{{8}}|\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '-', '') AS own, regexp_extract_all(file_name, '\\b([A-Za-z]{{1,3}}\\d{{1,4}})\\b', 1) AS ids FROM f),
g AS (SELECT folder, date, count(*) AS files, CAST(count(*) FILTER (own <> date AND own <> '' AND date <> '') AS BIGINT) AS odd_dates, list_sort(list_distinct(flatten(list(ids)))) AS ids FROM p GROUP BY 1, 2)"""
_FINE = "date <> '' AND files >= 2 AND odd_dates = 0 AND len(ids) <= 1"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("IMU B"), F.col("user_id") % 2 + F.col("user_id") % 7, F.lit(" "), F.date_format(F.col("ts") + F.expr("interval 1 hour"), "yyyy-MM-dd"), F.lit(".txt"))
    return events(spark, sf_dir).select(F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_B"), F.col("user_id") % 7).alias("folder"), name.alias("file_name"))


@register(f"{_FOLDERS} SELECT folder, date, files, odd_dates, array_to_string(ids[1:8], ',') AS ids, {_FINE} AS ok FROM g")
def folder_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.folder_report(_files(spark, sf_dir))


@register(f"""{_FOLDERS} SELECT folder, 'bad_name' AS finding, '' AS file_name, '' AS detail FROM g WHERE date = '' UNION ALL SELECT folder, 'few_files', '', CAST(files AS VARCHAR) FROM g WHERE files < 2
UNION ALL SELECT folder, 'several_ids', '', array_to_string(ids[1:8], ',') FROM g WHERE len(ids) > 1 UNION ALL SELECT folder, 'ok', '', CAST(files AS VARCHAR) FROM g WHERE {_FINE}
UNION ALL SELECT DISTINCT folder, 'date_mismatch', file_name, own FROM p WHERE own <> date AND own <> '' AND date <> ''""")
def folder_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.folder_messages(_files(spark, sf_dir))


@register(f"{_SLOTS} SELECT CAST(least(n, 29) AS INTEGER) AS bin, count(*) AS slots FROM s WHERE n > 0 AND n <= 30 GROUP BY 1")
def rate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_histogram(_slots(spark, sf_dir))


@register("""WITH c AS (SELECT time_bucket(INTERVAL '1 minute', ts) AS m, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1), g AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL '1 minute')) AS m FROM c)
SELECT CAST(g.m AS DATE) AS day, round((epoch_us(g.m) - epoch_us(date_trunc('day', g.m))) / 3600000000.0, 6) AS hours, coalesce(n, 0) AS beats FROM g LEFT JOIN c USING (m)""")
def minute_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of every minute of each day, empty minutes too; purchases stand in for beats."""
    slots = timeline.dense_counts(events(spark, sf_dir).filter("event_type = 'purchase'"), ts="ts", width="1 minute")
    hours = (times.micros("slot") % 86_400_000_000) / F.lit(3_600_000_000.0)
    return slots.select(F.to_date("slot").alias("day"), r6(hours).alias("hours"), F.col("n").alias("beats"))


def _clocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("clock", times.clock_micros(F.date_format("ts", "HH:mm:ss.SSS")))


_CROSSED = f"""{_CLOCK}, x AS (SELECT *, coalesce(step < -7200000000 OR (step < -1800000000 AND b >= 84600000000 AND clock <= 1800000000), false) AS crossed FROM s)"""


@register(f"{_CROSSED} SELECT user_id, count(*) AS rows, count(*) FILTER (crossed) AS crossings, arg_min(clock, (ts, event_id)) AS first_us, arg_max(clock, (ts, event_id)) AS last_us, count(*) FILTER (crossed) >= 2 AS odd FROM x GROUP BY 1")
def rollover_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.rollover_log(_clocked(spark, sf_dir), key="user_id", clock_us="clock", tie=["ts", "event_id"], back_s=7200, midnight=True, chunk=timeline.time_chunk("ts", 86_400_000_000))


@register(f"""{_CROSSED}, n AS (SELECT user_id, crossed, CAST(sum(CASE WHEN crossed THEN 1 ELSE 0 END) OVER {_W} AS INTEGER) AS number, CAST(row_number() OVER {_W} - 1 AS INTEGER) AS row, b AS before_us, clock AS clock_us FROM x)
SELECT user_id, number, row, before_us, clock_us, CASE WHEN before_us >= 84600000000 AND clock_us <= 1800000000 THEN 'midnight' ELSE 'long_step' END AS rule FROM n WHERE crossed AND number <= 10""")
def rollover_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.rollover_triggers(_clocked(spark, sf_dir), key="user_id", clock_us="clock", tie=["ts", "event_id"], back_s=7200, midnight=True, chunk=timeline.time_chunk("ts", 86_400_000_000))


_SPAN = "PARTITION BY series, second ORDER BY t, o, x ROWS BETWEEN"


@register(f"""WITH e AS (SELECT event_type AS series, epoch_us(ts) // 86400 AS us, value AS x FROM events), c AS (SELECT *, us // 1000000 AS second, count(*) OVER (PARTITION BY series, us // 1000000) AS n FROM e),
p AS (SELECT series, second, (us - second * 1000000) / 1e6::DOUBLE AS t, x, 0 AS o FROM c WHERE n >= 40 AND n <> 64), g AS (SELECT DISTINCT series, second, unnest(range(0, 64)) / 64.0::DOUBLE AS t, NULL::DOUBLE AS x, 1 AS o FROM p),
m AS (SELECT series, second, t, o, last_value(CASE WHEN o = 0 THEN {{'t': t, 'x': x}} END IGNORE NULLS) OVER ({_SPAN} UNBOUNDED PRECEDING AND CURRENT ROW) AS b, first_value(CASE WHEN o = 0 THEN {{'t': t, 'x': x}} END IGNORE NULLS) OVER ({_SPAN} CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM (SELECT * FROM p UNION ALL SELECT * FROM g))
SELECT series, us, round(x, 6) AS value, false AS resampled FROM c WHERE n < 40 OR n = 64 UNION ALL
SELECT series, second * 1000000 + CAST(floor(t * 1e6::DOUBLE) AS BIGINT), round(CASE WHEN b IS NULL THEN a.x WHEN a IS NULL OR b.t = t THEN b.x ELSE b.x + (t - b.t) * (a.x - b.x) / nullif(a.t - b.t, 0) END, 6), true FROM m WHERE o = 1""")
def resampled_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days stand in for seconds: those of 40 rows of a type or more are brought to 64."""
    us = times.micros("ts")
    rows = events(spark, sf_dir).withColumn("series", F.col("event_type")).withColumn("ts", times.from_micros(F.floor(us / 86_400).cast("long")))
    return beats.resample_seconds(rows, key="series", ts="ts", value="value", rate=64, least=40).withColumn("value", r6("value"))


@register()
def labelled_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen wards of users stand in for recordings at 160 Hz, in windows of three seconds; tested against a plain version on a fixture."""
    rows = events(spark, sf_dir).withColumn("ward", F.col("user_id") % 16)
    return beats.label_beats(rows, key="ward", ts="ts", value="value", fs=160.0, size=480, hop=160)


@register("""WITH m AS (SELECT user_id, time_bucket(INTERVAL '1 minute', ts) AS minute, sum(value) AS activity, avg(value) AS gyro FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT user_id, minute, round(activity, 6) AS activity, round(gyro, 6) AS gyro FROM m QUALIFY sum(activity) OVER (PARTITION BY user_id, CAST(minute AS DATE)) <> 0""")
def daily_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks stand in for seconds with activity."""
    seconds = events(spark, sf_dir).filter("event_type = 'click'").withColumn("second", F.col("ts"))
    out = movement.daily_curves(seconds, key="user_id", activity="value", gyro="value")
    return out.select("user_id", "minute", r6("activity").alias("activity"), r6("gyro").alias("gyro"))


@register(f"{_STATUS}, n AS (SELECT user_id, status, row_number() OVER (PARTITION BY user_id, status ORDER BY ts, event_id) AS number, ts, value, near, isolation FROM a WHERE status <> 'Normal') SELECT user_id, status, CAST(number AS INTEGER) AS number, ts, round(value, 6) AS gyro, round(near, 6) AS near, round(isolation, 6) AS isolation FROM n WHERE number <= 3")
def activity_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.examples(_status(spark, sf_dir).withColumn("gyro", F.col("value")), key="user_id", ts="ts", tie="event_id")
    return out.select("user_id", "status", "number", "ts", *(r6(c).alias(c) for c in ("gyro", "near", "isolation")))


@register("""WITH c AS (SELECT event_type, time_bucket(INTERVAL '10 seconds', ts) AS slot, count(*) AS n FROM events GROUP BY 1, 2), e AS (SELECT event_type, min(slot) AS a, max(slot) AS b FROM c GROUP BY 1), g AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL '10 seconds')) AS slot FROM e),
s AS (SELECT event_type, slot, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (event_type, slot)), m AS (SELECT event_type, date_trunc('minute', slot) AS minute, count(*) FILTER (n = 0) AS missing, count(*) FILTER (n = 1) AS too_low, count(*) FILTER (n > 2) AS too_high FROM s GROUP BY 1, 2),
b AS (SELECT *, date_trunc('hour', minute) AS hour, count(*) OVER (PARTITION BY event_type, date_trunc('hour', minute)) AS k FROM m WHERE too_low > 0 OR too_high > 0)
SELECT event_type, CAST(hour AS TIMESTAMP) AS start, true AS whole_hour, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(too_low) AS BIGINT) AS too_low, CAST(sum(too_high) AS BIGINT) AS too_high FROM b WHERE k = 60 GROUP BY 1, 2 UNION ALL SELECT event_type, CAST(minute AS TIMESTAMP), false, missing, too_low, too_high FROM b WHERE k < 60""")
def abnormal_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of ten seconds, two rows being normal."""
    slots = report.sampling(events(spark, sf_dir), key="event_type", ts="ts", width="10 seconds", low=2, high=2)
    return report.abnormal_minutes(slots, key="event_type")


@register(f"""WITH e AS (SELECT *, CASE WHEN value > 30 THEN value END AS v FROM events) SELECT event_id, round(coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS v FROM e""")
def filled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("v", F.when(F.col("value") > 30, F.col("value")))
    return timeline.filled(rows, ["v"], **SERIES, chunk_us=86_400_000_000).select("event_id", r6("v").alias("v"))


@register("""WITH c AS (SELECT event_type, time_bucket(INTERVAL '10 minutes', ts) AS slot, count(*) AS n FROM events GROUP BY 1, 2), e AS (SELECT event_type, min(slot) AS a, max(slot) AS b FROM c GROUP BY 1), g AS (SELECT event_type, a, b, unnest(generate_series(a, b, INTERVAL '10 minutes')) AS slot FROM e)
SELECT g.event_type, g.slot, coalesce(n, 0) AS n, coalesce(n, 0) < 2 AS thin FROM g LEFT JOIN c USING (event_type, slot) WHERE g.slot > a AND g.slot < b""")
def thin_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.thin_slots(events(spark, sf_dir), ts="ts", width="10 minutes", least=2, key="event_type")


@register("SELECT event_type, round(quantile_cont(value, 0.001), 6) AS p001, round(quantile_cont(value, 0.5), 6) AS p5, round(quantile_cont(value, 0.999) FILTER (user_id % 3 = 0), 6) AS p999 FROM events GROUP BY 1")
def selected_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By selection, as for keys of any number of rows."""
    third = F.when(F.col("user_id") % 3 == 0, F.col("value"))
    wanted = {"p001": (F.col("value"), 0.001), "p5": (F.col("value"), 0.5), "p999": (third, 0.999)}
    out = quantiles.exact_quantiles(events(spark, sf_dir), wanted, keys=["event_type"], few=100)
    return out.select("event_type", *(r6(c).alias(c) for c in wanted))


@register()
def filtered_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen wards of users as signals at 160 Hz, 3 to 70 Hz; tested against the filter of one piece."""
    rows = events(spark, sf_dir).withColumn("ward", F.col("user_id") % 16)
    return signals.zero_phase_series(rows, *signals.butterworth(3.0, 70.0, 160.0, 4), key="ward", ts="ts", value="value", size=4096)


register(second_tables.COUNTS_SQL)(second_tables.angle_cleaning_figures)
register(second_tables.IMU_SQL)(second_tables.imu_second_features)
register(second_tables.ANGLE_SQL)(second_tables.angle_second_features)
