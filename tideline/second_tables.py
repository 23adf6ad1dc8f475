"""The two per-second tables on ``events``, and the same tables as DuckDB SQL.

An event type is a recording.  Time runs 8640 times as fast, so that a second holds some ten rows; the
axes are made from ``value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import times
from .operators.figures import Figures
from .plans import movement

SPEED = 8640
SERIES = {"key": "event_type", "ts": "ts", "tie": "event_id"}
#: The whole table lies in some five minutes; an hour's chunk would be a recording.
CHUNK_US = 5_000_000
#: Digits to which columns are rounded where five are too many for sums of squares.
DIGITS = {"RotEnergy_1s_mean": 1, "RotEnergy_1s_max": 1, "RotEnergy_1s_sum": 1, "Skewness": 4, "Kurtosis": 4}

_TIMES = f"SELECT event_id, event_type, value, make_timestamp(epoch_us(ts) // {SPEED}) AS ts, epoch_us(ts) // {SPEED} AS us FROM events"
_ORDER = "(PARTITION BY event_type ORDER BY ts, event_id)"
_SLOT = "PARTITION BY event_type, second"
_FRAME = "(PARTITION BY event_type ORDER BY us RANGE BETWEEN 999999 PRECEDING AND 1000000 FOLLOWING)"
_KEYS = "event_type, second"


def _wrapped(x: str) -> str:
    return f"CASE WHEN {x} > 180 THEN {x} - 360 WHEN {x} < -180 THEN {x} + 360 ELSE {x} END"


def _shape(rows: str, value: str) -> str:
    return f"""SELECT {_KEYS}, coalesce(stddev_pop(v) / nullif(avg(v), 0), 0) AS cv, CASE WHEN count(v) >= 3 THEN coalesce(CASE WHEN stddev_pop(v) > 0 THEN skewness(v) END, 0) ELSE 0 END AS skew, CASE WHEN count(v) >= 4 THEN coalesce(CASE WHEN stddev_pop(v) > 0 THEN kurtosis(v) END, 0) ELSE 0 END AS kurt,
quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, sqrt(avg(v * v)) AS rms, coalesce(sum(abs(sign(v) - sign(b))), 0) / 2 AS crossings, CAST(count(*) FILTER (v > b AND v > a AND v > 0.5 * top) AS BIGINT) AS peaks,
CASE WHEN count(v) < 2 THEN 0 WHEN stddev_pop(v) FILTER (b IS NOT NULL) > 0 AND stddev_pop(b) > 0 THEN covar_pop(v, b) / (stddev_pop(v) FILTER (b IS NOT NULL) * stddev_pop(b)) END AS autocorr
FROM (SELECT {_KEYS}, {value} AS v, lag({value}) OVER ({_SLOT} ORDER BY ts, event_id) AS b, lead({value}) OVER ({_SLOT} ORDER BY ts, event_id) AS a, max({value}) OVER ({_SLOT}) AS top FROM {rows}) GROUP BY ALL"""


def _waves(rows: str, value: str, rate: str = "10.0") -> str:
    return f"""SELECT u.event_type, u.second, coalesce(entropy, 0) AS entropy, coalesce(frequency, 0) AS frequency, coalesce(low, 0) AS power_low, coalesce(mid, 0) AS power_mid, coalesce(high, 0) AS power_high, CASE WHEN aa > 0 AND bb > 0 THEN -ln(aa / bb) ELSE 0 END AS sample_entropy
FROM (SELECT DISTINCT {_KEYS} FROM {rows}) u
LEFT JOIN (WITH p AS (SELECT {_KEYS}, {value} AS x, row_number() OVER ({_SLOT} ORDER BY ts, event_id) - 1 AS t, count(*) OVER ({_SLOT}) AS n FROM {rows}), k AS (SELECT DISTINCT {_KEYS}, n, unnest(range(0, n)) AS k FROM p WHERE n >= 3),
f AS (SELECT {_KEYS}, p.n, k.k, pow(sum(x * cos(2 * pi() * ((t * k.k) % p.n) / p.n)), 2) + pow(sum(x * sin(2 * pi() * ((t * k.k) % p.n) / p.n)), 2) AS w FROM p JOIN k USING (event_type, second) GROUP BY ALL),
e AS (SELECT {_KEYS}, CASE WHEN max(total) > 0 THEN -sum(w / nullif(total, 0) * log2(w / nullif(total, 0) + 1e-10)) END AS entropy FROM (SELECT *, sum(w) OVER ({_SLOT}) AS total FROM f) GROUP BY ALL),
q AS (SELECT *, k * {rate} / n AS freq, max(w) OVER ({_SLOT}) AS top FROM f WHERE k BETWEEN 1 AND (n - 1) // 2)
SELECT * FROM e LEFT JOIN (SELECT {_KEYS}, min(freq) FILTER (w >= top * (1 - 1e-9)) AS frequency, coalesce(sum(w) FILTER (freq < 1), 0) / nullif(sum(w), 0) AS low, coalesce(sum(w) FILTER (freq >= 1 AND freq < 4), 0) / nullif(sum(w), 0) AS mid, coalesce(sum(w) FILTER (freq >= 4), 0) / nullif(sum(w), 0) AS high FROM q GROUP BY ALL) USING (event_type, second)) USING (event_type, second)
LEFT JOIN (WITH p AS (SELECT {_KEYS}, {value} AS x, row_number() OVER ({_SLOT} ORDER BY ts, event_id) AS i, count(*) OVER ({_SLOT}) AS n, 0.2 * stddev_pop({value}) OVER ({_SLOT}) AS r, lead({value}) OVER ({_SLOT} ORDER BY ts, event_id) AS x1, lead({value}, 2) OVER ({_SLOT} ORDER BY ts, event_id) AS x2 FROM {rows})
SELECT event_type, second, count(*) FILTER (b.i <= b.n - 1 AND greatest(abs(a.x - b.x), abs(a.x1 - b.x1)) < a.r) AS bb, count(*) FILTER (b.i <= b.n - 2 AND greatest(abs(a.x - b.x), abs(a.x1 - b.x1), abs(a.x2 - b.x2)) < a.r) AS aa FROM p a JOIN p b USING (event_type, second) WHERE a.i < b.i AND a.n >= 4 AND a.r > 0 GROUP BY ALL) USING (event_type, second)"""


def _status(rows: str) -> str:
    """``near`` and ``status`` by the speed ``gyro``."""
    return f"""SELECT r.*, CASE WHEN coalesce(gyro > suspicious AND (near > active_base OR gyro / (near + 1) < 10), false) THEN 'Real_Activity' WHEN coalesce(gyro > suspicious AND near < active_base AND gyro / (near + 1) > 10, false) THEN 'Artifact' ELSE 'Normal' END AS status
FROM (SELECT *, greatest(coalesce(lag(gyro) OVER {_ORDER}, 0), coalesce(lead(gyro) OVER {_ORDER}, 0)) AS near FROM {rows}) r LEFT JOIN (SELECT event_type, quantile_cont(gyro, 0.75) FILTER (gyro > 1) AS active_base, CASE WHEN count(*) FILTER (gyro > 1) > 0 THEN greatest(quantile_cont(gyro, 0.999) FILTER (gyro > 1), 300) END AS suspicious FROM {rows} GROUP BY 1) USING (event_type)"""


def _stepped(rows: str, angles: tuple[str, str, str]) -> str:
    steps = ", ".join(f"{_wrapped(f'({a} - lag({a}) OVER {_ORDER})')} AS d{n}" for a, n in zip(angles, movement.AXES))
    inner = f"SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) = 1"
    return f"SELECT *, dt IS NULL OR dt > 3 OR dt <= 0.001 AS bad FROM (SELECT *, (us - lag(us) OVER {_ORDER}) / 1e6 AS dt, {steps} FROM ({inner}))"


def _mean_sd(value: str, name: str) -> str:
    return f"avg({value}) AS {name}_Mean, stddev_samp({value}) AS {name}_Std"


def _share(condition: str, name: str, valid: str = "") -> str:
    flag = f"CASE WHEN coalesce({condition}, false) THEN 1.0 ELSE 0.0 END"
    return f"avg({f'CASE WHEN {valid} THEN {flag} END' if valid else flag}) AS {name}"


def _corr(a: str, b: str) -> str:
    return f"coalesce(CASE WHEN stddev_pop(dyn{a}) * stddev_pop(dyn{b}) <> 0 THEN covar_pop(dyn{a}, dyn{b}) / (stddev_pop(dyn{a}) * stddev_pop(dyn{b})) END, 0) AS Corr_{a}{b}"


def _dominant(spreads: list[str]) -> str:
    nulls = " ".join(f"WHEN {s} IS NULL THEN {k}" for k, s in enumerate(spreads))
    return f"CASE {nulls} {' '.join(f'WHEN {s} = greatest({chr(44).join(spreads)}) THEN {k}' for k, s in enumerate(spreads))} END AS Axis_Dominance"


_XYZ = ("X", "Y", "Z")
_IMU_AXES = "sin(value * 5) AS x, sin(value) AS y, cos(value) AS z, 170 * sin(value * 7) AS jx, 170 * sin(value * 3) AS jy, 170 * sin(value * 11) AS jz"
_IMU_BY_AXIS = ", ".join(f"{_mean_sd(f'dyn{n}', f'Dyn{n}')}, stddev_samp(d{n}) AS Ang{n}_Std, avg(abs(d{n})) AS Ang{n}_Rate, avg(abs(dyn{n})) AS Dyn{n}_Mean_abs" for n in _XYZ)

_IMU_SQL = f"""WITH e AS (SELECT *, {_IMU_AXES} FROM ({_TIMES})), s AS ({_stepped("e", ("jx", "jy", "jz"))}),
g AS (SELECT *, CASE WHEN bad THEN 0 ELSE sqrt(dX * dX + dY * dY + dZ * dZ) / dt END AS gyro, avg(x) OVER {_FRAME} AS xm, avg(y) OVER {_FRAME} AS ym, avg(z) OVER {_FRAME} AS zm, sqrt(x * x + y * y + z * z) AS strength FROM s),
v AS (SELECT *, x - xm AS dynX, y - ym AS dynY, z - zm AS dynZ, sqrt(pow(x - xm, 2) + pow(y - ym, 2) + pow(z - zm, 2)) AS vedba FROM g), a AS ({_status("v")}),
l AS (SELECT event_type, greatest(1.5 * quantile_cont(vedba, 0.5) FILTER (status <> 'Artifact'), 0.01) AS lowest, least(quantile_cont(vedba, 0.999) FILTER (status <> 'Artifact'), 3.0) AS highest FROM a GROUP BY 1),
c AS (SELECT *, CASE WHEN e1 > highest THEN highest ELSE e1 END AS effort, degrees(atan2(ym, sqrt(xm * xm + zm * zm))) AS roll, degrees(atan2(xm, abs(zm))) AS pitch FROM (SELECT *, CASE WHEN e0 < lowest THEN 0 ELSE e0 END AS e1 FROM (SELECT a.*, lowest, highest, CASE WHEN status = 'Artifact' OR strength < 0.2 THEN 0 ELSE vedba END AS e0 FROM a JOIN l USING (event_type)))),
w AS (SELECT *, date_trunc('second', ts) AS second, CASE WHEN dt <= 0.5 THEN abs(effort - lag(effort) OVER {_ORDER}) END AS jerk, sqrt(roll * roll + pitch * pitch) AS tilt FROM c),
t AS (SELECT event_type, coalesce(quantile_cont(effort, 0.33) FILTER (effort > 0), 0.01) AS low, coalesce(quantile_cont(effort, 0.75) FILTER (effort > 0), 0.05) AS high, least(greatest(quantile_cont(abs(roll), 0.9), 40), 80) AS lying, coalesce(quantile_cont(pitch, 0.75) FILTER (pitch > 0), 10) AS head_down, coalesce(quantile_cont(gyro, 0.75) FILTER (gyro > 1), 10) AS active FROM w GROUP BY 1),
b AS (SELECT {_KEYS}, avg(effort) AS Acc_Mean, sum(effort) AS Acc_Sum, max(effort) AS Acc_Max, min(effort) AS Acc_Min, max(effort) - min(effort) AS Acc_Range, stddev_samp(effort) AS Acc_Std, avg(gyro) AS Gyro_Mean, max(gyro) AS Gyro_Max, count(x) AS Data_Count, {_IMU_BY_AXIS}, {_mean_sd("strength", "AccMag")}, {_mean_sd("roll", "Roll")}, {_mean_sd("pitch", "Pitch")}, avg(jerk) AS Jerk_Mean, {_mean_sd("tilt", "Tilt_Mag")},
{_share("gyro > active", "Active_Fraction")}, {_share("effort <= low", "Frac_Rest")}, {_share("effort > low AND effort <= high", "Frac_Moderate")}, {_share("effort > high", "Frac_Vigorous")}, {_share("abs(roll) > lying", "Frac_Lying")}, {_share("pitch > head_down", "Frac_HeadDown")}, {_corr("X", "Y")}, {_corr("X", "Z")}, {_corr("Y", "Z")} FROM w JOIN t USING (event_type) GROUP BY ALL)
SELECT b.*, DynX_Mean_abs + DynY_Mean_abs + DynZ_Mean_abs AS ODBA, {_dominant([f"Ang{n}_Std" for n in _XYZ])}, cv AS Coefficient_of_Variation, skew AS Skewness, kurt AS Kurtosis, p25 AS Acc_P25, p75 AS Acc_P75, rms AS VeDBA_RMS, crossings AS Zero_Crossing_Rate, peaks AS Peak_Count, autocorr AS Autocorr_Lag1,
entropy AS Spectral_Entropy, frequency AS Dominant_Frequency, power_low AS Power_Low, power_mid AS Power_Loco, power_high AS Power_High, sample_entropy AS Sample_Entropy FROM b JOIN ({_shape("w", "effort")}) USING ({_KEYS}) JOIN ({_waves("w", "effort")}) USING ({_KEYS})"""

_ANGLE_AXES = "CASE WHEN value < 12 THEN 0 ELSE 170 * sin(value * 7) END AS x, CASE WHEN value < 12 THEN 0 ELSE 170 * sin(value * 3) END AS y, CASE WHEN value < 12 THEN 0 ELSE 170 * sin(value * 11) END AS z"
_FILLED = ", ".join(f"CASE WHEN st AND k >= 3 THEN (coalesce(before_{a}, after_{a}) + coalesce(after_{a}, before_{a})) / 2 ELSE {a} END AS {a}" for a in "xyz")
_LAGS = ", ".join(f"lag({a}) OVER {_ORDER} AS before_{a}, lead({a}) OVER {_ORDER} AS after_{a}" for a in "xyz")
_CLEAN = ", ".join(f"CASE WHEN status <> 'Artifact' THEN {c} END AS {c}" for c in ("dX", "dY", "dZ", "angle", "gyro"))
_OF_DZ, _OF_GYRO, _OF_ANGLE = ("(SELECT * FROM w WHERE {0} IS NOT NULL)".format(c) for c in ("dZ", "gyro", "angle"))

_ANGLE_SQL = f"""WITH e AS (SELECT * REPLACE (date_trunc('second', ts) AS ts, us - us % 1000000 AS us), {_ANGLE_AXES} FROM ({_TIMES})), o AS (SELECT *, x = 0 AND y = 0 AND z = 0 AS st FROM e), h AS (SELECT *, CASE WHEN lag(st) OVER {_ORDER} IS NOT DISTINCT FROM st AND row_number() OVER {_ORDER} > 1 THEN 0 ELSE 1 END AS ch FROM o), r AS (SELECT *, sum(ch) OVER {_ORDER} AS run FROM h),
i AS (SELECT event_id, event_type, ts, us, {_FILLED} FROM (SELECT *, count(*) OVER (PARTITION BY event_type, run) AS k, {_LAGS} FROM r)),
z AS (SELECT event_id, event_type, make_timestamp(us) AS ts, us, x, y, z FROM (SELECT * REPLACE (us + CAST(floor((row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) - 1) * 1000000 / count(*) OVER (PARTITION BY event_type, ts)) AS BIGINT) AS us) FROM i)),
s AS (SELECT * REPLACE (CASE WHEN NOT bad THEN dX END AS dX, CASE WHEN NOT bad THEN dY END AS dY, CASE WHEN NOT bad THEN dZ END AS dZ) FROM ({_stepped("z", ("x", "y", "z"))})),
g AS (SELECT *, sqrt(dX * dX + dY * dY + dZ * dZ) AS angle, sqrt(dX * dX + dY * dY + dZ * dZ) / CASE WHEN dt > 0 THEN dt END AS gyro FROM s), j AS (SELECT *, CASE WHEN dt <= 0.5 THEN abs(gyro - lag(gyro) OVER {_ORDER}) END AS jerk FROM g), a AS ({_status("j")}),
w AS (SELECT * REPLACE ({_CLEAN}), avg(x) OVER {_FRAME} AS xm, avg(y) OVER {_FRAME} AS ym, date_trunc('second', ts) AS second FROM a),
t AS (SELECT event_type, coalesce(quantile_cont(angle, 0.33) FILTER (angle > 0), 0.01) AS low, coalesce(quantile_cont(angle, 0.75) FILTER (angle > 0), 0.05) AS high, least(greatest(quantile_cont(abs(xm), 0.9), 20), 60) AS lying, coalesce(quantile_cont(gyro, 0.75) FILTER (gyro > 1), 10) AS active FROM w GROUP BY 1),
b AS (SELECT {_KEYS}, avg(angle) AS Angle_Mean, coalesce(sum(angle), 0) AS Angle_Sum, max(angle) AS Angle_Max, min(angle) AS Angle_Min, max(angle) - min(angle) AS Angle_Range, stddev_samp(angle) AS Angle_Std, avg(gyro) AS Gyro_Mean, max(gyro) AS Gyro_Max, avg(gyro * gyro) AS RotEnergy_1s_mean, max(gyro * gyro) AS RotEnergy_1s_max, coalesce(sum(gyro * gyro * dt), 0) AS RotEnergy_1s_sum, count(x) AS Data_Count, count(angle) AS Valid_Sample_Count, avg(jerk) AS Jerk_Mean,
{", ".join(f"stddev_samp(d{n}) AS d{n}_Std, avg(abs(d{n})) AS d{n}_Mean" for n in _XYZ)}, {_mean_sd("xm", "Euler_X_lpf")}, {_mean_sd("xm", "Roll")}, {_mean_sd("ym", "Euler_Y_lpf")}, {_mean_sd("ym", "Pitch")},
{_share("gyro > active", "Active_Fraction", "angle IS NOT NULL")}, {_share("angle <= low", "Frac_Rest", "angle IS NOT NULL")}, {_share("angle > low AND angle <= high", "Frac_Moderate", "angle IS NOT NULL")}, {_share("angle > high", "Frac_Vigorous", "angle IS NOT NULL")}, {_share("abs(xm) > lying", "Frac_Lying", "angle IS NOT NULL")} FROM w JOIN t USING (event_type) GROUP BY ALL HAVING count(angle) > 0)
SELECT b.*, {_dominant([f"d{n}_Std" for n in _XYZ])}, z.entropy AS Spectral_Entropy_dz, z.frequency AS Dominant_Frequency_dz, y.crossings AS Zero_Crossing_Rate_dz, y.peaks AS Peak_Count_dz, q.entropy AS Spectral_Entropy_GMag, q.frequency AS Dominant_Frequency_GMag, p.crossings AS Zero_Crossing_Rate_GMag, p.peaks AS Peak_Count_GMag,
n.cv AS Coefficient_of_Variation, n.skew AS Skewness, n.kurt AS Kurtosis, n.p25 AS Angle_P25, n.p75 AS Angle_P75, n.autocorr AS Autocorr_Lag1, z.entropy AS Spectral_Entropy, y.crossings AS Zero_Crossing_Rate, z.frequency AS Dominant_Frequency, y.peaks AS Peak_Count
FROM b LEFT JOIN ({_waves(_OF_DZ, "dZ", "n")}) z USING ({_KEYS}) LEFT JOIN ({_shape(_OF_DZ, "dZ")}) y USING ({_KEYS}) LEFT JOIN ({_waves(_OF_GYRO, "gyro", "n")}) q USING ({_KEYS}) LEFT JOIN ({_shape(_OF_GYRO, "gyro")}) p USING ({_KEYS}) LEFT JOIN ({_shape(_OF_ANGLE, "angle")}) n USING ({_KEYS})"""

#: The steps of the angle job up to the status of its samples.
_ANGLE_STEPS = _ANGLE_SQL[: _ANGLE_SQL.index("w AS (SELECT * REPLACE")].rstrip().rstrip(",")
COUNTS_SQL = f"""{_ANGLE_STEPS} SELECT 'read' AS step, 'rows' AS figure, count(*) AS value FROM e UNION ALL SELECT 'read', 'incomplete', count(*) FILTER (ts IS NULL OR x IS NULL OR y IS NULL OR z IS NULL) FROM e
UNION ALL SELECT 'zeros', 'filled', count(*) FILTER (st AND k >= 3) FROM (SELECT *, count(*) OVER (PARTITION BY event_type, run) AS k FROM r)
UNION ALL SELECT 'times', 'kept', count(*) FROM s UNION ALL SELECT 'times', 'gaps', count(*) FILTER (dt > 3) FROM s
UNION ALL SELECT 'activity', 'real', count(*) FILTER (status = 'Real_Activity') FROM a UNION ALL SELECT 'activity', 'artifact', count(*) FILTER (status = 'Artifact') FROM a"""

#: Columns of the tables that are not rounded.
_WHOLE = ("event_type", "second", "Data_Count", "Valid_Sample_Count", "Axis_Dominance", "Peak_Count", "Peak_Count_dz", "Peak_Count_GMag")


def _listed(sql: str, names: tuple[str, ...]) -> list[str]:
    return [n for n in names if n in ("event_type", "second") or f" AS {n}" in sql]


def _sql(sql: str) -> str:
    """Whole columns as they are, the others rounded."""
    whole, few = _listed(sql, _WHOLE), _listed(sql, tuple(DIGITS))
    return f"SELECT {', '.join(whole)}, {', '.join(f'round({c}, {DIGITS[c]}) AS {c}' for c in few)}, round(COLUMNS(* EXCLUDE ({', '.join([*whole, *few])})), 5) FROM ({sql})"


IMU_SQL, ANGLE_SQL = _sql(_IMU_SQL), _sql(_ANGLE_SQL)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", "event_type", "value", times.from_micros(F.floor(times.micros("ts") / SPEED).cast("long")).alias("ts"))


def _round(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c) if c in _WHOLE else F.round(c, DIGITS.get(c, 5)).alias(c) for c in df.columns))


def imu_second_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = _rows(spark, sf_dir).select("event_id", "event_type", "ts", F.sin(v * 5).alias("x"), F.sin(v).alias("y"), F.cos(v).alias("z"), (F.sin(v * 7) * 170).alias("jx"), (F.sin(v * 3) * 170).alias("jy"), (F.sin(v * 11) * 170).alias("jz"))
    return _round(movement.imu_seconds(movement.imu_samples(rows, chunk_us=CHUNK_US, **SERIES), **SERIES))


def _angle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    axes = [F.when(v < 12, 0.0).otherwise(F.sin(v * k) * 170).alias(a) for k, a in ((7, "x"), (3, "y"), (11, "z"))]
    return _rows(spark, sf_dir).select("event_id", "event_type", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), *axes)


def angle_second_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(movement.angle_seconds(movement.angle_samples(_angle_rows(spark, sf_dir), chunk_us=CHUNK_US, **SERIES), **SERIES))


def angle_cleaning_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the angle job counts beside its rows."""
    figures = Figures()
    movement.angle_samples(_angle_rows(spark, sf_dir), figures=figures, chunk_us=CHUNK_US, **SERIES)
    return figures.table(spark)
