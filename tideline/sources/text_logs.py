"""Readers of recordings.  Row order within a file is kept as ``row_no`` where rollover depends on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import clock_micros, from_micros, name_date, name_stem, wall_time
from ..functions.vectors import scaled_adc
from ..operators.timeline import rollover_days

ANGLE = ("timestamp", "x", "y", "z")
IMU = ("timestamp", "x", "y", "z", "jx", "jy", "jz")


def file_lines(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``path, file, block, row_no, line``: the order within a file is that of (block, row_no)."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return lines.withColumn("row_no", F.monotonically_increasing_id())


def named(lines: DataFrame, starts: str = "", contains: str = "", without: str | None = None) -> DataFrame:
    """Files by name; of those of one name in several folders the last path counts."""
    picked = lines.filter(F.col("file").startswith(starts) & F.col("file").contains(contains))
    if without is not None:
        picked = picked.filter(~F.col("file").contains(without))
    chosen = picked.groupBy("file").agg(F.max("path").alias("path"))
    return picked.join(chosen, ["file", "path"], "left_semi")


def _without_header(lines: DataFrame, rows: int) -> DataFrame:
    if not rows:
        return lines
    heads = lines.filter("block = 0").groupBy("path").agg(F.min("row_no").alias("head"))
    return lines.join(heads, "path").filter(F.col("row_no") != F.col("head")).drop("head")


def clock_series(lines: DataFrame, columns: tuple[str, ...], *, separator: str = r"\s+", header: int = 0, date: Column | None = None, back_s: float = 0.0, midnight: bool = False) -> DataFrame:
    """Rows of time of day and numbers as a dated series: ``source, row_no, ts`` and the numbers.

    Malformed times and numbers drop their row.  The date comes from the file's name; a file whose name
    holds none stops the job with that name.
    """
    body = _without_header(lines, header)
    cut = F.split(F.trim("line"), separator)
    fields = [F.get(cut, F.lit(k)).alias(c) for k, c in enumerate(columns)]
    rows = body.select("file", "path", "block", "row_no", *fields)
    numbers = [c for c in columns if c != "timestamp"]
    if date is None:
        undated = F.raise_error(F.concat(F.lit("no date in the file name "), F.col("file"))).cast("date")
        date = F.coalesce(name_date(F.col("file")), undated)
    typed = rows.select("file", "path", "block", "row_no", clock_micros(F.col("timestamp")).alias("clock"), date.alias("date"), *(F.col(c).try_cast("double").alias(c) for c in numbers))
    rolled = rollover_days(typed.na.drop("any", subset=["clock", "date", *numbers]), key="path", clock_us="clock", tie=["block", "row_no"], back_s=back_s, midnight=midnight, chunk=F.col("block"))
    dated = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date")).cast("long") + F.col("days")
    return rolled.select(name_stem(F.col("file")).alias("source"), "row_no", from_micros(dated * 86_400_000_000 + F.col("clock")).alias("ts"), *numbers)


def read_angles(spark: SparkSession, path: str) -> DataFrame:
    return clock_series(named(file_lines(spark, path), starts="Angle"), ANGLE, back_s=12 * 3600, midnight=True)


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    return clock_series(named(file_lines(spark, path), contains="IMU"), IMU, separator=",", header=1, back_s=2 * 3600, midnight=True)


def read_ecg(spark: SparkSession, path: str) -> DataFrame:
    """``source, row_no, ts, adc, data`` of both raw layouts, a name that fits both being of the second; files of neither are refused by not being read.

    ``data`` is the reading in percent of full scale.
    """
    lines = file_lines(spark, path)
    raw = clock_series(named(lines, starts="Raw", without="BMD"), ("timestamp", "adc"))
    bmd = clock_series(named(lines, contains="BMD"), ("timestamp", "adc"), separator=",", header=1)
    return raw.unionByName(bmd).withColumn("data", scaled_adc(F.col("adc")))


def read_labels(spark: SparkSession, path: str, zone: str | None = None) -> DataFrame:
    """``source, ts, label`` of beats: 1 in files with a header, 2 in files without; times may be written as b'...', those with an offset become wall times of ``zone``."""
    lines = named(file_lines(spark, path, recursive=False)).filter(F.lower("file").endswith(".csv") & F.col("file").rlike("Raw|BMD"))
    headed = lines.groupBy("path").agg(F.bool_or(F.col("line").contains("timestamp") & F.col("line").contains("label")).alias("headed"))
    cut = F.split("line", ",")
    time = F.regexp_replace(F.trim(F.get(cut, F.lit(0))), r"^b'(.*)'$", "$1")
    rows = lines.join(headed, "path").select(name_stem(F.col("file")).alias("source"), wall_time(time, zone).alias("ts"), F.get(cut, F.lit(1)).try_cast("int").alias("label"), "headed")
    return rows.filter(F.col("ts").isNotNull() & (F.col("label") == F.when(F.col("headed"), 1).otherwise(2))).select("source", "ts", "label")


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """``folder, file_name, path`` of every file below ``path``, without reading any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "path")


def listed(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """``file_listing`` and what is wrong with the root: ``missing``, ``not_a_folder``, ``empty`` (no folder in it) or nothing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    none = spark.createDataFrame([], "folder string, file_name string, path string")
    if not fs.exists(hadoop):
        return none, "missing"
    if not fs.getFileStatus(hadoop).isDirectory():
        return none, "not_a_folder"
    if not any(s.isDirectory() for s in fs.listStatus(hadoop)):
        return none, "empty"
    return file_listing(spark, path), ""


#: Names under which a cached signal is looked for before its second column is taken.
SIGNAL_NAMES = ("data", "ADC")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """``source, ts, data`` of cached signals (``...cache.csv``), whatever their headers, in one scan.

    Each file's header says where ``timestamp`` stands and where the signal does: under ``data``, else ``ADC``, else
    in the second column.  A file without a ``timestamp`` column stops the job with its name; times or values
    that cannot be read are null.
    """
    lines = file_lines(spark, path).filter(F.col("file").endswith("cache.csv"))
    heads = lines.filter("block = 0").groupBy("path").agg(F.min("row_no").alias("head"), F.min_by("line", "row_no").alias("names"))  # a row per file
    names = F.transform(F.split(F.regexp_replace("names", "^\ufeff", ""), ","), lambda x: F.trim(x))
    place = lambda n: F.nullif(F.array_position(names, n), F.lit(0)) - 1
    heads = heads.select("path", "head", place("timestamp").alias("_t"), F.coalesce(*map(place, SIGNAL_NAMES), F.lit(1)).alias("_d"))
    rows = lines.join(heads, "path").filter(F.col("row_no") != F.col("head"))
    untimed = F.raise_error(F.concat(F.lit("no timestamp column in "), F.col("file"))).cast("long")
    cut = F.split("line", ",")
    time = F.get(cut, F.coalesce("_t", untimed).cast("int"))
    return rows.select(F.regexp_replace(name_stem(F.col("file")), "cache$", "").alias("source"), F.try_to_timestamp(F.trim(time)).cast("timestamp_ntz").alias("ts"), F.get(cut, F.col("_d").cast("int")).try_cast("double").alias("data"))


def write_series(df: DataFrame, path: str, *, ts: str = "ts") -> None:
    """Columnar output, partitioned by day."""
    df.withColumn("day", F.to_date(ts)).write.mode("overwrite").partitionBy("day").parquet(path)


def write_labels_csv(df: DataFrame, path: str, *, ts: str = "ts") -> None:
    """Beats alone, times cut to milliseconds."""
    df.filter("label = 1").select(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"), "label").write.mode("overwrite").option("header", "true").csv(path)


