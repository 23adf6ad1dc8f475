"""Sampling quality: status of every slot, pivots by day or hour, completeness, worst periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("missing", "too_low", "normal", "too_high")


def rate_status(n: Column, low: int = 5, high: int = 15) -> Column:
    """Class of a slot's count; ``low`` and ``high`` themselves are normal."""
    return F.when(n == 0, "missing").when(n < low, "too_low").when(n > high, "too_high").otherwise("normal")


def status_by(slots: DataFrame, period: Column, name: str) -> DataFrame:
    """Slots of each status per period; a period without a status has 0."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return slots.groupBy(period.alias(name)).agg(*counts)


def worst(pivot: DataFrame, name: str, k: int = 10) -> DataFrame:
    """The ``k`` periods of most slots that are too low or too high, earlier ones first among equals."""
    scored = pivot.withColumn("score", F.col("too_low") + F.col("too_high")).filter("score > 0")
    return scored.orderBy(F.desc("score"), name).limit(k)


def completeness(slots: DataFrame, per_hour: int) -> DataFrame:
    """Per day and hour: the share of slots that the grid spans, and of slots that hold rows."""
    by = [F.to_date("slot").alias("day"), F.hour("slot").alias("hour")]
    share = lambda x: F.round(100.0 * x / F.lit(per_hour), 6)
    return slots.groupBy(*by).agg(share(F.count("*")).alias("span_pct"), share(F.count_if(F.col("n") > 0)).alias("data_pct"))


def abnormal_stretches(slots: DataFrame, per_hour: int) -> DataFrame:
    """Hours all of whose slots are abnormal in one row, single abnormal slots of other hours else."""
    hour = F.date_trunc("hour", "slot").cast("timestamp_ntz")
    bad = slots.filter(F.col("status").isin("too_low", "too_high")).withColumn("hour", hour)
    counted = bad.withColumn("k", F.count("*").over(Window.partitionBy("hour")))
    whole = counted.filter(F.col("k") == per_hour).groupBy("hour").agg(F.count("*").alias("slots")).select(F.col("hour").alias("start"), "slots")
    single = counted.filter(F.col("k") < per_hour).select(F.col("slot").alias("start"), F.lit(1).cast("long").alias("slots"))
    return whole.unionByName(single)


def folder_report(files: DataFrame) -> DataFrame:
    """QA of ``folder, file_name`` rows: per folder its date, number of files, odd dates, ids and verdict."""
    date = F.regexp_extract("folder", r"^(\d{8})", 1)
    own = F.replace(F.regexp_extract("file_name", r"(\d{8}|\d{4}-\d{2}-\d{2})", 1), F.lit("-"), F.lit(""))
    ids = F.expr(r"regexp_extract_all(file_name, '\\b([A-Za-z]{1,3}\\d{1,4})\\b', 1)")
    odd = (date != "") & (own != "") & (own != date)
    rows = files.select("folder", date.alias("date"), odd.cast("long").alias("odd"), ids.alias("ids"))
    found = rows.groupBy("folder", "date").agg(F.count("*").alias("files"), F.sum("odd").alias("odd_dates"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))
    fine = (F.col("date") != "") & (F.col("files") >= 2) & (F.col("odd_dates") == 0) & (F.size("ids") <= 1)
    return found.select("folder", F.col("date"), "files", "odd_dates", F.array_join(F.slice("ids", 1, 8), ",").alias("ids"), fine.alias("ok"))


def folder_messages(files: DataFrame) -> DataFrame:
    """One row for each finding of ``folder_report``: ``folder, finding, file_name, detail``; ``ok`` where a folder has none.

    ``date_mismatch`` is a row for each file, once per name.
    """
    report = folder_report(files)
    per_folder = F.array(
        F.when(F.col("date") == "", F.struct(F.lit("bad_name").alias("finding"), F.lit("").alias("detail"))),
        F.when(F.col("files") < 2, F.struct(F.lit("few_files").alias("finding"), F.col("files").cast("string").alias("detail"))),
        F.when(F.col("ids").contains(","), F.struct(F.lit("several_ids").alias("finding"), F.col("ids").alias("detail"))),
        F.when(F.col("ok"), F.struct(F.lit("ok").alias("finding"), F.col("files").cast("string").alias("detail"))),
    )
    folders = report.select("folder", F.inline(F.filter(per_folder, lambda x: x.isNotNull()))).select("folder", "finding", F.lit("").alias("file_name"), "detail")
    date = F.regexp_extract("folder", r"^(\d{8})", 1)
    own = F.replace(F.regexp_extract("file_name", r"(\d{8}|\d{4}-\d{2}-\d{2})", 1), F.lit("-"), F.lit(""))
    odd = files.filter((date != "") & (own != "") & (own != date)).select("folder", F.lit("date_mismatch").alias("finding"), "file_name", own.alias("detail")).distinct()
    return folders.unionByName(odd)


def rate_histogram(slots: DataFrame, bins: int = 30) -> DataFrame:
    """Slots by their number of rows, ``bin, slots``: empty slots and those over ``bins`` rows are left out, ``bins`` itself is in the last bin."""
    shown = slots.filter((F.col("n") > 0) & (F.col("n") <= bins))
    return shown.groupBy(F.least("n", F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("slots"))
