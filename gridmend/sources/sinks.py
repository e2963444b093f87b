"""Sinks: label export and the wide form table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: export columns and the headers pinned to the front, in order ------------------------------
EXPORT_COLUMNS = ["id", "job_id", "participant_index", "field_name", "ocr_output", "label", "status", "crop_url"]
PINNED = ["اسم", "هاتف|تواصل|جوال|موبايل", "تاريخ.*ميلاد|ميلاد|تاريخ.*ولاد|ولادة"]


def csv_field(c: Column) -> Column:
    """Quoted, inner quotes doubled, line breaks to spaces; null is empty and unquoted."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.lit('"'), F.regexp_replace(F.replace(s, F.lit('"'), F.lit('""')), "\r?\n", " "), F.lit('"')), F.lit(""))


def export_lines(training: DataFrame, status: str = "approved", columns: list[str] = EXPORT_COLUMNS) -> DataFrame:
    rows = training if status == "all" else training.filter(F.col("status") == status)
    line = F.concat_ws(",", *[csv_field(F.col(c)) for c in columns])
    return rows.select("created_at", "id", line.alias("line"))


def export_labels_csv(training: DataFrame, path: str, status: str = "approved", columns: list[str] = EXPORT_COLUMNS) -> None:
    """Ordered label file set: a header line, then rows by creation time. The sort is range-partitioned, so part files
    read in name order give the whole order."""
    spark = training.sparkSession
    lines = export_lines(training, status, columns).select(F.lit(1).alias("part"), "created_at", "id", "line")
    head = spark.createDataFrame([(",".join(columns),)], "line string").select(
        F.lit(0).alias("part"), F.lit(None).cast(lines.schema["created_at"].dataType).alias("created_at"), F.lit(None).cast("string").alias("id"), "line")
    lines.unionByName(head).orderBy("part", "created_at", "id").select("line").write.mode("overwrite").text(path)


def column_order(cells: DataFrame) -> DataFrame:
    """Display position of every (job, field): pinned headers first, then sheet order.

    Each pin takes the first matching column not pinned before it. Columns of a job are few and already aggregated; every pin
    is a column of its own, because a nested one would be found again in each place that names it.
    """
    cols = cells.groupBy("job_id", "field").agg(F.min("col_idx").alias("col_idx"))
    fits = [F.col("field").rlike(p).alias(f"fits{i}") for i, p in enumerate(PINNED)]
    out = cols.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "field", *fits))).alias("a"))
    pins: list[Column] = []
    for i in range(len(PINNED)):
        free = F.filter("a", lambda x: reduce(lambda ok, p: ok & ~x["field"].eqNullSafe(p), pins, x[f"fits{i}"]))
        out = out.withColumn(f"pin{i}", F.get(free, F.lit(0))["field"])
        pins.append(F.col(f"pin{i}"))
    out = out.select("job_id", F.transform("a", lambda x: x["field"]).alias("names"), F.array_compact(F.array(*pins)).alias("pinned"))
    return out.select("job_id", F.posexplode(F.concat("pinned", F.array_except("names", "pinned"))).alias("position", "field"))


def export_form_table(cells: DataFrame, fields: list[str]) -> DataFrame:
    """One row per person, one column per field of the form family. The field list is explicit, so no pass over the data
    is spent on finding pivot values."""
    wide = cells.groupBy("job_id", "row_idx").pivot("field", fields).agg(F.max("value"))
    return wide
