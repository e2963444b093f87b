"""Scans, versioned tables, cascades, audit rows and archive plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend.functions.distributed import latest_by
from gridmend.sources.versioned import VersionedTable


def scan_table(spark: SparkSession, path: str, status: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan with equality filter and column list; both reach the file reader."""
    df = spark.read.parquet(path)
    if status is not None:
        df = df.filter(F.col("status") == status)
    return df.select(*columns) if columns else df


def scan_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int,
              **options: str) -> DataFrame:
    """Partitioned database scan; filters and projections are pushed to the database."""
    return (spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(lower),
                                              upperBound=str(upper), numPartitions=str(partitions), **options).load())


def merge_latest(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-replace: the newest row per key, updates winning ties. Re-applying the same updates changes nothing."""
    both = target.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest_by(both, keys, [*order, "__new"]).drop("__new")


def versioned_upsert(spark: SparkSession, root: str, updates: DataFrame, keys: list[str], order: list[str]) -> int:
    """Commit the updates as the next version of the table at ``root``; its number. Of two writers that meet, one retries."""
    return VersionedTable(spark, root, keys, order).upsert(updates)


def current_version(spark: SparkSession, root: str) -> int | None:
    return VersionedTable(spark, root, [], []).version()


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return VersionedTable.opened(spark, root).read()


def cascade_delete(deleted: DataFrame, key: str, dependents: dict[str, tuple[DataFrame, str]],
                   nullified: dict[str, tuple[DataFrame, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """New versions of the child tables after deleting parents, and the number of rows touched per table.

    ``dependents`` lose their rows; ``nullified`` keep the row and lose the reference.
    """
    ids = deleted.select(F.col(key).alias("__id")).distinct()
    out, counts = {}, None
    for name, (df, ref) in dependents.items():
        out[name] = df.join(ids, df[ref] == F.col("__id"), "left_anti")
        n = df.join(ids, df[ref] == F.col("__id"), "left_semi").agg(F.lit(name).alias("table"), F.lit("deleted").alias("effect"), F.count("*").alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    for name, (df, ref) in nullified.items():
        j = df.join(ids, df[ref] == F.col("__id"), "left")
        out[name] = j.withColumn(ref, F.when(F.col("__id").isNull(), F.col(ref))).drop("__id")
        n = df.join(ids, df[ref] == F.col("__id"), "left_semi").agg(F.lit(name).alias("table"), F.lit("nulled").alias("effect"), F.count("*").alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    return out, counts


def audit_rows(changes: DataFrame, actor: Column, action: Column, target_type: str, target_id: Column, details: Column) -> DataFrame:
    """Audit log rows: who did what to which row, details as JSON."""
    return changes.select(actor.alias("actor_id"), action.alias("action"), F.lit(target_type).alias("target_type"),
                          target_id.alias("target_id"), F.to_json(details).alias("details"))


def archive_manifest(training: DataFrame) -> DataFrame:
    """Distinct image paths, crop and context alike."""
    paths = training.select(F.explode(F.array("crop_path", "context_path")).alias("path"))
    return paths.filter("path is not null and path <> ''").distinct()


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path and size of every stored file; only metadata is read because the content column is never selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length")


def verify_archive(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    j = manifest.join(listing, "path", "left")
    return j.agg(F.count("*").alias("images_expected"), F.count_if(F.col("length") > 0).alias("present"),
                 F.count_if(F.col("length").isNull()).alias("missing"), F.count_if(F.col("length") == 0).alias("empty"),
                 F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1048576, 1).alias("megabytes"),
                 (F.count_if(F.coalesce("length", F.lit(0)) == 0) == 0).alias("safe_to_purge"))


def purge_plan(training: DataFrame) -> DataFrame:
    """What a purge would remove: every context image, and the crops of approved rows. Nothing is deleted here."""
    context = training.filter("context_path is not null").select(F.col("context_path").alias("path"), F.lit("context").alias("reason"))
    crops = training.filter("crop_path is not null and status = 'approved'").select(F.col("crop_path").alias("path"), F.lit("approved crop").alias("reason"))
    return context.unionByName(crops).groupBy("path").agg(F.min("reason").alias("reason"))


def field_slug(field: Column) -> Column:
    """Storage-safe name: ASCII part of the header cut at 32, plus eight hex digits of its hash."""
    ascii_ = F.regexp_replace(F.regexp_replace(field, "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", "")
    base = F.substring(F.coalesce(F.nullif(ascii_, F.lit("")), F.lit("field")), 1, 32)
    return F.concat_ws("_", base, F.substring(F.md5(field), 1, 8))


def crop_manifest(cells: DataFrame, name_cols: DataFrame, existing: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, existing rows that stay). ``force`` drops the pending rows of the jobs first; verified and
    approved rows are never touched."""
    kept = existing
    if force:
        jobs = cells.select("job_id").distinct()
        stale = existing.filter("status = 'pending'").join(jobs, "job_id", "left_semi").select("job_id", "row_idx", "field")
        kept = existing.join(stale, ["job_id", "row_idx", "field"], "left_anti")
    from gridmend.operators.standardize import looks_like_name_text
    wanted = (cells.join(name_cols.select("job_id", "field"), ["job_id", "field"], "left_semi")
              .filter((F.size("polygon") >= 8) & looks_like_name_text(F.col("value")))
              .join(kept.select("job_id", "row_idx", "field"), ["job_id", "row_idx", "field"], "left_anti"))
    stem = F.concat(F.col("job_id"), F.lit("/"), F.col("row_idx").cast("string"), F.lit("_"), field_slug(F.col("field")))
    label = F.trim("value")
    rows = wanted.select("job_id", "row_idx", "field", F.concat(stem, F.lit(".png")).alias("crop_path"),
                         F.concat(stem, F.lit("_ctx.png")).alias("context_path"), label.alias("ocr_output"), label.alias("label"),
                         F.lit("pending").alias("status"))
    return rows, kept
