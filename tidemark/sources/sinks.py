"""Writers: partitioned Parquet with a manifest, resumable builds, line-wise JSON with hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quantiles import beside
from tidemark.operators.sections import merged, partials
from tidemark.sources.files import CSV_FORM

#: instants in JSON keep their microseconds
JSON_FORM = {k: CSV_FORM[k] for k in ("timestampFormat", "timestampNTZFormat")}


def row_hash(rows: DataFrame) -> Column:
    """A row's sha256 over its columns by name, as JSON with nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false", **JSON_FORM}), 256)


def digests(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """n_rows, schema_hash and an order-free content hash of each partition: mergeable, so hot partitions combine before the shuffle."""
    piece = F.conv(F.substring(row_hash(rows), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(piece).cast("string").alias("content_hash")).withColumn("schema_hash", F.sha2(F.lit(rows.drop(*by).schema.simpleString()), 256))


def write_partitioned(rows: DataFrame, path: str, manifest: str, by: Sequence[str], category: str | None = None) -> None:
    """Overwrites the partitions that rows hold, and appends their digests, taken from what was written, to the manifest; with the counts of a category, where one is named.

    A build that breaks off between the two leaves partitions without a manifest row: they are built again.
    """
    spark = rows.sparkSession
    if category is not None and category not in rows.columns:
        raise ValueError(f"no column {category}")
    rows.write.partitionBy(*by).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    kinds = {f.name: f.dataType for f in rows.schema}
    written = spark.read.parquet(path).select(*[F.col(c).cast(kinds[c]).alias(c) for c in rows.columns])
    mine = written.join(rows.select(*by).distinct(), list(by), "left_semi")
    mine = mine.select(*rows.columns)
    told = digests(mine, by)
    if category is not None:
        told = beside(told, category_counts(mine, by, category).withColumnRenamed("counts", "category_counts"), by)
    told.withColumn("at", F.current_timestamp()).write.mode("append").parquet(manifest)


def unbuilt(rows: DataFrame, manifest: str, by: Sequence[str], schema: str | None = None) -> DataFrame:
    """The rows of partitions that the manifest doesn't hold under the present schema (of the rows without `by`, or the one given); all rows where there is no manifest yet."""
    spark: SparkSession = rows.sparkSession
    try:
        known = spark.read.parquet(manifest)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows
    now = schema or rows.drop(*by).schema.simpleString()
    return rows.join(known.where(F.col("schema_hash") == F.sha2(F.lit(now), 256)).select(*by).distinct(), list(by), "left_anti")


def append_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines with their hash."""
    rows.withColumn("hash", row_hash(rows)).write.mode("append").options(**JSON_FORM).json(path)


def size_estimate(sampled: DataFrame, units_total: int, unit: Sequence[str], bytes_per_row: float) -> DataFrame:
    """Rows and GB of a whole build, from the mean rows of the sampled units; one row."""
    per = sampled.groupBy(*unit).agg(F.count(F.lit(1)).alias("n"))
    return per.agg((F.avg("n") * units_total).alias("rows")).withColumn("gb", F.col("rows") * bytes_per_row / 1e9)


def append_csv(rows: DataFrame, path: str, gzip: bool = False) -> None:
    """Rows as CSV files with a header, added to what is there."""
    rows.write.mode("append").options(**CSV_FORM).option("compression", "gzip" if gzip else "none").csv(path)


def write_table(rows: DataFrame, path: str) -> str:
    """Overwrites a path with Parquet, or, where a column's type has no form there (a calendar interval), with CSV of the columns as text; tells which. files.stored() reads either."""
    try:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return "parquet"
    except AnalysisException as e:
        if e.getCondition() != "UNSUPPORTED_DATA_TYPE_FOR_DATASOURCE":
            raise
    odd = [f.name for f in rows.schema if f.dataType.simpleString() == "interval"]
    rows.withColumns({c: F.col(c).cast("string") for c in odd}).write.mode("overwrite").options(**CSV_FORM).option("compression", "gzip").csv(path)
    return "csv"


def write_panel(rows: DataFrame, path: str, index: str, key: str, ts: str) -> None:
    """A gzipped CSV panel, a folder a key, and an index of rows, first and last instant by key, taken from what was written."""
    rows.repartition(key).sortWithinPartitions(key, ts).write.partitionBy(key).mode("overwrite").options(**CSV_FORM).option("compression", "gzip").csv(path)
    written = rows.sparkSession.read.option("header", True).option("escape", '"').schema(rows.schema).csv(path)
    written.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first"), F.max(ts).alias("last")).write.mode("overwrite").parquet(index)


def category_counts(rows: DataFrame, by: Sequence[str], category: str) -> DataFrame:
    """A map of category to rows, by partition: for a manifest beside the digests."""
    each = rows.groupBy(*by, F.coalesce(F.col(category).cast("string"), F.lit("")).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_c", "_n")))).alias("counts"))


def scan_partials(rows: DataFrame, path: str, manifest: str, unit: Sequence[str], by: Sequence[str], value: str, direction: str) -> None:
    """Partial sums of the rows by `by`, kept for each unit (a day, a file): only of units that the manifest doesn't hold yet.

    A scan that breaks off is run again and goes on where it stopped; units that came since are added. A unit that was written but isn't in the manifest is done anew.
    """
    of = lambda x: partials(x, [*unit, *by], value, direction)
    kinds = of(rows).drop(*unit).schema.simpleString()
    write_partitioned(of(unbuilt(rows, manifest, unit, kinds)), path, manifest, unit)


def stored_partials(spark: SparkSession, path: str, manifest: str, unit: Sequence[str], by: Sequence[str]) -> DataFrame:
    """n, mean, std and match_rate by `by` from the stored sums of all units of the manifest: no row of the history is read again."""
    known = spark.read.parquet(manifest).select(*unit).distinct()
    return merged(spark.read.parquet(path).join(known, list(unit), "left_semi"), by)
