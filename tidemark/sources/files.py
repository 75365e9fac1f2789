"""Readers: delimited files under a header contract, zipped CSV, line-wise JSON, columns from paths, aliased columns, time bounds."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZIP_ROWS = 50_000
#: quotes within quotes are doubled, spaces at the ends stay, and instants keep their microseconds: what is written is read back unchanged
CSV_FORM = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
            "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def csv(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, line_breaks: bool = False) -> DataFrame:
    """CSV with a header, plain or gzipped. strict: a file whose header differs from the schema, or a row that doesn't parse, fails the read; else such rows go.

    line_breaks: quoted values may hold line breaks; a file is then one task's work. Instants may be written in any ISO form. Quotes within quotes are doubled.
    Empty strings are read as nulls: CSV doesn't tell them apart. Spark parses the columns that a query asks for: a bare count() sees all rows, so count a selection's rows after it.
    """
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", line_breaks)
    return reader.option("enforceSchema", not strict).option("mode", "FAILFAST" if strict else "DROPMALFORMED").csv(path)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What sinks.write_table() left at a path: Parquet, or CSV under the schema where the rows had a type that Parquet has not."""
    parquet = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")  # a listing: no content is read
    return csv(spark, path, schema, line_breaks=True) if parquet.isEmpty() else spark.read.parquet(path)


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the lines that parse, and (file, line) of the others: nothing goes unseen. Empty lines are neither."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    read = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), parsed.alias("row"))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    return read.where(~bad).select("row.*").drop("_corrupt"), read.where(bad).select("file", "line")


def zipped_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """unzipped() of the ZIP archives under a path."""
    return unzipped(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path), columns)


def unzipped(archives: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All rows of the CSV members of ZIP archives (path, content), as strings with their archive and member; a first row that repeats the column names is a header.

    An archive is one task's work (ZIP can't be split) and is held compressed; its rows leave in batches of ZIP_ROWS. Rows of
    another width fail the read. Archives without content have no rows.
    """
    names = list(columns)

    def rows(batches: Iterator) -> Iterator:
        import csv as reader
        import io
        import zipfile

        import pandas as pd

        def frame(archive, member, held):
            out = pd.DataFrame(held, columns=names, dtype=object)
            out.insert(0, "member", member)
            out.insert(0, "archive", archive)
            return out

        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(n for n in z.namelist() if n.lower().endswith(".csv")):
                        held = []
                        for i, row in enumerate(reader.reader(io.TextIOWrapper(z.open(member), "utf-8", newline=""))):
                            if not row or (i == 0 and row == names):
                                continue
                            if len(row) != len(names):
                                raise ValueError(f"{archive}, {member}: row {i} has {len(row)} fields, not {len(names)}")
                            held.append(row)
                            if len(held) == ZIP_ROWS:
                                yield frame(archive, member, held)
                                held = []
                        if held:
                            yield frame(archive, member, held)

    schema = T.StructType([T.StructField(n, T.StringType()) for n in ["archive", "member", *names]])
    return archives.select("path", "content").where(F.length("content") > 0).mapInPandas(rows, schema)


def from_path(rows: DataFrame, **patterns: str) -> DataFrame:
    """Columns cut from each row's file path: the first group of a pattern, null where it doesn't match."""
    path = F.col("_metadata.file_path")
    got = {name: F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for name, p in patterns.items()}
    return rows.select("*", *[c.alias(name) for name, c in got.items()])


def aliased(rows: DataFrame, wanted: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """Columns by the first of their aliases that has a value; required columns without any alias in the table raise ValueError, others are null."""
    there = {c.lower(): c for c in rows.columns}

    def pick(name: str) -> Column:
        found = [F.col(f"`{there[a.lower()]}`") for a in wanted[name] if a.lower() in there]
        if not found and name in required:
            raise ValueError(f"no column for {name}: none of {list(wanted[name])} in {rows.columns}")
        return (F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name)

    return rows.select(*[pick(n) for n in wanted])


def time_bounds(rows: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """First and last instant and the row count; only `ts` and `by` are read."""
    return rows.groupBy(*by).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n_rows"))


def pairs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that both sources hold, once each."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys))


def sample_csv(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The first rows of a CSV as strings under its header: what a look at a file needs, without a pass for types."""
    return spark.read.option("header", True).option("escape", '"').option("inferSchema", False).csv(path).limit(rows)


def sampled_csv(spark: SparkSession, path: str, rows: int) -> tuple[DataFrame, int]:
    """sample_csv() and the number of rows under the headers, counted without reading a column."""
    return sample_csv(spark, path, rows), spark.read.option("header", True).option("inferSchema", False).csv(path).count()


def discovered(spark: SparkSession, folder: str, tokens: Mapping[str, int], pattern: str = "*") -> DataFrame:
    """path, length, modificationTime and score (the sum of the weights of the tokens in the path) of the files under a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    score = F.lit(0)
    for token, weight in tokens.items():
        score = score + F.when(F.contains(F.lower("path"), F.lit(token.lower())), weight).otherwise(0)
    return found.withColumn("score", score)


def latest(found: DataFrame, by: Column) -> DataFrame:
    """The best file of each group: the highest score, then the newest, then the last by path."""
    return found.withColumn("group", by).groupBy("group").agg(F.max_by("path", F.struct("score", "modificationTime", "path")).alias("path"))


def series_faults(rows: DataFrame, symbol: str, expected: Column, ts: str, order: str) -> DataFrame:
    """By file: rows, rows of another symbol than `expected`, and rows whose time is not after that of the row before (in `order`). A sound file has none."""
    from pyspark.sql import Window

    x = rows.withColumn("_file", F.col("_metadata.file_path")) if "_file" not in rows.columns else rows
    before = F.lag(ts).over(Window.partitionBy("_file").orderBy(order))
    x = x.withColumn("_back", F.coalesce(F.col(ts) <= before, F.lit(False))).withColumn("_other", ~F.col(symbol).eqNullSafe(expected))
    return x.groupBy("_file").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("_other"), 1)).alias("other_symbol"), F.count(F.when(F.col("_back"), 1)).alias("not_increasing"))
