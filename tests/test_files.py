import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, sinks


def test_csv_contract(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("k,v\na,1\nb,x\n")
    assert files.csv(spark, str(tmp_path), "k string, v int", strict=False).collect() == [("a", 1)]
    with pytest.raises(Exception):
        files.csv(spark, str(tmp_path), "k string, v int").collect()
    with pytest.raises(Exception):
        files.csv(spark, str(tmp_path), "k string, w string").collect()


def test_json_lines_keep_what_does_not_parse(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "a", "v": 1}\n\n{"k": "b", \n{"k": "c", "v": 3}\n')
    good, bad = files.json_lines(spark, str(tmp_path), "k string, v int")
    assert sorted(map(tuple, good.collect())) == [("a", 1), ("c", 3)]
    assert [r.line.strip() for r in bad.collect()] == ['{"k": "b",']


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("one.csv", "k,v\na,1\n\"b,c\",2\n")
        z.writestr("two.csv", "d,3\n")
        z.writestr("empty.csv", "")
        z.writestr("note.txt", "no rows")
    got = files.zipped_csv(spark, str(tmp_path), ["k", "v"])
    assert sorted((r.member, r.k, r.v) for r in got.collect()) == [("one.csv", "a", "1"), ("one.csv", "b,c", "2"), ("two.csv", "d", "3")]


def test_aliases_paths_and_bounds(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "Symbol string, v int").write.parquet(str(tmp_path / "day=1"))
    read = files.from_path(spark.read.parquet(str(tmp_path / "day=1")), day="day=([0-9]+)", none="month=([0-9]+)")
    assert [tuple(r) for r in read.collect()] == [("a", 1, "1", None)]
    named = files.aliased(read, {"key": ["coin", "symbol"], "missing": ["q"]}, ["key"])
    assert [tuple(r) for r in named.collect()] == [("a", None)]
    with pytest.raises(ValueError):
        files.aliased(read, {"key": ["coin"]}, ["key"])
    assert tuple(files.time_bounds(read, "v").first()) == (1, 1, 1)


def test_partitions_resume(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    out, manifest = str(tmp_path / "out"), str(tmp_path / "manifest")
    assert sinks.unbuilt(rows, manifest, ["k"]).count() == 3
    sinks.write_partitioned(rows.where("k = 'a'"), out, manifest, ["k"])
    assert [tuple(r) for r in sinks.unbuilt(rows, manifest, ["k"]).collect()] == [("b", 3)]
    sinks.write_partitioned(sinks.unbuilt(rows, manifest, ["k"]), out, manifest, ["k"])
    assert sorted(map(tuple, spark.read.parquet(manifest).select("k", "n_rows").collect())) == [("a", 2), ("b", 1)]
    assert spark.read.parquet(out).count() == 3
    want = {r.k: r.content_hash for r in sinks.digests(rows, ["k"]).collect()}
    assert {r.k: r.content_hash for r in spark.read.parquet(manifest).collect()} == want
    assert sinks.unbuilt(rows.withColumn("w", F.lit(1)), manifest, ["k"]).count() == 3


def test_json_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a", None)], "k string, v int")
    sinks.append_json(rows, str(tmp_path / "o"))
    sinks.append_json(rows, str(tmp_path / "o"))
    lines = [json.loads(x) for p in (tmp_path / "o").glob("part*") for x in p.read_text().splitlines()]
    assert len(lines) == 2 and len({x["hash"] for x in lines}) == 1


def test_csv_keeps_quotes_breaks_and_microseconds(spark, tmp_path):
    rows = spark.sql("""SELECT * FROM VALUES (1, 'a "b", c', TIMESTAMP_NTZ '2024-01-01 00:00:00.123456'), (2, 'two\\nlines', NULL), (3, ' ', TIMESTAMP_NTZ '2024-01-02 00:00:00'), (4, NULL, NULL), (5, '\\\\', NULL) AS t(k, v, at)""")
    schema = "k int, v string, at timestamp_ntz"
    for gz in (False, True):
        path = str(tmp_path / f"o{gz}")
        sinks.append_csv(rows, path, gz)
        assert sorted(map(tuple, files.csv(spark, path, schema, line_breaks=True).collect())) == sorted(map(tuple, rows.collect()))
    sinks.append_csv(spark.createDataFrame([(6, "", None)], rows.schema), str(tmp_path / "empty"))
    assert files.csv(spark, str(tmp_path / "empty"), schema).first().v is None  # no value and an empty one are the same in CSV
    few, n = files.sampled_csv(spark, str(tmp_path / "oFalse"), 1)
    assert few.columns == ["k", "v", "at"] and few.count() == 1


def test_csv_of_other_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"a ""b"", c"\n2,"""x"""\n')
    assert [tuple(r) for r in files.csv(spark, str(tmp_path), "k int, v string").collect()] == [(1, 'a "b", c'), (2, '"x"')]


def test_hashes_tell_microseconds_apart(spark, tmp_path):
    rows = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ '2024-01-01 00:00:00.123456' AS at UNION ALL SELECT 1, TIMESTAMP_NTZ '2024-01-01 00:00:00.123457'")
    assert rows.select(sinks.row_hash(rows)).distinct().count() == 2
    sinks.append_json(rows, str(tmp_path / "o"))
    good, bad = files.json_lines(spark, str(tmp_path / "o"), "k int, at timestamp_ntz, hash string")
    assert sorted(r["at"].microsecond for r in good.collect()) == [123456, 123457] and bad.isEmpty()


def test_tables_fall_back_to_csv(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.write_table(spark.sql("SELECT 1 AS k, make_interval(0, 1) AS w"), path) == "csv"
    assert [tuple(r) for r in files.stored(spark, path, "k int, w string").collect()] == [(1, "1 months")]
    assert sinks.write_table(spark.sql("SELECT 2 AS k, 'x' AS w"), path) == "parquet"
    assert [tuple(r) for r in files.stored(spark, path, "k int, w string").collect()] == [(2, "x")]
    with pytest.raises(Exception):
        sinks.write_table(spark.sql("SELECT nothing"), path)


def test_archives_without_content_or_of_another_width(spark):
    import io

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.csv", "k,v\n1\n")
    rows = spark.createDataFrame([("a.zip", None), ("b.zip", b"")], "path string, content binary")
    assert files.unzipped(rows, ["k", "v"]).isEmpty()
    with pytest.raises(Exception):
        files.unzipped(spark.createDataFrame([("c.zip", held.getvalue())], rows.schema), ["k", "v"]).collect()
