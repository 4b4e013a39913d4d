from uuid import uuid4

import pytest
from pyspark.errors import IllegalArgumentException
from pyspark.sql import functions as F

from cartwright import jobs
from cartwright.operators import sinks
from cartwright.plans import exploration, storage
from cartwright.sources import files, generators, readers, schemas


@pytest.fixture(scope="module")
def rows(spark):
    return generators.benchmark_transactions(generators.ids(spark, 20_000))


def test_format_report(spark, rows, tmp_path):
    seconds = storage.write_formats(rows, str(tmp_path))
    report = {r["format"]: r for r in storage.storage_format_report(spark, str(tmp_path), seconds).collect()}
    assert set(report) == {"csv", "parquet_zstd", "parquet_snappy"}
    assert report["csv"]["size_reduction_pct"] is None
    zstd, snappy, csv = (report[k]["bytes"] for k in ("parquet_zstd", "parquet_snappy", "csv"))
    assert zstd < snappy < csv
    assert report["parquet_zstd"]["size_reduction_pct"] == round((1 - zstd / csv) * 100, 1)
    assert all(r["write_seconds"] >= 0 for r in report.values())
    on_disk = sum(p.stat().st_size for p in (tmp_path / "csv").glob("part-*"))
    assert csv == on_disk
    counts = storage.format_row_counts(spark, str(tmp_path), schemas.BENCHMARK_TRANSACTIONS).collect()
    assert {r["row_count"] for r in counts} == {20_000}


def test_missing_codec_is_reported_not_raised(spark, rows, tmp_path, monkeypatch):
    def broken(df, path):
        raise IllegalArgumentException("Codec [none] is not available")

    monkeypatch.setitem(storage.FORMATS, "parquet_snappy", broken)
    seconds = storage.write_formats(rows, str(tmp_path))
    assert seconds["parquet_snappy"] is None and seconds["csv"] is not None
    report = {r["format"]: r for r in storage.storage_format_report(spark, str(tmp_path), seconds).collect()}
    assert report["parquet_snappy"]["bytes"] is None and report["parquet_snappy"]["write_seconds"] is None
    monkeypatch.setitem(storage.FORMATS, "csv", broken)
    with pytest.raises(IllegalArgumentException):
        storage.write_formats(rows, str(tmp_path))


def test_csv_keeps_blanks_nulls_and_times(spark, tmp_path):
    df = spark.sql(
        "SELECT ' a ' AS transaction_id, 1L AS customer_id, CAST(NULL AS BIGINT) AS product_id,"
        " 'x,y' AS category, 0.1D AS amount, 'q\"q' AS currency, CAST(NULL AS STRING) AS country_code,"
        " 's' AS status, TIMESTAMP_NTZ'2024-02-29 23:50:00' AS timestamp")
    path = sinks.write_csv(df, str(tmp_path / "csv"))
    assert readers.read_csv(spark, path, schemas.TRANSACTIONS).collect() == df.collect()


def test_malformed_csv_is_an_error(spark, tmp_path):
    (tmp_path / "p.csv").write_text("product_id,product_name,category,brand,unit_price\nx,a,b,c,1.0\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD|malformed"):
        readers.read_csv(spark, str(tmp_path / "p.csv"), schemas.PRODUCTS).collect()


def test_inferred_types(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,price,at,name\n1,2.5,2024-01-01 00:10:00,a\n")
    inferred = readers.read_csv_inferred(spark, str(tmp_path / "p.csv"))
    assert [t for _, t in inferred.dtypes] == ["int", "double", "timestamp", "string"]


def test_listing_skips_markers(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "t"))
    assert files.listing(spark, str(tmp_path)).count() == 2
    names = files.first_files(spark, str(tmp_path), 5)
    assert [n.rsplit("/", 1)[1] for n in names] == sorted(p.name for p in (tmp_path / "t").glob("part-*"))


def test_both_formats_give_the_same_revenue(spark, rows, tmp_path):
    storage.write_formats(rows, str(tmp_path))
    text = readers.read_csv(spark, str(tmp_path / "csv"), schemas.BENCHMARK_TRANSACTIONS)
    columnar = spark.read.parquet(str(tmp_path / "parquet_zstd"))
    revenue = [exploration.filtered_revenue(df, "Electronics", "US").first()[0] for df in (text, columnar)]
    assert revenue[0] == revenue[1] > 0


def test_jobs_from_generation_to_marts(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(generators, "N_CUSTOMERS", 50)
    folder = str(tmp_path / "data")

    def run(name, *more):
        jobs.main([name, "--data", folder, *more])
        return capsys.readouterr().out

    run("generate", "--rows", "3000")
    assert "3000" in run("explore")
    assert "3000" in run("convert")
    assert "MISSING" not in run("check-inputs")
    assert "Electronics" in run("summary")
    assert "BroadcastHashJoin" in run("daily")
    name = f"jobs_{uuid4().hex}"
    assert f"Table {name} at" in run("load-history", "--table", name, "--promotion-rows", "500")
    assert "added-records" in run("show-history", "--table", name, "--snapshot", "1")
    assert "txn_timestamp" in run("load-raw")
    assert "lifetime_value" in run("build-marts")
    out = run("test-models")
    assert "accepted_values" in out and "false" not in out
    run("generate-benchmark", "--rows", "5000")
    assert "parquet_snappy" in run("compare-formats")
    assert set(jobs.JOBS) == {
        "generate", "generate-benchmark", "explore", "convert", "check-inputs", "compare-formats", "summary",
        "daily", "load-history", "show-history", "load-raw", "build-marts", "test-models"}


def test_only_a_missing_codec_is_tolerated(rows, tmp_path, monkeypatch):
    wrong = dict(storage.FORMATS, parquet_snappy=lambda df, path: sinks.write_parquet(df, path, "nonesuch"))
    monkeypatch.setattr(storage, "FORMATS", wrong)
    assert storage.write_formats(rows, str(tmp_path / "a"))["parquet_snappy"] is None

    def full(df, path):
        raise OSError("No space left on device")

    monkeypatch.setattr(storage, "FORMATS", dict(storage.FORMATS, parquet_snappy=full))
    with pytest.raises(OSError):
        storage.write_formats(rows, str(tmp_path / "b"))


@pytest.mark.parametrize("n", [0, 3, 5_000])
def test_csv_in_parts_has_a_header_for_each_at_any_size(spark, tmp_path, n):
    df = spark.range(0, n, 1, 24).select("id", F.lit('a,"b ').alias("text"), F.lit(None).cast("int").alias("gap"))
    path = sinks.write_csv_in_parts(df, str(tmp_path / "csv"), 8)
    counts = exploration.line_count(readers.read_lines(spark, path), "id,text,gap").first()
    assert tuple(counts) == (n + 8, 8, n)
    data = readers.read_lines(spark, path).where("value != 'id,text,gap'").select("value")
    whole = readers.read_lines(spark, sinks.write_csv(df, str(tmp_path / "whole"))).where("value != 'id,text,gap'")
    assert sorted(data.collect()) == sorted(whole.collect())


def test_csv_in_parts_is_written_by_as_many_tasks_as_there_are(spark, tmp_path):
    path = tmp_path / "csv"
    sinks.write_csv_in_parts(spark.range(0, 24_000, 1, 24), str(path), 8)
    assert sorted(p.name for p in path.iterdir() if p.is_dir()) == [f"csv_part={i}" for i in range(8)]
    for part in path.glob("csv_part=*"):
        lines = [p.read_text().split() for p in part.glob("part-*")]
        assert sorted(len(x) for x in lines) == [1, 1000, 1000, 1000] and ["id"] in lines


def test_line_count_shuffles_no_whole_part(spark, monkeypatch, tmp_path):
    """Its rows are not brought together into as many tasks as there are parts."""
    from pyspark.sql import DataFrame

    from cartwright.queries import QUERIES, base

    monkeypatch.setattr(base, "_prepared", {})

    def refused(*_):
        raise AssertionError("rows of all sizes in a fixed number of tasks")

    for kind in {type(spark.range(1)), DataFrame}:
        monkeypatch.setattr(kind, "repartition", refused)
    lines = QUERIES["line_count"].run(spark, "/root/testdata/sf0.001").first()
    assert lines["header_lines"] == 8 and lines["lines"] == lines["data_lines"] + 8
