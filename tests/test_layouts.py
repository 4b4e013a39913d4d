"""Layouts and joins that spare shuffles, tasks or files: buckets, salts, curves, months, indexes."""

from datetime import date
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from cartwright.operators import joins, key_index, layout, sampling, sinks
from cartwright.plans import storage, summaries
from cartwright.queries import QUERIES
from cartwright.sources import readers

SF_DIR = "/root/testdata/sf0.001"


def tree(plan):
    return plan[: plan.index("\n(1) ")]


def scanned_rows(df):
    """Rows that the scans of an executed query gave out, before any filter."""
    df._jdf.queryExecution().executedPlan()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if "Scan" in leaf.nodeName():
            total += leaf.metrics().apply("numOutputRows").value()
    return total


@pytest.mark.parametrize("name", ["join_left_bucketed", "join_bucketed_to_aggregate"])
def test_bucketed_joins_do_not_shuffle(spark, plan_of, name):
    plan = tree(plan_of(QUERIES[name].run(spark, SF_DIR)))
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_each_bucket_is_one_file(spark, tmp_path):
    name = f"bucketed_{uuid4().hex}"
    rows = spark.range(0, 10_000, 1, 8).select((F.col("id") % 100).alias("k"), "id")
    sinks.write_bucketed(rows, name, str(tmp_path / "t"), 5, "k")
    assert len(list((tmp_path / "t").glob("part-*"))) == 5 and spark.table(name).count() == 10_000
    spark.sql(f"DROP TABLE {name}")


def test_salted_join_bounds_the_longest_task(spark, conf, tmp_path):
    """A third of the rows of one key and a sixth of none, with run-time splitting switched off."""
    conf(spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="32", spark__sql__autoBroadcastJoinThreshold="-1")
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 6 == 1, None).otherwise(F.col("id") % 1000)
    spark.range(0, 60_000, 1, 8).select(key.alias("k"), F.col("id").alias("salt")).write.parquet(str(tmp_path / "f"))
    fact = spark.read.parquet(str(tmp_path / "f"))
    dimension = spark.range(900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    joined = joins.left_join_salted(fact, dimension, "k", salts=16)
    assert joined.columns == ["k", "salt", "twice"]
    plain = fact.join(dimension, "k", "left")
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))
    longest = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert longest(plain.hint("merge")) > 20_000 and longest(joined) < 6_000
    assert joins.hot_keys(fact, "k") == [7] and len(joins.hot_keys(fact, "k", share=2000)) < 2000
    assert joins.left_join_salted(fact.where("false"), dimension, "k", 4).count() == 0


def test_duplicate_keys_of_the_dimension_keep_their_rows(spark, tmp_path):
    fact = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    dimension = spark.createDataFrame([(0, "a"), (0, "b"), (5, "c")], "k long, name string")
    joined = joins.left_join_salted(fact, dimension, "k", salts=8, share=4)
    assert sorted(map(str, joined.collect())) == sorted(map(str, fact.join(dimension, "k", "left").collect()))


def test_chosen_days_prune_months_at_run_time(spark, plan_of):
    df = QUERIES["daily_summary_of_chosen_days"].run(spark, SF_DIR)
    assert "dynamicpruning" in plan_of(df).lower()
    assert 0 < df.count() < 366 * 5
    whole = QUERIES["daily_summary_by_month"].run(spark, SF_DIR).count()
    assert scanned_rows(df) < whole


def test_a_month_is_one_file_in_order(spark, tmp_path):
    days = spark.range(200).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (199 - F.col("id")).cast("int")).alias("sale_date"),
        F.lit("x").alias("category"))
    path = summaries.write_daily_summary_by_month(days, str(tmp_path / "m"))
    files = sorted((tmp_path / "m").glob("*/part-*"))
    assert len(files) == 7
    for file in files:
        own = [r.sale_date for r in spark.read.parquet(str(file)).collect()]
        assert own == sorted(own)
    assert spark.read.parquet(path).drop("sale_month").count() == 200


def test_the_curve_spares_rows_of_every_filter(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 4).select(
        "id", F.concat(F.lit("c"), F.hash("id") % 5).alias("category"), F.concat(F.lit("n"), F.hash(F.col("id") + 9) % 25).alias("country"),
        F.when(F.col("id") % 50 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10).alias("amount"),
    )
    plain, curved = str(tmp_path / "plain"), str(tmp_path / "curved")
    rows.repartition(64).write.parquet(plain)
    layout.write_z_ordered(spark.read.parquet(plain), curved, ["category", "country"], ["amount"], files=64)
    filters = ["category = 'c1'", "country = 'n3'", "amount BETWEEN 100 AND 120", "category = 'c1' AND country = 'n3'"]
    for wanted in filters:
        a, b = (spark.read.parquet(p).where(wanted) for p in (plain, curved))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert scanned_rows(b) < 0.7 * scanned_rows(a), wanted
    assert sorted(map(str, spark.read.parquet(curved).collect())) == sorted(map(str, rows.collect()))
    layout.write_z_ordered(spark.read.parquet(plain).where("false"), str(tmp_path / "none"), ["category"], ["amount"])
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_curve_keys_interleave_bits(spark):
    df = spark.range(16).select((F.col("id") % 4).alias("x"), F.floor(F.col("id") / 4).alias("y"))
    found = {(r.x, r.y): r.z for r in df.select("x", "y", layout.z_key([F.col("x"), F.col("y")], 2).alias("z")).collect()}
    bit = lambda v, i: v >> i & 1
    assert found == {(x, y): bit(x, 1) * 8 + bit(y, 1) * 4 + bit(x, 0) * 2 + bit(y, 0) for x, y in found}
    with pytest.raises(ValueError, match="64-bit"):
        layout.z_key([F.col("x")] * 7, 10)
    dated = spark.range(1000).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    ordinals = [r[0] for r in dated.select(layout.ranged_ordinal(dated, "d", 4).alias("o"), "d").orderBy("d").collect()]
    assert ordinals == sorted(ordinals) and set(ordinals) == set(range(16))


def test_samples_have_their_size_under_any_partitioning(spark, plan_of):
    rows = spark.range(0, 9_000, 1, 4).select(
        "id", F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 300 == 2, "rare").when(F.col("id") % 9 == 5, None).otherwise("other").alias("kind"))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1000))
    picked = [
        sorted((str(r.kind), r.id) for r in sampling.sample_per_group(df, "kind", n, drawn).collect())
        for df, n in ((rows, 40), (rows.repartition(7), 40), (rows, 50))
    ]
    assert picked[0] == picked[1] and set(picked[0]) < set(picked[2])
    sizes = {k: sum(a == k for a, _ in picked[0]) for k in ("hot", "rare", "None", "other")}
    assert sizes == {"hot": 40, "rare": 30, "None": 40, "other": 40}
    plan = plan_of(sampling.sample_per_group(rows, "kind", 40, drawn))
    assert tree(plan).count("WindowGroupLimit") == 2


def test_the_key_index_needs_no_earlier_batch(spark, tmp_path, plan_of):
    name = key_index.create_index(spark, f"keys_{uuid4().hex}", str(tmp_path / "i"), "k", "bigint")
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "k long")
    key_index.add_batch(spark, name, ids(1, 2, 2, None, None), 1)
    key_index.add_batch(spark, name, ids(3, 4), 2)
    found = lambda df, n: {(r.value, r.copies, r.earlier_copies) for r in key_index.violations(spark, name, df, n).collect()}
    assert found(ids(2, 3, 5, 5, 6, None), 3) == {(2, 1, 2), (3, 1, 1), (5, 2, 0)}
    assert found(ids(1, 2), 1) == set() and found(ids(), 9) == set()
    key_index.add_batch(spark, name, ids(7), 1)
    key_index.add_batch(spark, name, ids(2, 3), 3)
    assert found(ids(2, 3, 7), 3) == {(3, 1, 1), (7, 1, 1)}
    stored = str(tmp_path / "b")
    ids(1, 7).write.parquet(stored)
    plan = tree(plan_of(key_index.violations(spark, name, spark.read.parquet(stored), 9)))
    assert plan.count("Exchange") == 1  # of the batch; the index is read by bucket
    spark.sql(f"DROP TABLE {name}")


def test_malformed_lines_are_parted_and_counted_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("line_id,part_key,price,ship_date\n1,2,3.5,2024-01-01\nx,y,1,2024-01-01\n,,,\n2,3\n")
    (tmp_path / "b.csv").write_text('line_id,part_key,price,ship_date\n"q,r",2,-1e3,2024-02-30\n3,4,5,2024-02-03,z\n"open,1,2\n')
    schema = readers.StructType.fromDDL("line_id string, part_key bigint, price double, ship_date date")
    found = storage.part_csv(spark, str(tmp_path / "*.csv"), str(tmp_path / "out"), schema)
    assert sorted(map(tuple, found.good.collect()), key=str) == [("1", 2, 3.5, date(2024, 1, 1)), (None, None, None, None)]
    lines = {(r.source_file, r.malformed_line) for r in found.malformed.collect()}
    assert lines == {("a.csv", "x,y,1,2024-01-01"), ("a.csv", "2,3"), ("b.csv", '"q,r",2,-1e3,2024-02-30'), ("b.csv", "3,4,5,2024-02-03,z"), ("b.csv", '"open,1,2')}
    assert (found.good_rows, found.malformed_rows) == (2, 5)
    assert found.good.count() == 2 and found.good.select("part_key").count() == 2


def test_counts_come_with_the_write(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 3).select("id", (F.col("id") % 7).alias("part"))
    path = str(tmp_path / "t")
    assert sinks.write_counted(rows, lambda df: sinks.write_partitioned(df, path, "part")) == (path, 1000)
    assert sinks.write_counted(rows.where("false"), lambda df: sinks.write_parquet(df, path))[1] == 0
    _, seen = watched = sinks.counted(rows, evens=F.count_if(F.col("id") % 2 == 0))
    sinks.write_csv(watched[0], str(tmp_path / "c"))
    assert seen.get == {"rows": 1000, "evens": 500}


def test_files_of_different_schemas(spark, tmp_path):
    spark.sql("SELECT 1 AS a, 1.5F AS b, DATE'2024-01-01' AS d").write.parquet(str(tmp_path / "1"))
    spark.sql("SELECT 5000000000L AS A, 'x' AS c, 2.5D AS b").write.parquet(str(tmp_path / "2"))
    mixed = readers.read_mixed(spark, [str(tmp_path / "1"), str(tmp_path / "2")])
    assert mixed.dtypes == [("a", "bigint"), ("b", "double"), ("d", "date"), ("c", "string")]
    assert sorted(map(tuple, mixed.collect())) == [(1, 1.5, date(2024, 1, 1), None), (5000000000, 2.5, None, "x")]
    with pytest.raises(ValueError, match="column a"):
        readers.merged_schema([spark.sql("SELECT 1 AS a").schema, spark.sql("SELECT 'x' AS a").schema])


def test_file_names_of_parted_lines_cost_no_pattern_per_row(spark, tmp_path, monkeypatch):
    """A search from every place of the path, for every line, took more time than parsing the line."""
    for name in ("a b.csv", "c.csv"):
        (tmp_path / name).write_text("id,day\n1,2024-01-01\nx,2024-01-01\n")
    paths = spark.read.text(str(tmp_path / "*.csv")).select("_metadata.file_path").distinct().collect()

    def refused(*_):
        raise AssertionError("a pattern per row")

    for pattern in ("regexp_extract", "regexp_replace", "regexp_substr", "split"):
        monkeypatch.setattr(F, pattern, refused)
    found = storage.part_csv(spark, str(tmp_path / "*.csv"), str(tmp_path / "out"), readers.StructType.fromDDL("id long, day date"))
    assert {r.source_file for r in found.malformed.collect()} == {r.file_path.split("/")[-1] for r in paths}
