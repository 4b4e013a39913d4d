"""The transactions table by batch and month: loads, repeated loads, a new column, fallbacks."""

from datetime import datetime
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from cartwright.operators import sampling
from cartwright.plans import history

SCHEMA = (
    "transaction_id string, customer_id long, product_id long, category string, amount double,"
    " currency string, country_code string, status string, txn_timestamp timestamp_ntz"
)


def rows(spark, *months, n=3):
    made = [
        (f"t{m}-{i}", i, i, "Books", 1.5 * i, "USD", "US", "completed", m and datetime(2024, m, 1 + i))
        for m in months for i in range(n)
    ]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture
def new_table(spark, tmp_path):
    name = f"history_{uuid4().hex}"
    yield history.create_table(spark, name, str(tmp_path / name))
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def counts(spark, name):
    return {r.batch_id: r["count"] for r in spark.table(name).groupBy("batch_id").count().collect()}


def test_loading_a_batch_again_replaces_that_batch_alone(spark, new_table):
    for number, months in ((1, (1, 2)), (2, (2, 3)), (2, (3, 4, 5)), (1, (1, 2))):
        history.load_batch(spark, new_table, rows(spark, *months), number)
    assert counts(spark, new_table) == {1: 6, 2: 9}
    history.load_batch(spark, new_table, rows(spark, 7), 2)
    assert counts(spark, new_table) == {1: 6, 2: 3}
    assert {r.m for r in spark.table(new_table).where("batch_id = 2").select(F.month("txn_month").alias("m")).collect()} == {7}


def test_appending_keeps_what_is_there(spark, new_table):
    history.append_rows(spark, new_table, rows(spark, 1), 1)
    history.append_rows(spark, new_table, rows(spark, 1), 1)
    assert counts(spark, new_table) == {1: 6}


def test_creating_it_again_changes_nothing(spark, new_table, tmp_path):
    history.append_rows(spark, new_table, rows(spark, 1), 1)
    history.create_table(spark, new_table, str(tmp_path / "other"))
    assert counts(spark, new_table) == {1: 3}


def test_rows_without_a_time_loaded_twice_are_found(spark, new_table):
    for number in (1, 2):
        history.append_rows(spark, new_table, rows(spark, None, 1, n=2), number)
    found = history.repeated_rows(spark.table(new_table), after=1).collect()
    assert len(found) == 4 and {(r.held_copies, r.added_copies) for r in found} == {(1, 1)}
    assert sum(r.txn_timestamp is None for r in found) == 2


def test_old_rows_read_null_in_a_new_column(spark, new_table):
    history.append_rows(spark, new_table, rows(spark, 1), 1)
    history.add_discount(spark, new_table)
    history.add_discount(spark, new_table)
    later = rows(spark, 2).withColumn(history.DISCOUNT, F.lit(7.5))
    history.load_batch(spark, new_table, later, 2)
    found = {r.batch_id: r.discount_pct for r in spark.table(new_table).collect()}
    assert found == {1: None, 2: 7.5}


def test_too_large_an_id_is_an_error(spark, new_table):
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        history.append_rows(spark, new_table, rows(spark, 1).withColumn("customer_id", F.lit(2**40)), 1)


def test_states_and_ranges_read_their_partitions(spark, new_table, plan_of):
    for number in (1, 2, 3):
        history.append_rows(spark, new_table, rows(spark, number), number)
    table = spark.table(new_table)
    assert history.as_of(table, 2).count() == 6 and history.in_batch(table, 3).count() == 3
    assert "batch_id" in plan_of(history.as_of(table, 2)).split("PartitionFilters:")[1].split("\n")[0]
    found = history.between(table, "2024-01-02", "2024-02-02")
    assert sorted(r.transaction_id for r in found.collect()) == ["t1-1", "t1-2", "t2-0"]
    assert "txn_month" in plan_of(found).split("PartitionFilters:")[1].split("\n")[0]


def loaded(spark, tmp_path, source, promotion_rows=None):
    path = str(tmp_path / uuid4().hex)
    source.write.parquet(f"{path}-source")
    name = f"history_{uuid4().hex}"
    history.load_history(spark, spark.read.parquet(f"{path}-source"), name, path, promotion_rows)
    found = counts(spark, name)
    spark.sql(f"DROP TABLE {name}")
    return found


def test_without_april_a_sample_comes_from_the_whole_input(spark, tmp_path):
    assert loaded(spark, tmp_path, rows(spark, 5, n=9), promotion_rows=4) == {4: 4}
    assert loaded(spark, tmp_path, rows(spark, 1, 2, 4, n=9), promotion_rows=4) == {1: 9, 2: 9, 4: 4}


def test_without_april_or_a_bound_nothing_is_loaded_twice(spark, tmp_path):
    assert loaded(spark, tmp_path, rows(spark, 1, 2, 3)) == {1: 3, 2: 3, 3: 3}
    assert loaded(spark, tmp_path, rows(spark, 1, 4)) == {1: 3, 4: 3}


def test_batch_or_fallback(spark, tmp_path):
    rows(spark, 1, 2).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    month = F.month("txn_timestamp")
    assert sampling.batch_or_fallback(stored, month == 2).count() == 3
    assert sampling.batch_or_fallback(stored, month == 9).count() == 6
    assert sampling.batch_or_fallback(stored.limit(0), month == 9).count() == 0


def log(spark, name):
    return {r.snapshot_id: (r.operation, r.total_records, r.summary) for r in history.snapshots(spark, name).collect()}


def test_the_log_tells_what_was_loaded_and_when(spark, new_table):
    days = {n: datetime(2024, n, 28) for n in range(1, 8)}
    history.load_batch(spark, new_table, rows(spark, 1), 1, days[1])
    history.append_rows(spark, new_table, rows(spark, 2, n=2), 2, days[2])
    history.append_rows(spark, new_table, rows(spark, 2, n=1), 2, days[3])
    history.add_discount(spark, new_table)
    history.load_batch(spark, new_table, rows(spark, 4).withColumn(history.DISCOUNT, F.lit(7.5)), 3, days[4])
    count = lambda n, d=0: {"added-records": str(n), "discounts": str(d)}
    assert log(spark, new_table) == {1: ("append", 3, count(3)), 2: ("append", 6, count(3)), 3: ("append", 9, count(3, 3))}
    at = lambda *moment: sorted(r.transaction_id for r in history.as_of_time(spark, new_table, datetime(*moment)).collect())
    assert at(2023, 1, 1) == [] and at(2024, 1, 28) == ["t1-0", "t1-1", "t1-2"] and len(at(2024, 5, 1)) == 9
    with pytest.raises(ValueError, match=r"\[2\].*loaded again"):
        at(2024, 3, 1)
    history.load_batch(spark, new_table, rows(spark, 2, n=5), 2, days[5])
    assert log(spark, new_table)[2] == ("overwrite", 8, count(5)) and len(at(2024, 5, 28)) == 11
    with pytest.raises(ValueError, match="loaded again"):
        at(2024, 4, 28)
    history.load_batch(spark, new_table, rows(spark), 1, days[6])
    assert log(spark, new_table)[1] == ("overwrite", 0, count(0))


def test_the_snapshot_list_reads_the_log_alone(spark, new_table, tmp_path):
    history.load_batch(spark, new_table, rows(spark, 1), 1)
    for file in (tmp_path / new_table).rglob("part-*"):
        file.unlink()
    assert log(spark, new_table) == {1: ("append", 3, {"added-records": "3", "discounts": "0"})}


def test_loading_the_history_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / uuid4().hex)
    rows(spark, 1, 2, 3, 4, 5, n=4).write.parquet(f"{path}-source")
    name, source = f"history_{uuid4().hex}", spark.read.parquet(f"{path}-source")
    found = []
    for _ in range(2):
        history.load_history(spark, source, name, path)
        found.append(sorted(map(str, spark.table(name).collect())))
    assert found[0] == found[1] and len(found[0]) == 16
    assert [log(spark, name)[n][:2] for n in (1, 4)] == [("overwrite", 4), ("overwrite", 16)]
    assert history.commits(spark, name).count() == 8
    spark.sql(f"DROP TABLE {name}")


def test_new_batches_are_written_in_one_pass(spark, new_table, tmp_path):
    rows(spark, 1, 2, 3, n=5).write.parquet(str(tmp_path / "source"))
    source = spark.read.parquet(str(tmp_path / "source"))
    stale = tmp_path / new_table / "batch_id=2" / "txn_month=2024-02-01"
    stale.mkdir(parents=True)
    (stale / "part-0.parquet").write_bytes(next((tmp_path / "source").glob("part-*")).read_bytes())
    history.load_batches(spark, new_table, source, F.month("txn_timestamp"), (1, 2))
    assert counts(spark, new_table) == {1: 5, 2: 5}
    history.load_batches(spark, new_table, source.where("customer_id < 2"), F.month("txn_timestamp"), (2, 3))
    assert counts(spark, new_table) == {1: 5, 2: 2, 3: 2}
    assert [log(spark, new_table)[n][0] for n in (1, 2, 3)] == ["append", "overwrite", "append"]
