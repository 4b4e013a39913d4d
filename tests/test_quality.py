import pytest

from cartwright.operators import quality, sampling
from cartwright.sources import files

ROWS = [("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5), ("c", 5)]


@pytest.fixture(scope="module")
def model(spark):
    return spark.createDataFrame(ROWS, "k string, n bigint")


def test_unique_ignores_null(model):
    assert quality.unique_violations(model, "k").collect() == [("a", 2)]
    assert quality.unique_violations(model, "n").collect() == [("5", 2)]


def test_not_null(model):
    assert sorted(r["n"] for r in quality.not_null_violations(model, "k").collect()) == [3, 4]


def test_accepted_values_let_null_pass(model):
    assert quality.accepted_values_violations(model, "k", ["a", "b"]).collect() == [("c", 1)]


def test_report_counts_each_rule_in_one_pass(model, plan_of):
    rules = [
        quality.unique("m", "k"), quality.not_null("m", "k"), quality.accepted_values("m", "k", ["a", "b"]),
        quality.unique("m", "n"), quality.not_null("m", "n"),
    ]
    result = quality.report({"m": model}, rules)
    assert [(r["column_name"], r["rule"], r["failures"], r["passed"]) for r in result.collect()] == [
        ("k", "unique", 1, False), ("k", "not_null", 2, False), ("k", "accepted_values", 1, False),
        ("n", "unique", 1, False), ("n", "not_null", 0, True)]
    assert plan_of(result).count("Scan ExistingRDD [") <= 1


def test_report_of_an_empty_model_passes(spark, model):
    result = quality.report({"m": model.limit(0)}, [quality.unique("m", "k"), quality.not_null("m", "k")])
    assert [r["passed"] for r in result.collect()] == [True, True]


def test_unknown_rule_kind(model):
    with pytest.raises(ValueError, match="unknown rule"):
        quality.report({"m": model}, [quality.Rule("m", "k", "odd")])
    with pytest.raises(ValueError, match="unknown rule"):
        quality.Rule("m", "k", "odd").violations(model)


def test_agreement(spark):
    def one(v):
        return spark.createDataFrame([(v,)], "x double")

    assert quality.agreement(one(1.0), one(1.005), "x").first()["agrees"]
    assert not quality.agreement(one(1.0), one(1.02), "x").first()["agrees"]


def test_surplus_rows_is_the_multiset_difference(spark):
    newer = spark.createDataFrame([("a", 1)] * 3 + [("b", None)] * 2 + [("c", 1)], "k string, n int")
    older = spark.createDataFrame([("a", 1), ("b", None), ("c", 1), ("d", 9)], "k string, n int")
    assert sorted(quality.surplus_rows(newer, older).collect()) == [("a", 1, 2), ("b", None, 1)]


def test_duplicated_rows_compare_nulls_as_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", 1)], "k string, n int")
    assert quality.duplicated_rows(df).collect() == [("a", None, 2)]


def test_expected_groups(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "k string, c string")
    assert quality.expected_groups(df, ["k", "c"], 4).first() == (3, 4, False)
    assert quality.expected_groups(df.where("k = 'a'"), ["k", "c"], 2).first() == (2, 2, True)


def test_sample_is_repeatable(spark, model):
    shuffled = model.repartition(5, "n")
    assert sampling.sample_batch(model, 3).collect() == sampling.sample_batch(shuffled, 3).collect()


def test_input_readiness_reports_missing_tables(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "transactions.parquet"))
    report = files.input_readiness(spark, str(tmp_path), ["transactions", "products"])
    by_name = {r["table_name"]: r for r in report.collect()}
    assert by_name["transactions"]["status"] == "OK" and by_name["transactions"]["files"] > 0
    assert tuple(by_name["products"]) == ("products", "MISSING", 0, 0.0)
