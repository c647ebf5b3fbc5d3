"""Statistics, issues and labels on small tables with known answers."""

import random
import statistics

import numpy as np
import pytest

from tabmend import ColumnSpec, TableSpec, find_issues, profile
from tabmend.operators import colstats, issues, quantiles, values
from tabmend.operators.summary import moments, summary


def frame(spark, columns, schema):
    return spark.createDataFrame(list(zip(*columns)), schema)


def types_of(found):
    return [(r["column"], r["type"]) for r in sorted(found.collect(), key=lambda r: r["ord"])]


def test_outliers_without_schema(spark):
    df = frame(
        spark, ([35] * 30 + [-5, 200], [50000] * 31 + [100_000_000]), "age bigint, salary bigint"
    )
    assert types_of(find_issues(df)) == [
        ("age", "STATISTICAL_OUTLIER"),
        ("salary", "STATISTICAL_OUTLIER"),
    ]


def test_percentages_in_labels(spark):
    df = frame(spark, ([10.0] * 99 + [10000.0],), "val double")
    spec = TableSpec({"val": ColumnSpec(bounds=(0.0, 50.0))})
    status = issues.labels_of(profile(df, spec)).first()["status"]
    assert status == "1 Out-of-bounds (1.0%), 1 Outliers (1.0%)"


def test_empty_table_has_no_profile_and_no_issues(spark):
    df = spark.createDataFrame([], "id bigint, score double, target bigint")
    assert profile(df).count() == 0
    assert find_issues(df, TableSpec(target="target")).count() == 0


def test_null_threshold_is_inclusive_and_skips_ids(spark):
    rows = [(None if i < 2 else i, None if i < 2 else i) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, x int")
    spec = TableSpec({"id": ColumnSpec("id")})
    row = issues.null_issues(df, spec).collect()
    assert [(r["column"], r["ratio"]) for r in row] == [("x", 0.2)]
    assert row[0]["message"] == "Column 'x' has a missingness ratio of 20.0% (Threshold: 20%)."


def test_nan_counts_as_missing_and_keeps_the_z_check(spark):
    df = frame(spark, ([1.0] * 30 + [float("nan"), 500.0],), "x double")
    row = profile(df).first()
    assert (row["nulls"], row["outliers"]) == (1, 1)


@pytest.mark.parametrize(
    "cells, binary", [([0, 1], True), ([0.0, 1.0], True), ([1, 2], False), ([1, 1], False)]
)
def test_undeclared_binary_needs_zero_and_one(spark, cells, binary):
    kind = "double" if isinstance(cells[0], float) else "int"
    df = frame(spark, ([cells[0]] * 18 + [cells[1]] * 2,), f"x {kind}")
    assert profile(df).first()["binary"] is binary


def test_declared_binary_of_other_values_is_checked_for_balance(spark):
    df = frame(spark, ([1] * 18 + [2] * 2,), "x int")
    spec = TableSpec({"x": ColumnSpec(semantic_type="binary")})
    found = find_issues(df, spec).collect()
    assert [(r["type"], r["minority_value"], r["ratio"]) for r in found] == [
        ("CLASS_IMBALANCE", "2", 0.1)
    ]


def test_target_of_any_type_is_reported_once(spark):
    df = frame(spark, (["a"] * 18 + ["b"] * 2, [0] * 18 + [1] * 2), "s string, n int")
    assert types_of(find_issues(df, TableSpec(target="s"))) == [
        ("n", "CLASS_IMBALANCE"),
        ("s", "CLASS_IMBALANCE"),
    ]
    assert types_of(find_issues(df, TableSpec(target="n"))) == [("n", "CLASS_IMBALANCE")]


def test_ten_even_classes_of_a_target_are_imbalanced(spark):
    df = frame(spark, ([i % 10 for i in range(100)],), "x int")
    row = find_issues(df, TableSpec(target="x")).where("type = 'CLASS_IMBALANCE'").first()
    assert (row["minority_value"], row["ratio"]) == ("0", 0.1)


def test_issue_order_within_and_across_columns(spark):
    a = [None] * 10 + [5.0] * 39 + [1000.0]
    b = [0] * 48 + [1] * 2
    df = frame(spark, (a, b), "a double, b int")
    spec = TableSpec({"a": ColumnSpec(bounds=(0.0, 100.0))}, target="b")
    assert types_of(find_issues(df, spec)) == [
        ("a", "HIGH_NULL_RATIO"),
        ("a", "INVALID_BOUNDS"),
        ("a", "STATISTICAL_OUTLIER"),
        ("b", "CLASS_IMBALANCE"),
    ]


def test_moments_are_population_moments(spark):
    rng = random.Random(3)
    cells = [rng.gauss(0, 10) for _ in range(200)]
    row = moments(frame(spark, (cells,), "x double")).first()
    assert row["std"] == pytest.approx(statistics.pstdev(cells))
    assert row["median"] == pytest.approx(statistics.median(cells))
    assert (row["min"], row["max"]) == (min(cells), max(cells))


def test_value_counts_and_ties(spark):
    df = frame(spark, ([10, 9, 9, 10, 7], ["b", "a", "a", "b", None]), "n int, s string")
    counts = {(r["column"], r["value"]): r["n"] for r in values.value_counts(df).collect()}
    assert counts == {("n", "10"): 2, ("n", "9"): 2, ("n", "7"): 1, ("s", "a"): 2, ("s", "b"): 2}
    ends = {r["column"]: r for r in values.extremes(df).collect()}
    # equal counts go to the smaller number, not the smaller text
    assert (ends["n"]["minority_value"], ends["n"]["mode_value"]) == ("7", "9")
    assert (ends["s"]["minority_value"], ends["s"]["mode_value"]) == ("a", "a")


def test_unique_counts_of_long_texts_and_empty_columns(spark):
    long = ["x" * 5000 + str(i % 7) for i in range(40)]
    df = frame(spark, (long, [None] * 40), "t string, e string")
    got = {r["column"]: (r["n_unique"], r["filled"]) for r in values.unique_counts(df).collect()}
    assert got == {"t": (7, 40), "e": (0, 0)}


@pytest.mark.parametrize("values_, classes", [([2**53, 2**53 + 1], 2), ([2**53, 2**53 + 1, 2**53 + 2], 3)])
def test_integers_that_share_a_double_stay_apart(spark, values_, classes):
    cells = [values_[0]] * 40 + [v for v in values_[1:] for _ in range(3)]
    df = frame(spark, (cells, [0.5] * len(cells)), "code bigint, x double")
    assert values.unique_counts(df).first()["n_unique"] == classes
    row = profile(df, TableSpec({"code": ColumnSpec(semantic_type="binary")})).first()
    assert row["binary"] == (classes == 2)
    if classes == 2:
        assert (row["minority_value"], row["minority_n"], row["classes_n"]) == (str(2**53 + 1), 3, 43)


def test_distinct_counts_by_type(spark):
    rows = "VALUES (1.50, date'2020-01-01', X'00', true, -0.0D), (1.50, date'2020-01-02', X'01', NULL, 0.0D)"
    df = spark.sql(f"SELECT * FROM {rows} AS t(d, day, b, flag, z)")
    assert [r["n_unique"] for r in values.unique_counts(df).orderBy("ord").collect()] == [1, 2, 2, 1, 1]


def test_distinct_counts_share_exchanges(spark):
    """1,000 columns of three types: a scan and an exchange by value for each 64 columns of a type."""
    makes = ["id % {} AS c{}", "CAST(id % {} AS STRING) AS c{}", "CAST(id % {} AS DOUBLE) AS c{}"]
    df = spark.range(50).selectExpr(*[makes[i % 3].format(i % 40 + 1, i) for i in range(1_000)])
    sizes = values.unique_sizes(df, df.columns)
    plan = sizes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 50") == 18  # 334 columns of a type are six groups
    got = {r["ord"]: (r["n_unique"], r["filled"]) for r in sizes.collect()}
    assert got == {i: (min(i % 40 + 1, 50), 50) for i in range(1_000)}


@pytest.mark.parametrize("keep", [1, 50, 10**6])
def test_ranks_by_ranges(spark, monkeypatch, keep):
    """Ranks are found in ranges of any size, hot values and equal neighbours included, also
    where the sketch proposes nothing."""
    rng = np.random.default_rng(keep)
    cells = {"a": rng.integers(0, 900, 3_000) * 1.0, "b": np.where(np.arange(3_000) < 1_000, -0.0, rng.normal(0, 9, 3_000)), "c": np.full(3_000, 4.0)}
    df = spark.createDataFrame(list(zip(*[c.tolist() for c in cells.values()])), "a double, b double, c double").repartition(5)
    monkeypatch.setattr(quantiles, "_tighten", lambda *_: None)
    probs = (0.0, 0.1, 1 / 3, 0.5, 0.9999, 1.0)
    got = quantiles.exact_quantiles(df, {c: c for c in cells}, probs, dict.fromkeys(cells, 3_000), direct_cells=0, range_values=keep)
    for name, column in cells.items():
        for p in probs:
            assert got[name][p] == pytest.approx(float(np.percentile(column, p * 100)), rel=1e-12)


def test_wide_tables_are_scanned_in_groups(spark, monkeypatch):
    monkeypatch.setattr(colstats, "COLUMNS_PER_SCAN", 3)
    df = spark.range(10).selectExpr(*[f"id + {i} AS c{i}" for i in range(8)])
    stats = colstats.collect_stats(df)
    assert [stats[f"c{i}"]["min"] for i in range(8)] == [float(i) for i in range(8)]
    assert [r["n_unique"] for r in values.unique_counts(df).collect()] == [10] * 8
    monkeypatch.setattr(quantiles, "COLUMNS_PER_SEARCH", 3)
    names = {c: c for c in df.columns}
    found = quantiles.exact_quantiles(df, names, (0.5,), dict.fromkeys(names, 10), direct_cells=0)
    assert [found[c][0.5] for c in df.columns] == [4.5 + i for i in range(8)]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "`a.b` int, `it's ``odd``` double")
    assert [r["column"] for r in profile(df).collect()] == ["a.b", "it's `odd`"]
    assert values.value_counts(df).count() == 4


@pytest.mark.parametrize("shape", ["uniform", "one third equal", "heavy tail", "sorted"])
def test_narrowed_quantiles_equal_numpy(spark, shape):
    rng = np.random.default_rng(5)
    n = 20_000
    cells = {
        "uniform": rng.uniform(-5, 5, n),
        "one third equal": np.where(np.arange(n) % 3 == 0, 7.0, rng.normal(0, 50, n)),
        "heavy tail": np.exp(rng.normal(0, 12, n)),
        "sorted": np.sort(rng.normal(0, 1, n)),
    }[shape]
    df = spark.createDataFrame([(float(c),) for c in cells], "x double").repartition(8)
    if shape == "sorted":
        df = df.sort("x")
    probs = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = quantiles.exact_quantiles(
        df, {"x": "x"}, probs, {"x": n}, direct_cells=100, range_values=200
    )["x"]
    for p in probs:
        assert got[p] == pytest.approx(float(np.percentile(cells, p * 100)), rel=1e-12)


def test_quantiles_of_several_columns_share_a_job_up_to_the_limit(spark):
    df = spark.range(1001).selectExpr("id AS a", "id * 2 AS b", "CAST(NULL AS INT) AS c")
    got = quantiles.exact_quantiles(
        df, {c: c for c in "abc"}, (0.5,), {"a": 1001, "b": 1001, "c": 0}, direct_cells=1500
    )
    assert got == {"a": {0.5: 500.0}, "b": {0.5: 1000.0}}


def test_summary_lists_every_column(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (2, None, 4.0), (3, "a", None)], "k int, s string, x double")
    rows = {r["column"]: r for r in summary(df, ["k"]).collect()}
    assert rows["s"]["samples"] == "b | a"
    assert (rows["x"]["median"], rows["x"]["null_percent"]) == (3.0, 33.3)
    assert rows["k"]["n_unique"] == 3
