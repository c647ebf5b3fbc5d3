"""Cleaning, decisions, remediation, synthesis."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabmend import ColumnSpec, TableSpec, apply_decisions, clean, replace_aliases, strip_strings
from tabmend import synthesize_minority
from tabmend.functions import draws
from tabmend.operators import advise, clean as cleaning, manifest, rowkeys, synthesize
from tabmend.operators.issues import PROFILE_SCHEMA
from tabmend.session import local_table


def column(df, name, by="k"):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r[by])]


# --- cleaning ------------------------------------------------------------------


def test_countries_become_one(spark):
    df = spark.createDataFrame([("US",), ("USA",), ("United States",)], "country string")
    out, log = clean(df)
    assert [r[0] for r in out.collect()] == ["United States"] * 3
    assert log[0]["message"] == "Applied whitespace stripping across 1 string features."
    assert log[1]["message"] == (
        "Normalized 2 aliases in 'country' to canonical values: ['United States']."
    )


def test_strip_takes_all_unicode_space_and_keeps_blank(spark):
    cells = ["\t a b \n", "  x　", " \r\n ", None, "plain"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "k int, s string")
    assert column(strip_strings(df), "s") == ["a b", "x", "", None, "plain"]


@pytest.mark.parametrize("case_pairs, broadcast_pairs", [(32, 100_000), (0, 100_000), (0, 0)])
def test_alias_replacement_does_not_chain(spark, monkeypatch, case_pairs, broadcast_pairs):
    monkeypatch.setattr(cleaning, "CASE_PAIRS", case_pairs)
    monkeypatch.setattr(cleaning, "BROADCAST_PAIRS", broadcast_pairs)
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, None)], "k int, alias string")
    spec = TableSpec({"alias": ColumnSpec(aliases={"a": "b", "b": "c"})})
    out = replace_aliases(df, spec)
    assert out.columns == df.columns
    assert column(out, "alias") == ["b", "c", "c", None]


def test_large_dictionaries_leave_nulls_and_hot_cells_in_place(spark, monkeypatch):
    """Half the cells null, a sixth one alias, a sixth one other text: no task of the join holds more than twice the median."""
    monkeypatch.setattr(cleaning, "CASE_PAIRS", 0)
    monkeypatch.setattr(cleaning, "BROADCAST_BYTES", 1 << 16)
    pairs = {f"v{i}": f"V {i % 1000}" for i in range(20_000)}
    cell = """CASE WHEN id % 6 < 3 THEN NULL WHEN id % 6 = 3 THEN 'v7' WHEN id % 6 = 4 THEN 'other'
              WHEN id % 30 = 5 THEN repeat('v7', 40) ELSE concat('v', id % 40000) END"""
    df = spark.range(0, 240_000, 1, 8).selectExpr("id", f"{cell} AS `c.x`", "'kept' AS alias")
    spec = TableSpec({"c.x": ColumnSpec(aliases=pairs)})
    known = spec.alias_df(spark).select(F.col("alias").alias(cleaning._ALIAS), F.col("canonical").alias(cleaning._CANONICAL))
    settled, rest = cleaning.split_hot(df, "c.x", known, pairs)
    assert settled.count() + rest.count() == 240_000
    assert rest.groupBy("`c.x`").count().agg(F.max("count")).first()[0] < 100
    assert rest.where("`c.x` IS NULL").isEmpty()
    sizes = [r[0] for r in settled.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    out = replace_aliases(df, spec)
    assert out.columns == df.columns
    both = df.withColumnRenamed("c.x", "was").join(out.select("id", F.col("`c.x`").alias("now")), "id").collect()
    assert len(both) == 240_000 and all(r.now == pairs.get(r.was, r.was) for r in both)
    assert replace_aliases(df.limit(0), spec).count() == 0


# --- recommendation --------------------------------------------------------------


def issue_table(spark, rows):
    full = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        full, "ord int, column string, type string, ratio double, minority_value string"
    )


def strategies(recommended):
    return {r["column"]: r["strategy"] for r in recommended.collect()}


def test_recommendations_and_advice(spark):
    found = issue_table(
        spark,
        [
            ("age", "INVALID_BOUNDS", None, None),
            ("salary", "STATISTICAL_OUTLIER", None, None),
            ("churn", "CLASS_IMBALANCE", 0.08, "1"),
        ],
    )
    advised = advise.recommend(found)
    assert strategies(advised) == {
        "age": "STATISTICAL_IMPUTE",
        "salary": "SYNTHETIC_SYNTHESIS",
        "churn": "SYNTHETIC_SYNTHESIS",
    }
    text = "• 'salary':\n  ➜ Recommended Decision: STATISTICAL_IMPUTE\n  ➜ Decision Impact: test."
    assert strategies(advise.advised_strategies(advised, text))["salary"] == "STATISTICAL_IMPUTE"


def test_missingness_decides_first(spark):
    found = issue_table(
        spark,
        [
            ("sparse", "HIGH_NULL_RATIO", 0.95, None),
            ("sparse", "CLASS_IMBALANCE", 0.1, "1"),
            ("some", "HIGH_NULL_RATIO", 0.25, None),
            ("half", "HIGH_NULL_RATIO", 0.5, None),
            ("other", "SOMETHING", None, None),
        ],
    )
    assert strategies(advise.recommend(found)) == {
        "sparse": "DROP",
        "some": "STATISTICAL_IMPUTE",
        "half": "DROP",
        "other": "STATISTICAL_IMPUTE",
    }


def test_advice_has_one_entry_per_column(spark):
    found = issue_table(
        spark,
        [
            ("age", "INVALID_BOUNDS", 0.1, None),
            ("age", "STATISTICAL_OUTLIER", 0.1, None),
            ("age", "STATISTICAL_OUTLIER", 0.1, None),
            ("churn", "CLASS_IMBALANCE", 0.08, "1"),
        ],
    )
    text = advise.advice_text(advise.recommend(found))
    assert text.count("• 'age'") == 1 and text.count("• 'churn'") == 1
    assert "• 'age' (Invalid Bounds & Statistical Outliers):" in text
    assert "(Class Imbalance - 8.0%)" in text
    assert advise.advice_text(advise.recommend(found.limit(0))).endswith("No critical remediation required.")


def test_parsed_advice_stays_inside_its_entry(spark):
    names = spark.createDataFrame([("age",), ("percentage",), ("a.b",), ("z",)], "column string")
    text = (
        "• 'percentage':\n Recommended Decision: DROP\n"
        "• 'age' (no decision here)\n"
        "• 'a.b':\n recommended decision: manual_input\n"
        "• 'z':\n Recommended Decision: NONSENSE\n"
    )
    got = {r["column"]: r["advised"] for r in advise.parse_advice(names, text).collect()}
    assert got == {"percentage": "DROP", "a.b": "MANUAL_INPUT"}


def test_operator_decisions_win(spark):
    recommended = advise.decisions_table(spark, {"a": "DROP", "b": "STATISTICAL_IMPUTE"})
    mine = advise.decisions_table(spark, {"b": "MANUAL_INPUT:3", "c": "DROP"})
    merged = advise.merge_decisions(recommended, mine)
    assert advise.as_decisions(merged) == {"a": "DROP", "b": "MANUAL_INPUT:3", "c": "DROP"}


def test_manifest_texts(spark):
    base = {"ord": 0, "rows": 100, "outliers": 0, "checked": True, "is_target": False, "binary": False}
    rows = [
        {**base, "column": "cat", "kind": "string", "nulls": 25},
        {**base, "column": "code", "kind": "integer", "semantic_type": "categorical", "nulls": 0},
        {**base, "column": "num", "kind": "float", "nulls": 25, "outliers": 4},
        {**base, "column": "gone", "kind": "string", "nulls": 90},
        {**base, "column": "full", "kind": "string", "nulls": 0},
        {**base, "column": "out", "kind": "float", "nulls": 0, "outliers": 3},
        {**base, "column": "y", "kind": "integer", "nulls": 0, "is_target": True, "binary": True,
         "minority_n": 8, "classes_n": 100},
    ]
    profile = local_table(spark, [{n: r.get(n) for n in PROFILE_SCHEMA.names} for r in rows], PROFILE_SCHEMA)
    decided = advise.decisions_table(
        spark,
        {
            "cat": "STATISTICAL_IMPUTE",
            "code": "STATISTICAL_IMPUTE",
            "num": "STATISTICAL_IMPUTE",
            "gone": "DROP",
            "full": "DROP_COLUMN",
            "out": "SYNTHETIC_SYNTHESIS",
            "y": "SYNTHETIC_SYNTHESIS",
            "unseen": "MANUAL_INPUT:7:5",
        },
    )
    got = {r["column"]: (r["tool"], r["description"]) for r in manifest.planned_actions(decided, profile).collect()}
    assert got == {
        "cat": ("IMPUTE", "Mode Impute (25 NA (25.0%))"),
        "code": ("IMPUTE", "Mode Impute"),
        "num": ("IMPUTE", "Median Impute (4 outliers (4.0%), 25 NA (25.0%))"),
        "gone": ("DROP", "Drop column (90 NA (90.0%), preserves all records)"),
        "full": ("DROP", "Drop column (preserves all records)"),
        "out": ("SYNTHESIS", "Gaussian Synthesis (3 outliers (3.0%))"),
        "y": ("SYNTHESIS", "Generate +41 synthetic rows to balance class"),
        "unseen": ("MANUAL", "Manual override: 7:5"),
    }


# --- remediation -----------------------------------------------------------------


def test_manual_override(spark):
    rows = list(enumerate(zip([50, 55, 60, None, 9999], ["A", "B", None, "A", "B"])))
    df = spark.createDataFrame([(k, s, c) for k, (s, c) in rows], "k int, score bigint, category string")
    spec = TableSpec(
        {"score": ColumnSpec(bounds=(0, 100)), "category": ColumnSpec(semantic_type="categorical")}
    )
    out, log = apply_decisions(
        df, {"score": "manual_input:75", "category": "MANUAL_INPUT:DefaultCat"}, spec
    )
    assert column(out, "score") == [50, 55, 60, 75, 75]
    assert column(out, "category") == ["A", "B", "DefaultCat", "A", "B"]
    assert "replaced 2 anomalous records with override value '75'" in log[0]["message"]
    assert out.schema == df.schema


@pytest.mark.parametrize(
    "dtype, text, expected",
    [
        ("int", "75.9", 75),
        ("int", "abc", None),
        ("int", "5e9", None),
        ("double", "0.5", 0.5),
        ("boolean", "Yes", True),
        ("boolean", "no", False),
        ("string", "a:b", "a:b"),
        ("int", "", None),
        ("decimal(6,2)", "1.25", 1.25),
        ("date", "not a date", None),
    ],
)
def test_override_values_are_typed(spark, dtype, text, expected):
    df = spark.createDataFrame([(1,)], "k int").withColumn("x", F.lit(None).cast(dtype))
    out, log = apply_decisions(df, {"x": f"MANUAL_INPUT:{text}"})
    got = out.first()["x"]
    assert (float(got) if dtype.startswith("decimal") else got) == expected
    assert ("skipped" in log[0]["message"] or "failed" in log[0]["message"]) == (expected is None)


def test_drop_keeps_rows(spark):
    df = spark.createDataFrame([(i, a, 50000) for i, a in enumerate([25] * 7 + [None, -10, 200])], "id int, age int, salary int")
    out, log = apply_decisions(df, {"age": "DROP"})
    assert out.columns == ["id", "salary"] and out.count() == 10
    assert "removed feature column from dataset (preserved all 10 records)" in log[0]["message"]


def test_median_ignores_anomalies_and_truncates(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 3, 4, None, 1000])], "k int, x int")
    spec = TableSpec({"x": ColumnSpec(bounds=(0, 100))})
    out, log = apply_decisions(df, {"x": "STATISTICAL_IMPUTE"}, spec)
    assert column(out, "x") == [1, 2, 3, 4, 2, 2]
    assert log[0]["message"].endswith("imputed anomalies with median (2).")


def test_median_falls_back_to_all_cells(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 7.0), (2, None)], "k int, x double")
    spec = TableSpec({"x": ColumnSpec(bounds=(100, 200))})
    assert column(apply_decisions(df, {"x": "STATISTICAL_IMPUTE"}, spec)[0], "x") == [6.0, 6.0, 6.0]


def test_mode_fills_only_nulls(spark):
    df = spark.createDataFrame(
        [(i, v, w) for i, (v, w) in enumerate([("b", 9), ("a", 9), ("a", 1), ("b", None), (None, 10)])],
        "k int, s string, code int",
    )
    spec = TableSpec({"code": ColumnSpec(semantic_type="categorical", bounds=(0, 5))})
    out, _ = apply_decisions(df, {"s": "STATISTICAL_IMPUTE", "code": "STATISTICAL_IMPUTE"}, spec)
    assert column(out, "s") == ["b", "a", "a", "b", "a"]
    assert column(out, "code") == [9, 9, 1, 9, 10]


def test_nothing_to_do_is_logged(spark):
    df = spark.sql("SELECT 1 AS k, CAST(NULL AS DOUBLE) AS e, CAST(NULL AS STRING) AS s, DATE'2024-01-01' AS d")
    decisions = {
        "e": "STATISTICAL_IMPUTE",
        "s": "STATISTICAL_IMPUTE",
        "d": "STATISTICAL_IMPUTE",
        "k": "WHATEVER",
        "nope": "DROP",
    }
    out, log = apply_decisions(df, decisions)
    assert out.collect() == df.collect()
    assert [e["message"].split(":")[0].split(" ")[0] for e in log] == [
        "STATISTICAL_IMPUTE", "STATISTICAL_IMPUTE", "STATISTICAL_IMPUTE", "Unknown", "Skipped",
    ]
    out, log = apply_decisions(df, {"s": "SYNTHETIC_SYNTHESIS", "e": "SYNTHETIC_SYNTHESIS"})
    assert out.collect() == df.collect()
    assert "no synthesis method available" in log[0]["message"]
    assert "No valid data" in log[1]["message"]


def gauss_frame(spark):
    return spark.range(400).selectExpr(
        "id", "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 = 1 THEN -50 ELSE 20 + id % 7 END AS x",
        "CAST(CASE WHEN id % 9 = 0 THEN 1e6 ELSE id % 11 END AS DOUBLE) AS y",
    )


def test_gaussian_replacement_stays_inside_and_does_not_depend_on_partitions(spark):
    df = gauss_frame(spark)
    spec = TableSpec(
        {"id": ColumnSpec("id"), "x": ColumnSpec(bounds=(0, 24)), "y": ColumnSpec(bounds=(0, 100))}
    )
    decisions = {"x": "SYNTHETIC_SYNTHESIS", "y": "SYNTHETIC_SYNTHESIS"}
    one, _ = apply_decisions(df, decisions, spec)
    two, _ = apply_decisions(df.repartition(7, "y"), decisions, spec)
    three, _ = apply_decisions(df, decisions, spec, seed=9)
    rows = {r["id"]: (r["x"], r["y"]) for r in one.collect()}
    assert rows == {r["id"]: (r["x"], r["y"]) for r in two.collect()}
    assert rows != {r["id"]: (r["x"], r["y"]) for r in three.collect()}
    for r in df.collect():
        x, y = rows[r["id"]]
        assert 0 <= x <= 24 and 0 <= y <= 100
        if r["x"] is not None and 0 <= r["x"] <= 24:
            assert x == r["x"]


def test_gaussian_replacement_without_a_key(spark, monkeypatch):
    monkeypatch.setattr(rowkeys, "COPIES_PER_CHUNK", 10)
    # a third of all rows are copies of one row
    df = spark.range(300).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 20 AS STRING) END AS g",
        "CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 5 AS DOUBLE) END AS x",
    )
    decisions = {"x": "SYNTHETIC_SYNTHESIS"}
    one = sorted(map(tuple, apply_decisions(df, decisions)[0].collect()))
    two = sorted(map(tuple, apply_decisions(df.repartition(5), decisions)[0].collect()))
    assert one == two and len(one) == 300
    hot = [x for g, x in one if g == "hot"]
    assert len(hot) == 100 and len(set(hot)) > 50  # copies draw on their own


def test_rows_without_a_key_are_keyed_where_they_lie(spark):
    """A row that is its own keeps its digest; repeated and null rows get numbers; digests that clash do no harm."""
    rows = [(i, f"s{i}") for i in range(50)] + [(1, "s1"), (None, None), (None, None), (None, "\x1e")]
    df = spark.createDataFrame(rows, "a int, b string")
    keyed = rowkeys.with_row_key(df, []).collect()
    assert len({r[rowkeys.ROW_KEY] for r in keyed if r.b != "\x1e"}) == len(rows) - 1
    assert Counter((r.a, r.b) for r in keyed) == Counter(rows)
    assert sum(r[rowkeys.ROW_KEY].startswith("again|") for r in keyed) == 5
    again = rowkeys.with_row_key(df.repartition(3), []).collect()
    assert {r[rowkeys.ROW_KEY] for r in again} == {r[rowkeys.ROW_KEY] for r in keyed}


def test_copy_numbers_are_complete(spark, monkeypatch):
    monkeypatch.setattr(rowkeys, "COPIES_PER_CHUNK", 7)
    df = spark.range(100).selectExpr("id % 3 AS a", "CAST(NULL AS STRING) AS b")
    keyed = rowkeys.with_row_key(df, [])
    got = [r[rowkeys.ROW_KEY] for r in keyed.collect()]
    assert len(got) == len(set(got)) == 100
    assert keyed.drop(rowkeys.ROW_KEY).groupBy("a").count().count() == 3


def test_outliers_are_replaced_on_request(spark):
    df = spark.range(100).selectExpr("id", "CAST(CASE WHEN id = 5 THEN 900 ELSE id % 4 END AS DOUBLE) AS x")
    spec = TableSpec({"id": ColumnSpec("id"), "x": ColumnSpec(bounds=(0, 1000))})
    kept, _ = apply_decisions(df, {"x": "SYNTHETIC_SYNTHESIS"}, spec)
    out, _ = apply_decisions(df, {"x": "SYNTHETIC_SYNTHESIS"}, spec, include_outliers=True)
    assert kept.agg(F.max("x")).first()[0] == 900.0
    assert out.agg(F.max("x")).first()[0] < 10


def test_gauss_on_a_rare_class_says_that_no_rows_come(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 33 = 1 THEN 1 ELSE 0 END AS vip")
    spec = TableSpec({"id": ColumnSpec("id"), "vip": ColumnSpec(semantic_type="binary", bounds=(0, 1))}, "churn")
    _, log = apply_decisions(df, {"vip": "SYNTHETIC_SYNTHESIS"}, spec)
    assert [e["message"].endswith("Not the target: no rows were added, its rarer class keeps 3.3%.") for e in log] == [True]


# --- synthesis -------------------------------------------------------------------


def label_frame(spark):
    return spark.range(20).selectExpr("id", "CAST(50 + id AS DOUBLE) AS score", "CAST(id >= 18 AS INT) AS label")


LABEL_SPEC = TableSpec(
    {
        "id": ColumnSpec("id", "id"),
        "score": ColumnSpec(),
        "label": ColumnSpec("target", "categorical"),
    },
    "label",
)


def test_seeds(spark):
    def scores(seed):
        out, _ = synthesize_minority(label_frame(spark), "label", 0.3, LABEL_SPEC, seed)
        return column(out, "score", "id")

    assert scores(42) == scores(42) != scores(999)


def test_balance_and_types(spark):
    out, message = synthesize_minority(label_frame(spark), "label", 0.3, LABEL_SPEC)
    assert out.dtypes == label_frame(spark).dtypes
    new = [r for r in out.collect() if r["id"] >= 20]
    assert [r["id"] for r in sorted(new)] == [1020 + i for i in range(len(new))]
    assert {r["label"] for r in new} == {1}
    assert all(50 <= r["score"] <= 69 for r in new)
    assert len(new) == int((0.3 * 20 - 2) / 0.7)
    assert "Imbalance corrected from 10.0% to 28.0%." in message


def test_synthetic_ids_do_not_meet_existing_ones(spark):
    df = label_frame(spark).withColumn("id", F.col("id") * 1000)
    out, _ = synthesize_minority(df, "label", 0.3, LABEL_SPEC)
    assert out.select("id").distinct().count() == out.count()


def test_skips(spark):
    empty = spark.createDataFrame([], "id bigint, score double, target bigint")
    out, message = synthesize_minority(empty, "target")
    assert out.count() == 0 and "Empty dataset provided" in message
    nulls = spark.range(5).selectExpr("id", "CAST(NULL AS INT) AS target")
    assert "Could not determine" in synthesize_minority(nulls, "target")[1]
    even = spark.range(10).selectExpr("id", "id % 2 AS target")
    assert "already adequate" in synthesize_minority(even, "target")[1]


def test_null_targets_count_in_the_size(spark):
    df = spark.range(100).selectExpr("CASE WHEN id < 40 THEN NULL ELSE CAST(id < 50 AS INT) END AS y")
    balance = synthesize.balance_of(df, "y")
    assert (balance.rows, balance.minority_value, balance.minority) == (100, "1", 10)
    assert balance.needed == int((0.35 * 100 - 10) / 0.65)
    declared = TableSpec({"y": ColumnSpec("target", "binary", minority_value="0")})
    assert synthesize.balance_of(df, "y", declared).minority == 50


def test_long_lists_are_joined_by_position(spark, monkeypatch):
    df = spark.range(300).selectExpr("concat('v', id % 90) AS s", "CAST(id >= 280 AS INT) AS y")
    spec = TableSpec({"s": ColumnSpec(semantic_type="categorical")}, "y")
    monkeypatch.setattr(synthesize, "LITERAL_VALUES", 10)
    monkeypatch.setattr(synthesize, "VALUES_PER_BUCKET", 8)
    one, _ = synthesize_minority(df, "y", spec=spec)
    two, _ = synthesize_minority(df.repartition(5), "y", spec=spec)
    rows = one.exceptAll(df)
    assert rows.count() == int((0.35 * 300 - 20) / 0.65)
    assert rows.where("s IS NULL").count() == 0 and rows.select("s").distinct().count() > 50
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_numbered_values_are_a_range(spark):
    df = spark.range(1000).selectExpr("CAST(id AS STRING) AS value")
    numbered = synthesize.number_values(df, 1000).collect()
    assert sorted(r["at"] for r in numbered) == list(range(1000))
    assert len({r["value"] for r in numbered}) == 1000


def test_binary_features_keep_their_shares(spark):
    df = spark.range(10_000).selectExpr("id % 4 = 0 AS flag", "CAST(id < 500 AS INT) AS y")
    spec = TableSpec({"flag": ColumnSpec(semantic_type="binary")}, "y")
    balance = synthesize.balance_of(df, "y", spec)
    rows = synthesize.synthetic_rows(df, "y", balance, spec)
    share = rows.selectExpr("avg(CAST(flag AS INT))").first()[0]
    assert share == pytest.approx(0.25, abs=0.03)


def test_long_weighted_lists_keep_their_shares(spark):
    """1,001 values, one of them in a third of all rows."""
    df = spark.range(12_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('v', id % 1000) END AS s", "CAST(id < 400 AS INT) AS y"
    )
    assert df.select("s").distinct().count() == 1001
    spec = TableSpec({"s": ColumnSpec(semantic_type="binary")}, "y")
    balance = synthesize.balance_of(df, "y", spec)
    rows = synthesize.synthetic_rows(df, "y", balance, spec)
    again = synthesize.synthetic_rows(df.repartition(5), "y", balance, spec)
    assert rows.count() == balance.needed and rows.where("s IS NULL").count() == 0
    assert rows.selectExpr("avg(CAST(s = 'hot' AS INT))").first()[0] == pytest.approx(1 / 3, abs=0.03)
    assert rows.select("s").distinct().count() > 900
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))


def test_people(spark):
    df = spark.range(50).selectExpr(
        "concat('n', id) AS full_name", "'e' AS email", "'a' AS home_address", "'x' AS notes",
        "CAST(id = 0 AS INT) AS y",
    )
    columns = {c: ColumnSpec("ignore", "text") for c in ("full_name", "email", "home_address", "notes")}
    balance = synthesize.balance_of(df, "y")
    rows = synthesize.synthetic_rows(df, "y", balance, TableSpec(columns, "y")).collect()
    assert all(len(r["full_name"].split()) == 2 for r in rows)
    assert all(r["email"].endswith("@example.com") and " " not in r["email"] for r in rows)
    assert all("," in r["home_address"] and r["notes"] is None for r in rows)


def test_later_decisions_see_the_new_rows(spark):
    df = spark.range(100).selectExpr(
        "CAST(id < 5 AS INT) AS y", "CASE WHEN id % 2 = 0 THEN NULL ELSE CAST(id AS DOUBLE) END AS x"
    )
    spec = TableSpec({"y": ColumnSpec("target", "binary")}, "y")
    out, log = apply_decisions(df, {"y": "SYNTHETIC_SYNTHESIS", "x": "STATISTICAL_IMPUTE"}, spec)
    assert out.count() == 100 + int((0.35 * 100 - 5) / 0.65)
    assert out.where("x IS NULL").count() == 0
    assert [e["column"] for e in log] == ["y", "x"]


def test_draws_are_uniform_and_normal(spark):
    df = spark.range(20_000).select(
        draws.uniform(1, "c", "u", F.col("id")).alias("u"), draws.normal(1, "c", F.col("id")).alias("z")
    )
    row = df.selectExpr("avg(u)", "min(u)", "max(u)", "avg(z)", "stddev_pop(z)").first()
    assert row[0] == pytest.approx(0.5, abs=0.01) and 0 < row[1] and row[2] < 1
    assert row[3] == pytest.approx(0, abs=0.03) and row[4] == pytest.approx(1, abs=0.03)


# --- rare classes, repeated ids, nested columns ------------------------------------


def test_rare_class_of_a_feature_stays(spark):
    df = spark.range(1000).selectExpr("id", "CAST(id % 25 = 0 AS int) AS vip", "CAST(id % 10 = 0 AS int) AS churn")
    spec = TableSpec({"vip": ColumnSpec(semantic_type="binary"), "churn": ColumnSpec(role="target", semantic_type="binary")}, "churn")
    for strategy in ("SYNTHETIC_SYNTHESIS", "STATISTICAL_IMPUTE"):
        out = apply_decisions(df, {"vip": strategy}, spec, include_outliers=True)[0]
        assert out.where("vip = 1").count() == 40


def test_every_row_has_its_own_key(spark):
    rows = [(None, 1)] * 3 + [("", 2), ("a", 3), ("a", 4), ("b", 5)]
    df = spark.createDataFrame(rows, "id string, x int").withColumn("m", F.create_map(F.lit("k"), "x"))
    for ids in (["id"], []):
        keyed = rowkeys.with_row_key(df, ids)
        keys = [r[rowkeys.ROW_KEY] for r in keyed.collect()]
        assert len(set(keys)) == len(keys) == 7
        assert sorted(map(str, keyed.drop(rowkeys.ROW_KEY).collect())) == sorted(map(str, df.collect()))
    alone = rowkeys.with_row_key(df.where("x > 3"), ["id"]).collect()
    assert sorted(r[rowkeys.ROW_KEY] for r in alone) == ["a", "b"]


def test_nested_columns_are_left_alone(spark):
    df = spark.createDataFrame([(1, [1]), (2, None)], "id int, a array<int>")
    spec = TableSpec({"a": ColumnSpec(semantic_type="categorical")})
    out = apply_decisions(df, {"a": "STATISTICAL_IMPUTE"}, spec)[0]
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))


def test_csv_keeps_blanks_apart_from_nulls(spark, tmp_path):
    from tabmend.sources import csv as csvs

    df = spark.createDataFrame([(1, ""), (2, None), (3, " x ")], "k int, s string")
    back = csvs.read_csv(spark, csvs.write_csv(df, str(tmp_path / "c")), df.schema)
    assert column(back, "s") == ["", None, " x "]


def test_weighted_synthesis_follows_frequency(spark):
    """Uniform by default; ``weighted`` draws categories as often as they are seen, from short lists and long ones."""
    df = spark.range(0, 20_000).selectExpr(
        "CASE WHEN id % 10 = 0 THEN 'rare' ELSE 'often' END AS tone",
        "CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('w', id % 4000) END AS word",
        "CAST(id % 100 = 0 AS INT) AS y",
    )
    spec = TableSpec({"tone": ColumnSpec(semantic_type="categorical"), "word": ColumnSpec(semantic_type="categorical")}, "y")
    shares = {}
    for weighted in (False, True):
        rows, _ = synthesize.minority_rows(df, "y", spec=spec, weighted=weighted)
        got = rows.agg(F.avg((F.col("tone") == "rare").cast("int")), F.avg((F.col("word") == "hot").cast("int")), F.count("word"), F.count("*"))
        shares[weighted] = got.first()
    assert abs(shares[False][0] - 0.5) < 0.03 and shares[False][1] < 0.01
    assert abs(shares[True][0] - 0.1) < 0.03 and abs(shares[True][1] - 0.5) < 0.03
    assert all(s[2] == s[3] > 9_000 for s in shares.values())
