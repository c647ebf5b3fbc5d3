"""Roles, domains, aliases, target, supplied schemas."""

import pytest

from tabmend import ColumnSpec, TableSpec, infer
from tabmend.operators import aliases
from tabmend.operators.infer import classify, colstats_table, fences, infer_rules


def roles(spec):
    return {c: s.role for c, s in spec.columns.items()}


def test_transactions(spark):
    rows = [
        (f"TX_{i}", f"Desc {i}", [100.0, -10.0, 99999.0][max(0, i - 47)], int(i >= 46))
        for i in range(50)
    ]
    df = spark.createDataFrame(rows, "transaction_id string, description string, amount double, is_fraud int")
    spec = infer(df)
    assert roles(spec) == {
        "transaction_id": "id",
        "description": "ignore",
        "amount": "feature",
        "is_fraud": "target",
    }
    assert spec.target == "is_fraud" and spec.method == "heuristic"
    assert spec.columns["amount"].semantic_type == "numerical"
    assert spec.columns["is_fraud"].minority_value == "1"
    assert spec.columns["transaction_id"].description == "Identifier column (50 unique values)"


def test_nominal_numbers_are_ignored(spark):
    rows = [
        (f"P_{i}", 100 + i, 10001 + i % 50, 5550000 + i, 100.0 + i, 25 + i % 60) for i in range(200)
    ]
    df = spark.createDataFrame(
        rows, "permit_id string, `Street Number` int, Zipcode int, phone int, amount double, age int"
    )
    spec = infer(df)
    assert spec.ignore_columns == ["Street Number", "Zipcode", "phone"]
    assert spec.id_columns == ["permit_id"]
    assert {spec.semantic(c) for c in ("amount", "age")} == {"numerical"}
    assert spec.target is None


@pytest.mark.parametrize("exact", [True, False])
def test_estimates_do_not_change_roles(spark, sf, exact):
    from catalog.views import dirty

    spec = infer_rules(dirty(spark, sf), exact=exact)
    assert roles(spec) == {
        "customer_id": "id",
        "name": "ignore",
        "age": "feature",
        "balance": "feature",
        "sparse": "feature",
        "country": "feature",
        "market": "feature",
        "segment": "feature",
        "nation_code": "feature",
        "churn": "target",
    }
    assert spec.bounds("age") == (-10.0, 94.0)


def test_dates_and_nested_columns_fall_to_the_default(spark):
    df = spark.sql(
        "SELECT DATE'2024-01-01' + CAST(id AS INT) AS day, array(id) AS list, "
        "id % 2 = 0 AS flag, CAST(id AS DECIMAL(10, 2)) AS price FROM range(40)"
    )
    spec = infer(df)
    assert {c: spec.semantic(c) for c in df.columns} == {
        "day": "categorical",
        "list": "categorical",
        "flag": "binary",
        "price": "numerical",
    }


def test_sketches_decide_only_far_from_thresholds(spark):
    df = spark.range(30_000).selectExpr("id AS user_id", "id % 20000 AS near_key", "CAST(id AS DOUBLE) AS x")
    rows = {r["column"]: r for r in classify(colstats_table(df, exact=False)).collect()}
    assert rows["user_id"]["role"] == "id" and rows["near_key"]["role"] == "feature"
    assert rows["near_key"]["unique_exact"]  # 0.667 is too near 0.7 for an estimate
    assert not rows["x"]["unique_exact"]


def test_fences():
    assert fences(10.0, 20.0, -99.0, 99.0, 0.5) == (-5.0, 35.0)
    assert fences(10.0, 20.0, 0.0, 99.0, 0.99) == (0.0, 35.0)
    assert fences(5.0, 5.0, -3.0, 8.0, 0.9) == (-3.0, 8.0)
    assert fences(5.0, 5.0, -3.0, 8.0, 0.95) == (0.0, 8.0)


def alias_map(spark, cells, find=None):
    df = spark.createDataFrame([("c", v) for v in cells], "column string, value string")
    rows = []
    for f in [find] if find else [aliases.key_aliases, aliases.acronym_aliases]:
        rows += f(df).collect()
    return {r["alias"]: r["canonical"] for r in rows}


def test_spellings(spark):
    got = alias_map(spark, ["new york", "New York", "NEW-YORK", "Boston"])
    assert got == {"new york": "New York", "NEW-YORK": "New York"}
    # no title-cased spelling: the longest, then the smaller
    assert alias_map(spark, ["aB", "a-B", "a B"]) == {"aB": "a B", "a-B": "a B"}


def test_acronyms(spark):
    cells = ["US", "USA", "US_OFFICIAL", "USAF", "United States", "UK", "United Kingdom"]
    assert alias_map(spark, cells) == {
        "US": "United States",
        "USA": "United States",
        "US_OFFICIAL": "United States",
        "UK": "United Kingdom",
    }


def test_members_of_a_spelling_group_take_no_part(spark):
    cells = ["US", "USA", "United States", "united states"]
    assert alias_map(spark, cells) == {"united states": "United States"}


def brute_force_acronyms(cells):
    """One value after the other, in ascending order, each alias claimed once."""
    import re

    keys = [re.sub("[^a-z0-9]", "", c.lower()) for c in cells]
    cells = [c for c, k in zip(cells, keys) if keys.count(k) == 1]
    claimed, found = set(), {}
    for value in sorted(cells):
        parts = [p for p in re.split(r"[\s_\-]+", value.strip()) if p]
        if value in claimed or len(parts) < 2:
            continue
        short = "".join(p[0] for p in parts).upper()
        for other in cells:
            text = other.strip().upper()
            near = text.startswith(short) and len(text) <= len(short) + 1
            if other == value or other in claimed:
                continue
            if near or text.startswith(short + "_"):
                claimed.add(other)
                found[other] = value
    return found


@pytest.mark.parametrize(
    "cells",
    [
        ["A B", "AB_X", "AX_Y", "AY_Z", "AZ", "AZQ"],
        ["Ab Cd", "Ad Ce", "AC", "ACX", "ac_x y", "X Y", "XYZ", "XY-", "X_Y"],
        ["Q", "Q_", "Quite Long Name", "QLN", "QLNS", "QLNSS", "QLN_1 2"],
    ],
)
def test_claims_equal_the_sequential_rule(spark, cells):
    assert alias_map(spark, cells, aliases.acronym_aliases) == brute_force_acronyms(cells)


def sequential_acronyms(cells):
    """The sequential rule by look-up, for long columns without other spellings."""
    import re

    keys, names = {}, {}
    for c in cells:
        text, parts = c.strip().upper(), [p for p in re.split(r"[\s_\-]+", c.strip()) if p]
        keys[c] = {text, text[:-1] if len(text) > 1 else "", text.split("_")[0] if text.find("_") > 0 else ""} - {""}
        if len(parts) > 1:
            names[c] = "".join(p[0] for p in parts).upper()
    by_key: dict[str, list[str]] = {}
    for c in cells:
        for k in keys[c]:
            by_key.setdefault(k, []).append(c)
    found: dict[str, str] = {}
    for name in sorted(names):
        if name not in found:
            for other in by_key.get(names[name], []):
                if other != name and other not in found:
                    found[other] = name
    return found


def test_claims_of_a_long_column(spark):
    """100,000 phrases with chains of claims and hot initials, against the sequential rule."""
    import random

    r = random.Random(7)
    cells = {f"{a}{i % 97}x_{b}{i} {c}{i}" for i in range(60_000) for a, b, c in [r.choices("ABC", k=3)]}
    cells |= {f"{r.choice('ABCD')}{r.choice('ABCD')}{r.choice('ABCD')}_{r.choice('ABCD')}n{i} Z{i}" for i in range(39_000)}
    cells |= {f"{a}{b}{c}{d}" for a in "ABCD" for b in "ABCD" for c in "ABCDZ" for d in ["", "A", "Z", "1"]}
    cells |= {f"HOT{i} Word{i}" for i in range(1_000)} | {"HW", "HWQ", "HW_1"}
    want = sequential_acronyms(sorted(cells))
    assert len(want) > 5_000 and any(c in want and len(c) > 8 for c in cells)
    assert sequential_acronyms(["A B", "AB_X", "AX_Y", "AY_Z", "AZ"]) == brute_force_acronyms(["A B", "AB_X", "AX_Y", "AY_Z", "AZ"])
    assert alias_map(spark, sorted(cells), aliases.acronym_aliases) == want


def test_claims_in_a_chain(spark):
    """Each name claims the next: every second one is active, however long the chain."""
    cells = ["AA_B CC"] + [f"A{x}_{y} Z" for x, y in zip("BCDEFGHIJ", "CDEFGHIJK")]
    assert alias_map(spark, cells, aliases.acronym_aliases) == brute_force_acronyms(cells)
    two = spark.createDataFrame([("c", "A B"), ("d", "AB"), ("d", "A C")], "column string, value string")
    assert aliases.acronym_aliases(two).isEmpty()  # columns don't claim each other's values
    assert aliases.acronym_aliases(two.limit(0)).isEmpty()


def test_alias_limits(spark):
    rows = [("c", f"v{i:04d}", 1 + i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "column string, value string, n int")
    kept = {r["value"] for r in aliases.alias_sample(df, 250).collect()}
    expected = sorted(rows, key=lambda r: (-r[2], r[1]))[:250]
    assert kept == {r[1] for r in expected}
    many = [f"w{i}" for i in range(1200)] + ["Az By", "AB"]  # a long column keeps its aliases
    assert alias_map(spark, many, aliases.acronym_aliases) == brute_force_acronyms(many) != {}


def test_titles_in_any_script(spark):
    cells = ["são paulo", "SÃO PAULO", "São Paulo"]
    assert set(alias_map(spark, cells, aliases.key_aliases).values()) == {"São Paulo"}


def test_supplied_schema_replaces_inference(spark):
    df = spark.createDataFrame([(1, "x", 1)], "a int, b string, y int")
    document = """Here it is:
    ```json
    {"target_column": "y", "columns": {
       "a": {"valid_bounds": [0, 5], "role": "feature"},
       "b": {"semantic_type": "categorical", "canonical_aliases": {"X": ["x", "xx"]}},
       "y": {"role": "target", "semantic_type": "binary", "minority_class_value": 1},
       "gone": {"role": "id"}}}
    ```"""
    spec = infer(df, override=document)
    assert spec.method == "override" and spec.target == "y"
    assert spec.columns == {
        "a": ColumnSpec(bounds=(0.0, 5.0)),
        "b": ColumnSpec(semantic_type="categorical", aliases={"x": "X", "xx": "X"}),
        "y": ColumnSpec("target", "binary", minority_value="1"),
    }
    assert infer(df, override={"columns": {"a": {}}}).columns == {"a": ColumnSpec()}


def test_spec_survives_storage(spark):
    spec = TableSpec(
        {
            "a": ColumnSpec("target", "binary", minority_value="1"),
            "b": ColumnSpec(bounds=(None, 5.0), aliases={"x": "X"}, description="d"),
        },
        "a",
    )
    again = TableSpec.from_df(spec.to_df(spark), spec.alias_df(spark))
    assert (again.columns, again.target) == (spec.columns, spec.target)
