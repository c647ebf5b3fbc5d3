"""Sources, sinks, ledger, plan and apply, and the registered queries."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from tabmend import apply, dry_run, export, load_plan, plan
from tabmend.operators import verify
from tabmend.sources import csv as csvs, ledger as ledgers
from tabmend.sources.dirty import dirty_customers


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_only_touched_columns_are_profiled_again(spark, monkeypatch):
    """The merged profile equals a full one, whatever was decided; new rows or another input bring the full one back."""
    df = spark.range(400).selectExpr(
        "concat('k', id) AS key", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 50 END AS age", "CAST(id % 91 AS DOUBLE) AS other",
        "CASE id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'us ' ELSE 'Peru' END AS country", "CAST(id % 20 = 0 AS INT) AS churn", "id % 9 AS `odd.name`",
    )
    planned = plan(df)
    read = []
    asked = verify.collect_profile
    monkeypatch.setattr(verify, "collect_profile", lambda d, spec: read.append(d.columns) or asked(d, spec))
    for decisions in ({"age": "MANUAL_INPUT:200", "other": "DROP"}, {"odd.name": "MANUAL_INPUT:3"}, {}, {"churn": "SYNTHETIC_SYNTHESIS"}):
        full = apply(df, planned, decisions)
        short = apply(df, planned, decisions, same_input=True)
        assert sorted(map(str, short.profile.collect())) == sorted(map(str, full.profile.collect()))
        assert sorted(map(str, short.residual.collect())) == sorted(map(str, full.residual.collect()))
    assert read[0] == ["age", "country"] and all("key" not in columns for columns in read)
    short = apply(df.limit(50), planned, {"age": "MANUAL_INPUT:3"}, same_input=True)
    assert short.profile.select("rows").distinct().collect() == [(50,)]


def test_files_of_a_plan(spark):
    planned = plan(spark.range(7).selectExpr("id AS a"), source="/in/t", run_id="r")
    files = planned.files("/out").orderBy("ord").collect()
    assert tuple(files[0])[1:] == ("[READ]", "/in/t", "7 rows") and tuple(files[-1])[1:] == ("[WRITE]", "/out/ledger", "State: r")
    assert {f.path for f in files if f.action == "[CREATE]"} == {f"/out/{p}" for p in ("data", "decisions", "delta", "profile", "residual", "report")}
    assert plan(spark.range(0)).files("/out").first().description == "0 rows"


def test_csv_types_promote_over_all_rows(spark, tmp_path):
    lines = "".join(f"{i},100,2024-01-0{1 + i % 9}\n" for i in range(150))
    df = csvs.read_csv(spark, write(tmp_path, "a.csv", "id,amount,day\n" + lines + "151,1024.86,\n"))
    assert dict(df.dtypes) == {"id": "int", "amount": "double", "day": "string"}
    assert df.count() == 151


def test_cells_that_do_not_parse_are_null(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    df = csvs.read_csv(spark, write(tmp_path, "a.csv", "a,b\n1,x\nbad,y\n"), schema)
    assert [tuple(r) for r in df.collect()] == [(1, "x"), (None, "y")]


@pytest.mark.parametrize("text", [None, "", "col1,col2\n1\n2,3,4,5\n"])
def test_bad_input_is_rejected(spark, tmp_path, text):
    path = str(tmp_path / "none.csv") if text is None else write(tmp_path, "b.csv", text)
    with pytest.raises(csvs.InvalidInput):
        csvs.validate_csv(spark, path)


def test_good_input_passes(spark, tmp_path):
    path = write(tmp_path, "g.csv", 'a,b\n1,"x, y"\n2,\n')
    assert csvs.validate_csv(spark, path) == path


def test_csv_round_trip_keeps_spaces_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, " a "), (2, 'say "hi", ok'), (3, None)], "k int, s string")
    path = csvs.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, csvs.read_csv(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))


def orders(spark):
    rows = [(f"ORD_{i}", [100.0, 50000.0, None][max(0, i - 57)], int(i < 55)) for i in range(60)]
    return spark.createDataFrame(rows, "order_id string, amount double, status int")


def test_orders_end_to_end(spark, tmp_path):
    df = orders(spark)
    p = plan(df, source="orders.csv")
    assert p.state == "waiting"
    out = str(tmp_path / "run")
    decisions = {"amount": "STATISTICAL_IMPUTE", "status": "SYNTHETIC_SYNTHESIS"}
    result = export(df, p, out, decisions, format="csv")
    back = csvs.read_csv(spark, f"{out}/data", result.data.schema)
    row = back.selectExpr("count(1)", "count_if(amount IS NULL)", "max(amount)").first()
    assert row[0] > 60 and row[1] == 0 and row[2] < 50000
    status = ledgers.status(spark.read.parquet(f"{out}/ledger"), p.run_id).first()
    assert status["is_completed"] and not status["is_waiting"]
    assert status["seed"] == 42 and status["duration_sec"] >= 0 and status["source"] == "orders.csv"
    report = "\n".join(r[0] for r in spark.read.text(f"{out}/report").collect())
    assert f"| rows written | {row[0]:,} (+{row[0] - 60}) |" in report
    assert "| `amount` | STATISTICAL_IMPUTE | Human Approved |" in report


def test_a_stored_plan_gives_the_same_result(spark, tmp_path):
    df = orders(spark)
    p = plan(df, seed=1234)
    again = load_plan(spark, p.save(str(tmp_path / "plan")))
    assert (again.run_id, again.seed) == (p.run_id, 1234)
    one, two = apply(df, p), apply(df, again)
    assert sorted(map(tuple, one.data.collect())) == sorted(map(tuple, two.data.collect()))
    assert any("verification" in e["message"].lower() for e in two.entries)


def test_seed_zero_is_a_seed(spark):
    df = orders(spark)
    assert plan(df, seed=0).seed == 0


def test_dry_run_only_plans(spark):
    df = spark.createDataFrame(
        [(i, [25, -10, 300][max(0, i - 27)], int(i >= 28)) for i in range(30)], "id int, age int, target int"
    )
    actions = {r["column"]: r["tool"] for r in dry_run(df).collect()}
    assert actions["target"] == "SYNTHESIS" and "age" in actions


def test_clean_table_needs_no_decision(spark):
    df = spark.range(30).selectExpr("id", "10 + id % 12 AS val")
    p = plan(df)
    assert p.state == "ready" and p.decisions.count() == 0
    result = apply(df, p)
    assert sorted(map(tuple, result.data.collect())) == sorted(map(tuple, df.collect()))
    assert p.advice.endswith("No critical remediation required.")


def test_partitioning_does_not_change_the_result(spark, sf):
    from catalog.views import dirty

    df = dirty(spark, sf)
    one = apply(df, plan(df)).data
    spread = df.repartition(5, "market")
    two = apply(spread, plan(spread)).data
    assert one.exceptAll(two).count() == 0 == two.exceptAll(one).count()


def test_column_local_decisions_keep_rows_and_domains(spark, sf):
    from catalog.views import dirty
    from tabmend import apply_decisions, infer

    df = dirty(spark, sf)
    spec = infer(df)
    out, _ = apply_decisions(
        df, {"age": "STATISTICAL_IMPUTE", "balance": "SYNTHETIC_SYNTHESIS", "country": "STATISTICAL_IMPUTE"}, spec
    )
    low, high = spec.bounds("age")
    row = out.agg(
        F.count(F.lit(1)),
        F.count_if(~F.col("age").between(low, high) | F.col("age").isNull()),
        F.count_if(F.col("balance").isNull() | F.col("country").isNull()),
    ).first()
    assert tuple(row) == (df.count(), 0, 0)


def test_dirty_sample(spark):
    df = dirty_customers(spark.range(2000), "id", seed=5)
    same = dirty_customers(spark.range(2000).repartition(3), "id", seed=5)
    assert df.exceptAll(same).count() == 0
    row = df.selectExpr(
        "avg(CAST(age < 0 AS INT))", "avg(CAST(age >= 150 AS INT))", "avg(CAST(age IS NULL AS INT))",
        "avg(churn)", "avg(CAST(city IS NULL AS INT))", "count(DISTINCT country)",
    ).first()
    assert row[2] == pytest.approx(0.12, abs=0.03) and row[3] == pytest.approx(0.08, abs=0.03)
    assert row[4] == pytest.approx(0.15, abs=0.03) and row[5] == 5
    assert 0 < row[0] < 0.1 and 0 < row[1] < 0.1


def test_entry_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())


def test_cells_replaced_are_counted_by_the_writing_job(spark, tmp_path):
    """Counts per column in the ledger, equal to SQL's, with a synthesis and a mode in between."""
    from tabmend.operators import clean

    towns = [" New York", "new york", "New York ", "NY", "Boston", None, ""]
    rows = [(f"K{i:04d}", towns[i % 7], int(i % 20 == 0), " pad" if i % 5 == 0 else "ok") for i in range(700)]
    df = spark.createDataFrame(rows, "k string, town string, hit int, note string").repartition(6)
    p = plan(df)
    decisions = {"town": "STATISTICAL_IMPUTE", "hit": "SYNTHETIC_SYNTHESIS"}
    out = export(df, p, str(tmp_path / "run"), decisions)
    aliases = p.spec.get("town").aliases
    told = {(e["message"].split()[0], e["column"]): int(e["message"].split()[1]) for e in out.entries if " cells of " in e["message"]}
    want = {("Stripped", "town"): 200, ("Stripped", "note"): 140}
    want[("Replaced", "town")] = sum((r[1] or "").strip() in aliases for r in rows)
    assert aliases and told == want
    plain, observation, asked = clean.observe_clean(df, p.spec)
    assert plain.columns == df.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, clean.clean(df, p.spec)[0].collect()))
    assert {(e["what"], e["column"]): e["cells"] for e in clean.changed_cells(observation, asked)} == {
        ("strip", "town"): 200, ("strip", "note"): 140, ("alias", "town"): want["Replaced", "town"]
    }
    empty, observation, asked = clean.observe_clean(df.limit(0), p.spec)
    assert empty.isEmpty() and clean.changed_cells(observation, asked) == []


def test_an_export_that_dies_leaves_the_one_before(spark, tmp_path, monkeypatch):
    from tabmend.plans import pipeline
    from tabmend.sources.publish import Folder

    df, path = orders(spark), str(tmp_path / "run")
    p = plan(df, run_id="20240101", source="a")
    export(df, p, path, {"amount": "STATISTICAL_IMPUTE"})
    parts = ("data", "decisions", "delta", "residual", "profile", "report")

    def state():
        return {n: sorted(map(str, pipeline.read_part(spark, path, n, format="text" if n == "report" else "parquet").collect())) for n in parts}

    first = state()
    assert first == {n: sorted(map(str, (spark.read.text if n == "report" else spark.read.parquet)(f"{path}/{n}").collect())) for n in parts}
    # dies while it renders the report, after most parts are written
    with monkeypatch.context() as m:
        m.setattr(pipeline, "render_report", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            export(df, p, path, {"amount": "DROP"})
    assert state() == first
    # dies between two moves, after the marker: readers get the new export whole
    folder, moves = Folder(spark, path), []
    real = folder._fs

    class Broken:
        def __getattr__(self, name):
            return getattr(real, name)

        def rename(self, a, b):
            moves.append(str(a))
            return len(moves) < 3 and real.rename(a, b)

    with monkeypatch.context() as m:
        m.setattr(pipeline, "Folder", lambda s, d: folder if d == path else Folder(s, d))
        folder._fs = Broken()
        with pytest.raises(OSError, match="publish"):
            export(df, p, path, {"amount": "DROP"})
        folder._fs = real
    second = state()
    assert len(moves) == 3 and all(second[n] != first[n] for n in ("data", "decisions", "delta", "report"))
    assert "amount" not in pipeline.read_part(spark, path, "data").columns
    # the next export finishes those moves first; nothing is left over
    third = export(df, p, path, {"amount": "STATISTICAL_IMPUTE"})
    assert {n: v for n, v in state().items() if n != "report"} == {n: v for n, v in first.items() if n != "report"}
    assert sorted(map(str, third.data.collect())) == first["data"]
    assert not [f for f in (tmp_path / "run").iterdir() if f.name.startswith("_publishing")]


def test_a_run_recorded_twice_counts_once(spark, tmp_path):
    df, path = orders(spark), str(tmp_path / "run")
    one, two = plan(df, run_id="0001", source="a"), plan(df, run_id="1e5", source="b")
    ledgers.append(one.ledger(), f"{path}/ledger")
    assert ledgers.status(spark.read.parquet(f"{path}/ledger"), "0001").first()["is_waiting"]
    long = export(df, one, path, {"amount": "STATISTICAL_IMPUTE", "status": "SYNTHETIC_SYNTHESIS"})
    short = export(df, one, path, {"amount": "DROP"})
    assert len(short.entries) < len(long.entries)
    export(df, two, path, {})
    ledgers.append(two.ledger(), f"{path}/ledger")
    got = {r["run_id"]: r for r in ledgers.status(spark.read.parquet(f"{path}/ledger")).collect()}
    assert set(got) == {"0001", "1e5"}
    assert (got["0001"]["entries"], got["0001"]["is_completed"]) == (len(short.entries), True)
    assert (got["1e5"]["entries"], got["1e5"]["is_waiting"]) == (len(two.entries), True)
    twice = one.ledger().unionByName(one.ledger())
    assert ledgers.status(twice).first()["entries"] == len(one.entries)
