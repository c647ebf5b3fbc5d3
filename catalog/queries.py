"""One registered query per operator: (spark, sf_dir) -> DataFrame.

All read whole tables.  Floats are rounded where two engines may differ in the
last digits; lists are joined to text so that both sides compare as values.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.views import dirty, dirty_kinds, table
from tabmend.functions.kinds import measure
from tabmend.functions.masks import anomalous
from tabmend.operators import advise, aliases, clean, colstats, infer, issues, manifest
from tabmend.operators import remediate, summary, synthesize, values, verify
from tabmend.plans import pipeline
from tabmend.session import shared_folder
from tabmend.sources import csv as csvs
from tabmend.sources import ledger as ledgers
from tabmend.sources.dirty import dirty_customers
from tabmend.sources.report import decision_rows
from tabmend.spec import ColumnSpec, TableSpec

OVERRIDE = """```json
{"id_columns": ["customer_id"], "target_column": "churn", "ignore_columns": ["name"],
 "columns": {
  "customer_id": {"role": "id", "semantic_type": "text"},
  "name": {"role": "ignore", "semantic_type": "text"},
  "age": {"role": "feature", "semantic_type": "numerical", "valid_bounds": [0, 120]},
  "balance": {"valid_bounds": [-999.5, 9999.5]},
  "country": {"semantic_type": "categorical",
              "canonical_aliases": {"United States": ["US", "USA", "U.S."]}},
  "churn": {"role": "target", "semantic_type": "binary", "minority_class_value": 1},
  "no_such_column": {"role": "feature"}
 }}
```"""

ADVICE = (
    "[Advisor]\n\n• 'age' (Invalid Bounds):\n  ➜ Recommended Decision: DROP\n"
    "  ➜ Decision Impact: removes the feature.\n\n"
    "• 'balance':\n  ➜ Recommended Decision: SOMETHING_ELSE\n\n"
    "• 'churn':\n  ➜ Recommended Decision: statistical_impute\n"
)


REPAIRS = {"age": "STATISTICAL_IMPUTE", "balance": "MANUAL_INPUT:4000", "sparse": "DROP"}


@lru_cache(maxsize=64)
def _spec(spark: SparkSession, sf_dir: str, name: str = "dirty") -> TableSpec:
    """Inferred once per session, folder and table; the queries that use a schema
    share it."""
    return infer.infer_rules(_source(spark, sf_dir, name))


def _source(spark, sf_dir, name) -> DataFrame:
    return dirty(spark, sf_dir) if name == "dirty" else table(spark, sf_dir, name)


def _profile(spark, d, name: str = "dirty") -> DataFrame:
    return issues.profile(_source(spark, d, name), _spec(spark, d, name))


def _issues(spark, d, name: str = "dirty") -> DataFrame:
    return issues.issues_of(_profile(spark, d, name))


def _recommended(spark, d) -> DataFrame:
    profile = _profile(spark, d)
    return advise.recommend(issues.issues_of(profile), profile)


def _remediated(spark, d, decisions: dict[str, str], **kwargs) -> DataFrame:
    df, _ = remediate.apply_decisions(dirty(spark, d), decisions, _spec(spark, d), **kwargs)
    return df


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns if c in df.columns})


def _timed(status: DataFrame) -> DataFrame:
    """Times differ between runs; compare that they are there and in order."""
    return status.selectExpr(
        "run_id", "source", "target", "is_completed", "is_waiting", "seed", "entries",
        "start_time IS NOT NULL AND coalesce(end_time >= start_time, true) AS timed",
        "duration_sec >= 0 AS has_duration",
    )


# --- sources and sinks -------------------------------------------------------


def src_csv(spark, d):
    path = csvs.write_csv(dirty(spark, d), shared_folder(spark))
    return csvs.read_csv(spark, path)


def src_validate(spark, d):
    """Lines of customers, some with a field too many or too few."""
    line = F.concat_ws(
        ",",
        F.col("c_custkey").cast("string"),
        F.col("c_name"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("extra")),
    )
    # (11, 7) customers lose one field and gain one, and so pass
    path = shared_folder(spark)
    lines = table(spark, d, "customer").select(line.alias("key,name,segment"))
    lines.write.mode("overwrite").options(header=True, sep="\t").csv(path)
    return csvs.rejected_rows(spark, path)


def src_sample_rows(spark, d):
    return csvs.sample_rows(dirty(spark, d), ["customer_id"])


def src_sample_values(spark, d):
    df = dirty(spark, d)
    return csvs.sample_values(df, ["customer_id"], df.columns)


def src_dirty_gen(spark, d):
    return dirty_customers(table(spark, d, "customer"), "c_custkey")


def snk_csv(spark, d):
    df = clean.strip_strings(dirty(spark, d))
    path = csvs.write_csv(df, shared_folder(spark))
    return csvs.read_csv(spark, path, df.schema)


def snk_audit(spark, d):
    df = dirty(spark, d)
    path = shared_folder(spark)
    pipeline.export(df, pipeline.plan(df, source="dirty"), path)
    return decision_rows(spark.read.parquet(f"{path}/decisions")).drop("ord")


def _published(spark, d, part: str, decisions: dict[str, str] | None = None) -> DataFrame:
    """One part of an export, found as its readers find it."""
    df, path = dirty(spark, d), shared_folder(spark)
    pipeline.export(df, pipeline.plan(df, source="dirty"), path, decisions, same_input=True)
    return pipeline.read_part(spark, path, part)


def snk_audit_data(spark, d):
    return _rounded(_published(spark, d, "data"), "balance", digits=2)


def snk_audit_delta(spark, d):
    return _published(spark, d, "delta", REPAIRS)


def snk_audit_residual(spark, d):
    return _rounded(_published(spark, d, "residual", REPAIRS), "ratio", digits=9)


def ledger_status(spark, d):
    plan = pipeline.plan(dirty(spark, d), run_id="run-1", source="dirty")
    path = shared_folder(spark)
    ledgers.append(plan.ledger(), path)
    return _timed(ledgers.status(spark.read.parquet(path), "run-1"))


# --- profiling ---------------------------------------------------------------


def prof_rowcount(spark, d):
    return colstats.row_count(table(spark, d, "lineitem"))


def prof_type(spark, d):
    stats = colstats.column_stats(dirty(spark, d), moments=False, distinct=False)
    return stats.select("ord", "column", "dtype", "kind")


def prof_nulls(spark, d):
    return colstats.null_counts(dirty(spark, d))


def prof_nunique(spark, d):
    return values.unique_counts(dirty(spark, d)).select("ord", "column", "n_unique")


def prof_uniqueness(spark, d):
    return _rounded(values.unique_counts(dirty(spark, d)), "uniqueness", digits=6)


def prof_moments(spark, d):
    return _rounded(summary.moments(dirty(spark, d)), "mean", "median", "std")


def prof_moments_lineitem(spark, d):
    return _rounded(summary.moments(table(spark, d, "lineitem")), "mean", "median", "std")


def prof_value_counts(spark, d):
    return values.value_counts(dirty(spark, d)).drop("num")


def prof_unique_values(spark, d):
    return values.unique_values(dirty(spark, d))


def prof_high_null(spark, d):
    return issues.null_issues(dirty(spark, d), _spec(spark, d)).select("column", "ratio", "message")


def prof_bounds(spark, d):
    return issues.bounds_issues(dirty(spark, d), _spec(spark, d)).select(
        "column", "count", "ratio", "low", "high", "message"
    )


def prof_zscore(spark, d):
    return issues.outlier_issues(dirty(spark, d), _spec(spark, d)).select(
        "column", "count", "ratio", "message"
    )


def prof_binary_detect(spark, d):
    both = _profile(spark, d).unionByName(
        issues.profile(table(spark, d, "labels")).withColumn("ord", F.col("ord") + 100)
    )
    return both.where("checked AND kind = 'integer'").select("ord", "column", "binary")


def prof_imbalance_binary(spark, d):
    found = issues.imbalance_issues(table(spark, d, "labels"))
    return found.select("column", "ratio", "minority_value", "message")


def prof_imbalance_target(spark, d):
    spec = TableSpec(target="c_mktsegment")
    found = issues.imbalance_issues(table(spark, d, "customer"), spec)
    return found.select("column", "ratio", "minority_value", "message")


def prof_role_skip(spark, d):
    return _profile(spark, d).select("column", "role", "checked", "nulls")


def prof_labels(spark, d):
    return issues.labels_of(_profile(spark, d))


def prof_issues(spark, d):
    return _issues(spark, d)


def _issues_of(name: str):
    def query(spark, d):
        return _issues(spark, d, name)

    return query


def prof_issues_domains(spark, d):
    """Line items against stated domains, a rare class and an id."""
    domains = {"l_quantity": (5.0, 45.0), "l_discount": (0.0, 0.05), "l_tax": (0.01, 0.08)}
    columns = {c: ColumnSpec(semantic_type="numerical", bounds=b) for c, b in domains.items()}
    columns["l_orderkey"] = ColumnSpec("id", "numerical", bounds=(0.0, 10.0))
    spec = TableSpec(columns, target="l_linenumber")
    return issues.find_issues(table(spark, d, "lineitem"), spec)


def prof_summary_table(spark, d):
    out = summary.summary(dirty(spark, d), ["customer_id"])
    return _rounded(out.drop("dtype"), "mean", "median", "std")


# --- inference ---------------------------------------------------------------


def _classified(spark, d, name="dirty"):
    return infer.classify(infer.colstats_table(_source(spark, d, name)))


def _of_rule(rule: str, *names: str):
    def query(spark, d):
        parts = [
            _classified(spark, d, n)
            .where(F.col("rule") == rule)
            .select(F.lit(n).alias("table"), "column", "role", "semantic_type", "description")
            for n in names
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    return query


def inf_minority(spark, d):
    """Least and most frequent values."""
    ends = values.extremes(dirty(spark, d))
    return ends.select("column", "minority_value", "minority_n", "mode_value", "mode_n")


def inf_bounds(spark, d):
    spec = _spec(spark, d)
    return spec.to_df(spark).where("low IS NOT NULL").select("column", "low", "high")


def _values(spark, d, *columns):
    df = clean.strip_strings(dirty(spark, d))
    return values.value_counts(df, list(columns))


def inf_alias_key(spark, d):
    return aliases.key_aliases(_values(spark, d, "country", "market", "segment"))


def inf_alias_acronym(spark, d):
    return aliases.acronym_aliases(_values(spark, d, "country", "market", "segment"))


def inf_alias_sample(spark, d):
    df = table(spark, d, "lineitem").selectExpr("CAST(l_partkey AS STRING) AS part")
    return aliases.alias_sample(values.value_counts(df)).select("column", "value", "n")


def inf_target(spark, d):
    labels = infer.select_target(_classified(spark, d, "labels"))
    return infer.select_target(_classified(spark, d)).unionByName(labels)


def inf_override(spark, d):
    df = dirty(spark, d)
    return issues.find_issues(df, infer.infer(df, override=OVERRIDE))


def inf_schema(spark, d):
    return _spec(spark, d).to_df(spark)


def _schema_of(name: str):
    def query(spark, d):
        return _spec(spark, d, name).to_df(spark)

    return query


# --- cleaning ----------------------------------------------------------------

def cln_strip(spark, d):
    return clean.strip_strings(dirty(spark, d))


def cln_alias(spark, d):
    spec = TableSpec(
        {
            "country": ColumnSpec(
                semantic_type="categorical",
                aliases={"US": "United States", "USA": "US", "united states ": "United States"},
            )
        }
    )
    return clean.replace_aliases(dirty(spark, d), spec).select("customer_id", "country")


def cln_pipeline(spark, d):
    df = clean.strip_strings(dirty(spark, d))
    return clean.clean(df, infer.infer_rules(df))[0]


# --- recommendation ----------------------------------------------------------


def adv_group(spark, d):
    return advise.group_issues(_issues(spark, d)).select("column", "ord", "types", "n_issues", "null_ratio")


def adv_describe(spark, d):
    return advise.describe(advise.group_issues(_issues(spark, d))).select("column", "description")


def adv_strategy(spark, d):
    return _recommended(spark, d).select("column", "strategy")


def adv_impact(spark, d):
    return _recommended(spark, d).select("column", "impact", "advice")


def adv_parse(spark, d):
    return advise.parse_advice(_recommended(spark, d).select("column"), ADVICE)


def adv_merge(spark, d):
    mine = advise.decisions_table(spark, {"age": "MANUAL_INPUT:40", "country": "STATISTICAL_IMPUTE"})
    return advise.merge_decisions(_recommended(spark, d), mine)


def man_actions(spark, d):
    profile = _profile(spark, d)
    decided = advise.recommend(issues.issues_of(profile), profile).selectExpr(
        "ord", "column", "CASE WHEN column = 'age' THEN 'MANUAL_INPUT:40' ELSE strategy END AS strategy"
    )
    return manifest.planned_actions(decided, profile).drop("ord")


def man_files(spark, d):
    plan = pipeline.plan(dirty(spark, d), source="dirty", run_id="run-1")
    return plan.files("/clean/dirty")


def man_forecast(spark, d):
    needed = manifest.rows_needed("rows", "minority_n")
    return _profile(spark, d).where("is_target").selectExpr("column", f"{needed} AS needed")


def man_dryrun(spark, d):
    return pipeline.dry_run(dirty(spark, d)).drop("ord")


# --- remediation -------------------------------------------------------------


def rem_dispatch(spark, d):
    return _remediated(
        spark,
        d,
        {
            "missing": "DROP",
            "age": " statistical_impute ",
            "balance": "manual_input: 12.5 ",
            "sparse": "drop_column",
            "country": "MANUAL_INPUT:DefaultCat",
            "market": "NO_SUCH_STRATEGY",
        },
    ).select("customer_id", "age", "balance", "country", "market")


def rem_drop(spark, d):
    return _remediated(spark, d, {"sparse": "DROP", "name": "DROP_COLUMN"})


def rem_impute_median(spark, d):
    out = _remediated(spark, d, {"age": "STATISTICAL_IMPUTE", "balance": "STATISTICAL_IMPUTE"})
    return out.select("customer_id", "age", "balance")


def rem_impute_mode(spark, d):
    out = _remediated(
        spark, d, {"country": "STATISTICAL_IMPUTE", "nation_code": "STATISTICAL_IMPUTE"}
    )
    return out.select("customer_id", "country", "nation_code")


def rem_impute_unsupported(spark, d):
    df = table(spark, d, "events")
    out, _ = remediate.apply_decisions(df, {"ts": "STATISTICAL_IMPUTE"})
    return out.selectExpr("event_id", "CAST(ts AS STRING) IS NULL AS ts_missing", "user_id")


def rem_manual(spark, d):
    out = _remediated(
        spark,
        d,
        {
            "age": "MANUAL_INPUT:75.9",
            "balance": "MANUAL_INPUT:0.25",
            "country": "MANUAL_INPUT:Unknown",
            "nation_code": "MANUAL_INPUT:abc",
            "churn": "MANUAL_INPUT:",
        },
    )
    return out.select("customer_id", "age", "balance", "country", "nation_code", "churn")


def rem_anomaly_mask(spark, d):
    df, spec, kinds = dirty(spark, d), _spec(spark, d), dirty_kinds()
    stats = colstats.collect_stats(df, ["age", "balance", "sparse"], distinct=False)
    masks = [
        anomalous(measure(c, kinds[c]), spec.bounds(c), s["mean"], s["std"]) + f" AS {c}_anomalous"
        for c, s in stats.items()
    ]
    return df.selectExpr("customer_id", *masks)


def rem_gauss_replace(spark, d):
    decisions = {"age": "SYNTHETIC_SYNTHESIS", "balance": "SYNTHETIC_SYNTHESIS"}
    return _remediated(spark, d, decisions).select("customer_id", "age", "balance")


def rem_gauss_outliers(spark, d):
    df = table(spark, d, "events")
    spec = TableSpec({"value": ColumnSpec(bounds=(0.0, 400.0))})
    out, _ = remediate.apply_decisions(
        df, {"value": "SYNTHETIC_SYNTHESIS"}, spec, key=["event_id"], include_outliers=True
    )
    return out.select("event_id", "value")


def rem_gauss_keyless(spark, d):
    """Without an identifying column: rows are keyed by digest, copies of a row numbered."""
    df = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity")
    spec = TableSpec({"l_quantity": ColumnSpec(bounds=(5.0, 45.0))})
    return remediate.apply_decisions(df, {"l_quantity": "SYNTHETIC_SYNTHESIS"}, spec)[0]


def rem_synth_skip(spark, d):
    out = _remediated(spark, d, {"country": "SYNTHETIC_SYNTHESIS"})
    return out.select("customer_id", "country")


def rem_chain(spark, d):
    out = _remediated(
        spark,
        d,
        {
            "age": "STATISTICAL_IMPUTE",
            "sparse": "DROP",
            "churn": "SYNTHETIC_SYNTHESIS",
            "balance": "STATISTICAL_IMPUTE",
        },
    )
    return _rounded(out, "balance", digits=2).select("customer_id", "age", "balance", "nation_code", "churn")


# --- synthesis ---------------------------------------------------------------


def _synthetic(spark, d, *columns, seed=42):
    df, spec = dirty(spark, d), _spec(spark, d)
    balance = synthesize.balance_of(df, "churn", spec)
    rows = synthesize.synthetic_rows(df, "churn", balance, spec, seed)
    return _rounded(rows.select(*(columns or df.columns)), "balance", "sparse", digits=2)


def syn_needed(spark, d):
    return synthesize.balance_table(dirty(spark, d), "churn", _spec(spark, d))


def syn_rows(spark, d):
    return _synthetic(spark, d)


def syn_id(spark, d):
    """String ids of the dirty view and integer ids of the labels."""
    df = table(spark, d, "labels")
    spec = TableSpec(
        {"doc_id": ColumnSpec("id", "numerical"), "toxic": ColumnSpec("target", "binary")}, "toxic"
    )
    balance = synthesize.balance_of(df, "toxic", spec)
    rows = synthesize.synthetic_rows(df, "toxic", balance, spec).selectExpr(
        "CAST(doc_id AS STRING) AS id"
    )
    return _synthetic(spark, d, "customer_id").selectExpr("customer_id AS id").unionByName(rows)


def syn_numeric(spark, d):
    return _synthetic(spark, d, "customer_id", "age", "balance", "sparse", "nation_code")


def syn_categorical(spark, d):
    return _synthetic(spark, d, "customer_id", "country", "market", "segment")


def syn_weighted(spark, d):
    """A binary feature next to the target keeps its class shares."""
    df = dirty(spark, d).withColumn("vip", F.col("nation_code") < 5)
    spec = TableSpec(
        {
            "customer_id": ColumnSpec("id", "text"),
            "vip": ColumnSpec(semantic_type="binary"),
            "churn": ColumnSpec("target", "binary"),
        },
        "churn",
    )
    df = df.select("customer_id", "vip", "churn")
    balance = synthesize.balance_of(df, "churn", spec)
    return synthesize.synthetic_rows(df, "churn", balance, spec).selectExpr(
        "customer_id", "CAST(vip AS STRING) AS vip", "churn"
    )


def syn_pii(spark, d):
    df = dirty(spark, d).selectExpr(
        "customer_id", "name", "name AS email", "name AS home_address", "name AS phone", "churn"
    )
    columns = {c: ColumnSpec("ignore", "text") for c in ("name", "email", "home_address", "phone")}
    spec = TableSpec({"customer_id": ColumnSpec("id", "text"), **columns}, "churn")
    balance = synthesize.balance_of(df, "churn", spec)
    return synthesize.synthetic_rows(df, "churn", balance, spec)


def syn_null(spark, d):
    df = dirty(spark, d).selectExpr("customer_id", "CAST(NULL AS STRING) AS nothing", "churn")
    spec = TableSpec({"customer_id": ColumnSpec("id", "text")}, "churn")
    balance = synthesize.balance_of(df, "churn", spec)
    return synthesize.synthetic_rows(df, "churn", balance, spec)


def _balanced(spark, d, **kwargs):
    return synthesize.synthesize_minority(dirty(spark, d), "churn", spec=_spec(spark, d), **kwargs)[0]


def syn_cast_union(spark, d):
    return _rounded(_balanced(spark, d), "balance", "sparse", digits=2)


def syn_balance(spark, d):
    return _balanced(spark, d).selectExpr(
        "count(1) AS total",
        "count_if(churn = 1) AS minority",
        "round(count_if(churn = 1) / count(1), 6) AS ratio",
    )


def syn_seed(spark, d):
    return _synthetic(spark, d, "customer_id", "age", "balance", seed=999)


# --- verification and pipeline -------------------------------------------------


def ver_reprofile(spark, d):
    out = _remediated(spark, d, REPAIRS)
    left = verify.reprofile(out, _spec(spark, d))
    return _rounded(left, "ratio", digits=9)


def ver_delta(spark, d):
    spec = _spec(spark, d)
    out = _remediated(spark, d, REPAIRS)
    before = _profile(spark, d)
    after = verify.reprofile_touched(out, spec, before, set(REPAIRS))
    return verify.compare_profiles(before, after)


def ver_telemetry(spark, d):
    plan = pipeline.plan(dirty(spark, d), source="dirty", seed=7)
    applied = pipeline.apply(dirty(spark, d), plan)
    log = ledgers.ledger_table(
        spark, plan.run_id, applied.entries, "completed", plan.source, "nowhere", plan.seed
    )
    return _timed(ledgers.status(log)).drop("run_id")


def pipe_plan(spark, d):
    plan = pipeline.plan(dirty(spark, d))
    return plan.recommended.select("column", "types", "description", "strategy", "impact")


def pipe_apply(spark, d):
    df = dirty(spark, d)
    out = pipeline.apply(df, pipeline.plan(df)).data
    return _rounded(out, "balance", digits=2)


QUERIES = {
    "src_csv": src_csv,
    "src_validate": src_validate,
    "src_sample_rows": src_sample_rows,
    "src_sample_values": src_sample_values,
    "src_dirty_gen": src_dirty_gen,
    "snk_csv": snk_csv,
    "snk_audit": snk_audit,
    "snk_audit_data": snk_audit_data,
    "snk_audit_delta": snk_audit_delta,
    "snk_audit_residual": snk_audit_residual,
    "ledger_status": ledger_status,
    "prof_rowcount": prof_rowcount,
    "prof_type": prof_type,
    "prof_nulls": prof_nulls,
    "prof_nunique": prof_nunique,
    "prof_uniqueness": prof_uniqueness,
    "prof_moments": prof_moments,
    "prof_moments_lineitem": prof_moments_lineitem,
    "prof_value_counts": prof_value_counts,
    "prof_unique_values": prof_unique_values,
    "prof_high_null": prof_high_null,
    "prof_bounds": prof_bounds,
    "prof_zscore": prof_zscore,
    "prof_binary_detect": prof_binary_detect,
    "prof_imbalance_binary": prof_imbalance_binary,
    "prof_imbalance_target": prof_imbalance_target,
    "prof_role_skip": prof_role_skip,
    "prof_labels": prof_labels,
    "prof_issues": prof_issues,
    "prof_issues_lineitem": _issues_of("lineitem"),
    "prof_issues_domains": prof_issues_domains,
    "prof_issues_events": _issues_of("events"),
    "prof_issues_documents": _issues_of("documents"),
    "prof_issues_labels": _issues_of("labels"),
    "prof_summary_table": prof_summary_table,
    "inf_id": _of_rule("id", "dirty", "labels", "events"),
    "inf_ignore_text": _of_rule("ignore_text", "dirty", "documents", "part"),
    "inf_binary": _of_rule("binary", "dirty", "labels", "lineitem"),
    "inf_minority": inf_minority,
    "inf_nominal": _of_rule("nominal", "customer", "part", "orders"),
    "inf_discrete": _of_rule("discrete", "dirty", "lineitem", "conversations"),
    "inf_bounds": inf_bounds,
    "inf_alias_key": inf_alias_key,
    "inf_alias_acronym": inf_alias_acronym,
    "inf_alias_sample": inf_alias_sample,
    "inf_default": _of_rule("default", "events", "orders", "embeddings"),
    "inf_target": inf_target,
    "inf_override": inf_override,
    "inf_schema": inf_schema,
    "inf_schema_lineitem": _schema_of("lineitem"),
    "inf_schema_orders": _schema_of("orders"),
    "inf_schema_part": _schema_of("part"),
    "inf_schema_documents": _schema_of("documents"),
    "cln_strip": cln_strip,
    "cln_alias": cln_alias,
    "cln_pipeline": cln_pipeline,
    "adv_group": adv_group,
    "adv_describe": adv_describe,
    "adv_strategy": adv_strategy,
    "adv_impact": adv_impact,
    "adv_parse": adv_parse,
    "adv_merge": adv_merge,
    "man_actions": man_actions,
    "man_files": man_files,
    "man_forecast": man_forecast,
    "man_dryrun": man_dryrun,
    "rem_dispatch": rem_dispatch,
    "rem_drop": rem_drop,
    "rem_impute_median": rem_impute_median,
    "rem_impute_mode": rem_impute_mode,
    "rem_impute_unsupported": rem_impute_unsupported,
    "rem_manual": rem_manual,
    "rem_anomaly_mask": rem_anomaly_mask,
    "rem_gauss_replace": rem_gauss_replace,
    "rem_gauss_outliers": rem_gauss_outliers,
    "rem_gauss_keyless": rem_gauss_keyless,
    "rem_synth_skip": rem_synth_skip,
    "rem_chain": rem_chain,
    "syn_needed": syn_needed,
    "syn_rows": syn_rows,
    "syn_id": syn_id,
    "syn_numeric": syn_numeric,
    "syn_categorical": syn_categorical,
    "syn_weighted": syn_weighted,
    "syn_pii": syn_pii,
    "syn_null": syn_null,
    "syn_cast_union": syn_cast_union,
    "syn_balance": syn_balance,
    "syn_seed": syn_seed,
    "ver_reprofile": ver_reprofile,
    "ver_delta": ver_delta,
    "ver_telemetry": ver_telemetry,
    "pipe_plan": pipe_plan,
    "pipe_apply": pipe_apply,
}
