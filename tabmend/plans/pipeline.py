"""Plan and apply: two jobs with a person in between.

``plan`` reads the data and returns small tables; nothing is written.  A person
edits the decisions.  ``apply`` reads the data again, with the saved plan, and
writes the result.  Both can be stored and reloaded, so the pause can last.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabmend.functions import fixed
from tabmend.operators import advise, clean, infer, issues, manifest, remediate, verify
from tabmend.operators.advise import as_decisions, decisions_table
from tabmend.operators.colstats import collect_stats
from tabmend.session import local_table
from tabmend.sources import ledger as ledgers
from tabmend.sources.csv import read_csv, write_csv
from tabmend.sources.publish import Folder
from tabmend.sources.report import render_report, write_report
from tabmend.spec import TableSpec

_ENTRY_SCHEMA = pa.schema(
    [("step", pa.string()), ("column", pa.string()), ("message", pa.string())]
)


@dataclass
class Plan:
    """What would be done to a table, and why."""

    spark: SparkSession
    run_id: str
    spec: TableSpec
    profile: DataFrame
    issues: DataFrame
    recommended: DataFrame
    entries: list[dict] = field(default_factory=list)
    seed: int = fixed.DEFAULT_SEED
    source: str | None = None

    @property
    def decisions(self) -> DataFrame:
        """The recommended decisions, as a table to edit."""
        return self.recommended.select("ord", "column", "strategy")

    @property
    def manifest(self) -> DataFrame:
        return manifest.manifest(self.decisions, self.profile, self._entry_table())

    def files(self, target: str) -> DataFrame:
        """man_actions, its file part: what an export to ``target`` reads, creates and writes."""
        return manifest.planned_files(self.profile, self.source, target, self.run_id)

    @property
    def advice(self) -> str:
        return advise.advice_text(self.recommended)

    @property
    def state(self) -> str:
        """``waiting`` for a person while there are issues to decide."""
        return "ready" if self.issues.isEmpty() else "waiting"

    def ledger(self) -> DataFrame:
        return ledgers.ledger_table(
            self.spark, self.run_id, self.entries, self.state, self.source, seed=self.seed
        )

    def _entry_table(self) -> DataFrame:
        rows = [{k: e.get(k) for k in _ENTRY_SCHEMA.names} for e in self.entries]
        return local_table(self.spark, rows, _ENTRY_SCHEMA)

    def save(self, path: str) -> str:
        """Store the plan below ``path``; ``load_plan`` reads it back."""
        tables = {
            "spec": self.spec.to_df(self.spark),
            "aliases": self.spec.alias_df(self.spark),
            "profile": self.profile,
            "issues": self.issues,
            "recommended": self.recommended,
            "decisions": self.decisions,
            "ledger": self.ledger(),
        }
        for name, table in tables.items():
            table.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        return path


def load_plan(spark: SparkSession, path: str) -> Plan:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    log = sorted(read("ledger").collect(), key=lambda r: r["seq"])
    return Plan(
        spark,
        log[0]["run_id"],
        TableSpec.from_df(read("spec"), read("aliases")),
        read("profile"),
        read("issues"),
        read("recommended"),
        [{k: r[k] for k in ("at", "step", "column", "message")} for r in log],
        log[0]["seed"],
        log[0]["source"],
    )


def plan(
    df: DataFrame,
    override: str | dict | None = None,
    advice: str = "",
    seed: int = fixed.DEFAULT_SEED,
    exact: bool = True,
    run_id: str | None = None,
    source: str | None = None,
) -> Plan:
    """pipe_plan: strip, infer, profile, recommend.  Aliases are found on stripped
    text, so a canonical never carries padding."""
    stripped = clean.strip_strings(df)
    stats = collect_stats(stripped, distinct=not (exact or override))
    if override:
        spec = infer.override_spec(stripped, override)
    else:
        spec = infer.infer_rules(stripped, exact, stats)
    profile = issues.profile(stripped, spec, stats)
    entries = [_entry("infer", None, _inferred(spec))]
    found = issues.issues_of(profile)
    count = found.count()
    entries.append(
        _entry("profile", None, fixed.LOG_PROFILED.format(n=count))
    )
    entries += [_entry(**e) for e in clean.clean_messages(df, spec)]
    recommended = advise.advised_strategies(advise.recommend(found, profile), advice)
    small = recommended.toArrow()
    return Plan(
        df.sparkSession,
        run_id or uuid.uuid4().hex,
        spec,
        profile,
        found,
        df.sparkSession.createDataFrame(small),
        entries,
        seed,
        source,
    )


def _entry(step: str, column: str | None, message: str) -> dict:
    return {"at": ledgers.now(), "step": step, "column": column, "message": message}


def _inferred(spec: TableSpec) -> str:
    return fixed.LOG_INFERRED.format(
        method=spec.method,
        target=spec.target,
        ids=spec.id_columns,
        ignored=spec.ignore_columns,
        n=len(spec.columns),
    )


@dataclass
class Applied:
    """The remediated frame with its verification and log."""

    data: DataFrame
    residual: DataFrame
    profile: DataFrame
    decisions: dict[str, str]
    entries: list[dict]
    path: str | None = None


def apply(
    df: DataFrame,
    plan: Plan,
    decisions: DataFrame | dict[str, str] | None = None,
    include_outliers: bool = True,
    path: str | None = None,
    format: str = "parquet",
    weighted: bool = False,
    same_input: bool = False,
) -> Applied:
    """pipe_apply: clean, apply the decisions, profile again under the plan's schema.

    ``decisions`` defaults to the recommendations; a table or dict given here
    replaces them, and an empty one means nothing to remediate.  With ``path`` the
    result is written there once, and verified from what was written; without,
    it stays a lazy frame.  ``weighted`` draws the categories of new rows as often as they are
    seen.  ``same_input`` states that ``df`` still holds what was planned: then only columns that a decision
    or an alias touched are profiled again, the others keep the plan's profile."""
    if decisions is None:
        decisions = plan.decisions
    chosen = dict(decisions) if isinstance(decisions, dict) else as_decisions(decisions)
    cleaned = clean.replace_aliases(clean.strip_strings(df), plan.spec)
    counted = cleaned
    if path:  # the job that writes counts the cells that cleaning replaces
        counted, observation, asked = clean.observe_clean(df, plan.spec)
    result, log = remediate.apply_decisions(
        cleaned, chosen, plan.spec, plan.seed, include_outliers=include_outliers, onto=counted, weighted=weighted
    )
    entries = [*plan.entries]
    if path:
        result = _write(result, path, format)
        changed = clean.changed_cells(observation, asked)
        entries += [_entry(e["step"], e["column"], e["message"]) for e in changed]
    entries += [_entry(**e) for e in log]
    if same_input:
        aliased = {c for c in df.columns if (known := plan.spec.get(c)) and known.aliases}
        after = verify.reprofile_touched(result, plan.spec, plan.profile, aliased | set(chosen))
    else:
        after = issues.profile(result, plan.spec)
    residual = issues.issues_of(after)
    if chosen:
        entries.append(_entry("verify", None, verify.verification_message(residual.count())))
    return Applied(result, residual, after, chosen, entries, path)


def _write(df: DataFrame, path: str, format: str) -> DataFrame:
    """Write ``df`` and return the written table: what follows reads files, not
    the whole lineage again."""
    spark = df.sparkSession
    if format == "csv":
        return read_csv(spark, write_csv(df, path), df.schema)
    df.write.mode("overwrite").format(format).save(path)
    return spark.read.format(format).schema(df.schema).load(path)


def export(
    df: DataFrame,
    plan: Plan,
    path: str,
    decisions: DataFrame | dict[str, str] | None = None,
    format: str = "parquet",
    include_outliers: bool = True,
    weighted: bool = False,
    same_input: bool = False,
) -> Applied:
    """Apply a plan and write everything below ``path``: data/, decisions/, delta/,
    residual/, profile/, ledger/ and report/.

    All parts are staged and published together: an export that dies leaves the one before
    readable, whole.  ``read_part`` finds a part at any moment."""
    spark = plan.spark
    folder = Folder(spark, path)
    staged, final = folder.stage(), f"{folder.path}/data"
    applied = apply(df, plan, decisions, include_outliers, f"{staged}/data", format, weighted, same_input)
    done = _entry("export", None, fixed.LOG_EXPORTED.format(path=final))
    entries = [*applied.entries, done]
    chosen = decisions_table(spark, applied.decisions)
    profile = _part(applied.profile, f"{staged}/profile")
    residual = _part(applied.residual, f"{staged}/residual")
    _part(chosen, f"{staged}/decisions")
    _part(verify.compare_profiles(plan.profile, profile), f"{staged}/delta")
    log = ledgers.ledger_table(
        spark, plan.run_id, entries, "completed", plan.source, final, plan.seed
    )
    text = render_report(
        plan.source or "",
        final,
        _rows(plan.profile),
        _rows(profile),
        residual.count(),
        chosen,
        [e["message"] for e in entries],
        plan.advice,
        {
            "run_id": plan.run_id,
            "seed": plan.seed,
            "duration_sec": ledgers.status(log).first()["duration_sec"],
        },
    )
    write_report(spark, text, f"{staged}/report")
    schemas = {"data": applied.data.schema, "profile": profile.schema, "residual": residual.schema}
    folder.publish(staged)
    ledgers.append(log, f"{folder.path}/ledger")
    data, after, left = (
        read_part(spark, folder.path, name, schema, format if name == "data" else "parquet")
        for name, schema in schemas.items()
    )
    return Applied(data, left, after, applied.decisions, entries, final)


def _part(table: DataFrame, path: str) -> DataFrame:
    """A small table, written once; what follows reads the file."""
    table.coalesce(1).write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def read_part(spark: SparkSession, path: str, name: str, schema=None, format: str = "parquet") -> DataFrame:
    """A part of the last export published in ``path``."""
    at = Folder(spark, path).part(name)
    if format == "csv":
        return read_csv(spark, at, schema)
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema else reader).load(at)


def _rows(profile: DataFrame) -> int:
    return profile.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]


def dry_run(df: DataFrame, **kwargs) -> DataFrame:
    """man_dryrun: the manifest of a plan; nothing is written."""
    return plan(df, **kwargs).manifest
