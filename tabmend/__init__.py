"""Profile, govern and repair tables at scale, as Spark jobs.

    spec = infer(df)                 # roles, types, domains, aliases, target
    find_issues(df, spec)            # governance issues, one row each
    plan(df) -> apply(df, plan)      # recommend, decide, remediate, verify
"""

from tabmend.operators.advise import decisions_table, merge_decisions, recommend
from tabmend.operators.clean import clean, replace_aliases, strip_strings
from tabmend.operators.infer import infer
from tabmend.operators.issues import find_issues, profile
from tabmend.operators.remediate import apply_decisions
from tabmend.operators.synthesize import synthesize_minority
from tabmend.plans.pipeline import apply, dry_run, export, load_plan, plan
from tabmend.session import build_session
from tabmend.spec import ColumnSpec, TableSpec

__all__ = [
    "ColumnSpec",
    "TableSpec",
    "apply",
    "apply_decisions",
    "build_session",
    "clean",
    "decisions_table",
    "dry_run",
    "export",
    "find_issues",
    "infer",
    "load_plan",
    "merge_decisions",
    "plan",
    "profile",
    "recommend",
    "replace_aliases",
    "strip_strings",
    "synthesize_minority",
]
