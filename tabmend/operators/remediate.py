"""Apply decisions: drop, impute, override, Gaussian replacement, row synthesis.

Column-local decisions do not see each other, so a run of them shares the
statistics scans and becomes one projection.  Only minority synthesis is a
barrier, because later statistics must see the rows it appends.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tabmend.functions import draws, fixed
from tabmend.functions.kinds import is_numeric, kinds, measure, present, ref
from tabmend.functions.masks import anomalous
from tabmend.operators.quantiles import exact_quantiles
from tabmend.operators.rowkeys import ROW_KEY, with_row_key
from tabmend.operators.synthesize import minority_rows
from tabmend.operators.values import extremes
from tabmend.spec import TableSpec


_INTEGER_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


@dataclass
class _Step:
    """One decision on one existing column and what its statistics said."""

    column: str
    kind: str
    action: str  # drop, median, mode, manual, gauss or none
    bounds: tuple | None = None
    param: object = None
    stats: dict = field(default_factory=dict)
    message: str = ""
    classes: bool = False  # whether the values name classes, of which a rare one is no outlier
    semantic: str | None = None

    def value(self) -> str:
        return present(self.column, self.kind)

    def number(self) -> str:
        return measure(self.column, self.kind)

    def mask(self) -> str:
        """SQL: the cells this decision replaces."""
        if self.action == "mode" or not is_numeric(self.kind):
            return f"({self.value()} IS NULL)"
        mean, std = self.stats.get("mean"), self.stats.get("std")
        if self.action == "gauss" and not self.param or self.classes and self.stats.get("classes", True):
            mean = std = None  # missing and out-of-bounds cells only
        return anomalous(self.number(), self.bounds, mean, std)


def parse_strategy(strategy: str) -> tuple[str, str | None]:
    """Name in any case; a parameter after a colon keeps its case."""
    name, colon, param = strategy.partition(":")
    return name.strip().upper(), param.strip() if colon else None


def apply_decisions(
    df: DataFrame,
    decisions: dict[str, str],
    spec: TableSpec | None = None,
    seed: int = fixed.DEFAULT_SEED,
    key: list[str] | None = None,
    include_outliers: bool = False,
    onto: DataFrame | None = None,
    weighted: bool = False,
) -> tuple[DataFrame, list[dict]]:
    """rem_dispatch: the remediated frame and one ledger entry per decision.

    ``key`` names the columns that identify a row for reproducible draws; by
    default the id columns of the schema.  With ``include_outliers`` a Gaussian
    replacement also replaces z-outliers, not only missing and out-of-bounds
    cells.  ``onto`` is a frame of the same rows that the result is built on, while all
    statistics read ``df``: what only the final job should do can hang on it.  ``weighted`` draws
    the categories of new rows as often as they are seen."""
    spec = spec or TableSpec()
    onto = df if onto is None else onto
    entries: list[dict] = []
    run: dict[str, str] = {}
    for column, strategy in decisions.items():
        if column in df.columns and _is_synthesis(strategy) and spec.is_target(column):
            df, onto = _column_local(df, onto, run, spec, seed, key, include_outliers, entries)
            run = {}
            rows, message = minority_rows(df, column, spec=spec, seed=seed, weighted=weighted)
            if rows is not None:
                plain = df.unionByName(rows)
                df, onto = plain, plain if onto is df else onto.unionByName(rows)
            entries.append({"step": "remediate", "column": column, "message": message})
        else:
            run[column] = strategy
    return _column_local(df, onto, run, spec, seed, key, include_outliers, entries)[1], entries


def _is_synthesis(strategy: str) -> bool:
    return parse_strategy(strategy)[0] == fixed.SYNTHETIC_SYNTHESIS


def _column_local(df, onto, run, spec, seed, key, include_outliers, entries) -> tuple[DataFrame, DataFrame]:
    """The run's decisions on ``df`` and on ``onto``."""
    kind = kinds(df)
    steps: list[_Step] = []
    for column, strategy in run.items():
        if column in kind:
            steps.append(_plan(df, column, kind[column], strategy, spec, include_outliers))
        else:
            message = fixed.LOG_NO_COLUMN.format(column=column)
            steps.append(_Step(column, "", "none", message=message))
    _moments(df, steps)
    _counts(df, steps)
    _medians(df, steps)
    _modes(df, steps)
    key = key if key is not None else [c for c in spec.id_columns if c in df.columns]
    result = _project(onto, steps, key, seed)
    plain = result if onto is df else _project(df, steps, key, seed)
    entries += [{"step": "remediate", "column": s.column, "message": s.message} for s in steps]
    return plain, result


def _plan(df, column, kind, strategy, spec: TableSpec, include_outliers: bool) -> _Step:
    """What a decision means for its column; ``none`` with a message if nothing."""
    name, param = parse_strategy(strategy)
    bounds, numeric = spec.bounds(column), is_numeric(kind)

    def nothing(template: str, **facts) -> _Step:
        facts = {"column": column, "dtype": _type(df, column), "value": param, **facts}
        return _Step(column, kind, "none", message=template.format(**facts))

    if name.startswith(fixed.MANUAL_INPUT):
        if not param:
            return nothing(fixed.LOG_MANUAL_EMPTY)
        try:
            return _Step(column, kind, "manual", bounds, typed_value(df, column, kind, param))
        except (ValueError, OverflowError) as e:
            return nothing(fixed.LOG_MANUAL_CAST, error=e)
    if param is not None:
        return nothing(fixed.LOG_UNKNOWN, strategy=f"{name}:{param}")
    if name in (fixed.DROP, fixed.DROP_COLUMN):
        return _Step(column, kind, "drop")
    classes = spec.semantic(column) in ("binary", "categorical")
    if name == fixed.STATISTICAL_IMPUTE:
        if kind == "nested":  # a mode is taken over texts, which nested values are not
            return nothing(fixed.LOG_IMPUTE_TYPE)
        if kind == "string" or spec.semantic(column) == "categorical":
            return _Step(column, kind, "mode")
        if not numeric:
            return nothing(fixed.LOG_IMPUTE_TYPE)
        return _Step(column, kind, "median", bounds, classes=classes, semantic=spec.semantic(column))
    if name == fixed.SYNTHETIC_SYNTHESIS:
        if not numeric:
            return nothing(fixed.LOG_GAUSS_TYPE)
        low, high = bounds or (None, None)
        domain = (0.0 if low is None else low, high)
        return _Step(column, kind, "gauss", domain, include_outliers, classes=classes, semantic=spec.semantic(column))
    return nothing(fixed.LOG_UNKNOWN, strategy=name)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def typed_value(df: DataFrame, column: str, kind: str, text: str):
    """An operator's text as a value of the column; ValueError if it is none."""
    if kind == "integer":
        value, bits = int(float(text)), _INTEGER_BITS[df.schema[column].dataType.simpleString()]
        if not -(2 ** (bits - 1)) <= value < 2 ** (bits - 1):
            raise OverflowError("out of range")
        return value
    if kind == "float":
        return float(text)
    if kind == "boolean":
        return text.lower() in fixed.TRUE_WORDS
    if kind == "string":
        return text
    cast = F.lit(text).try_cast(df.schema[column].dataType)
    value = None if kind == "nested" else df.sparkSession.range(1).select(cast).first()[0]
    if value is None:
        raise ValueError("not a value of this type")
    return value


_COUNTED = ("median", "manual", "gauss")


def _moments(df: DataFrame, steps: list[_Step]) -> None:
    """First scan: the row count, and the moments behind z-scores."""
    asked = [s for s in steps if s.action in ("drop", *_COUNTED)]
    if not asked:
        return
    numeric = [s for s in asked if s.action in _COUNTED and is_numeric(s.kind)]
    aggregates = ["count(1) AS rows"]
    for i, s in enumerate(numeric):
        x = s.number()
        aggregates += [
            f"count({x}) AS filled{i}",
            f"avg({x}) AS mean{i}",
            f"stddev_pop({x}) AS std{i}",
            f"min({x}) = 0 AND max({x}) = 1 AS unit{i}",
        ]
    got = df.selectExpr(*aggregates).first()
    for s in asked:
        s.stats["rows"] = got["rows"]
    for i, s in enumerate(numeric):
        s.stats |= {"filled": got[f"filled{i}"]} | {k: draws.steady(got[f"{k}{i}"]) for k in ("mean", "std")}
        # any two values count as binary, but only 0 and 1 are sure to be classes
        s.stats["classes"] = s.semantic != "binary" or bool(got[f"unit{i}"])
        if got[f"unit{i}"] and s.semantic == "binary":
            s.stats["share"] = min(got[f"mean{i}"], 1 - got[f"mean{i}"])


def _counts(df: DataFrame, steps: list[_Step]) -> None:
    """Second scan: the cells to replace and, for Gaussian replacement, the
    moments of the cells that stay."""
    counted = [s for s in steps if s.action in _COUNTED]
    if not counted:
        return
    aggregates = []
    for i, s in enumerate(counted):
        aggregates.append(f"count_if({s.mask()}) AS hit{i}")
        if s.action == "gauss":
            valid = f"CASE WHEN NOT {s.mask()} THEN {s.number()} END"
            aggregates += [f"avg({valid}) AS avg{i}", f"stddev_pop({valid}) AS sd{i}"]
    got = df.selectExpr(*aggregates).first()
    for i, s in enumerate(counted):
        s.stats["hit"] = got[f"hit{i}"]
        if s.action == "gauss":
            s.stats |= {"avg": got[f"avg{i}"], "sd": got[f"sd{i}"]}


def _medians(df: DataFrame, steps: list[_Step]) -> None:
    """Median of the cells that stay; of all cells when none stays."""
    values, cells, owners = {}, {}, {}
    for i, s in enumerate(s for s in steps if s.action == "median" and s.stats["filled"]):
        valid = s.stats["rows"] - s.stats["hit"]
        values[f"m{i}"] = f"CASE WHEN NOT {s.mask()} THEN {s.number()} END" if valid else s.number()
        cells[f"m{i}"] = valid or s.stats["filled"]
        owners[f"m{i}"] = s
    for name, found in exact_quantiles(df, values, (0.5,), cells).items():
        median = found[0.5]
        owners[name].stats["median"] = int(median) if owners[name].kind == "integer" else median


def _modes(df: DataFrame, steps: list[_Step]) -> None:
    asked = [s for s in steps if s.action == "mode"]
    if not asked:
        return
    rows = extremes(df, [s.column for s in asked]).select("column", "mode_value").collect()
    found = {r["column"]: r["mode_value"] for r in rows}
    for s in asked:
        s.stats["mode"] = found.get(s.column)


def _project(df: DataFrame, steps: list[_Step], key: list[str], seed: int) -> DataFrame:
    changed: dict[str, Column] = {}
    dropped: list[str] = []
    drawn: list[_Step] = []
    for s in steps:
        if s.action == "drop":
            dropped.append(s.column)
            s.message = fixed.LOG_DROP.format(column=s.column, rows=s.stats["rows"])
        elif s.action == "gauss":
            if _gauss_message(s):
                drawn.append(s)
        elif s.action != "none":
            value = _replacement(s)
            if value is not None:
                target = df.schema[s.column].dataType
                changed[s.column] = F.when(F.expr(s.mask()), F.lit(value).cast(target)).otherwise(
                    ref(s.column)
                )
    df = _draw(df, drawn, changed, key, seed)
    return df.drop(*[ref(c) for c in dropped]) if dropped else df


def _replacement(s: _Step):
    """The constant a step puts in, or None when it has nothing to put in."""
    value = s.param if s.action == "manual" else s.stats.get(s.action)
    template = {"manual": fixed.LOG_MANUAL, "median": fixed.LOG_MEDIAN, "mode": fixed.LOG_MODE}
    chosen = fixed.LOG_IMPUTE_EMPTY if value is None else template[s.action]
    s.message = chosen.format(column=s.column, value=value, n=s.stats.get("hit"), what=s.action)
    return value


def _gauss_message(s: _Step) -> bool:
    """Whether there is a distribution to draw from and anything to replace."""
    low, high = s.bounds
    if s.stats["avg"] is None:
        template = fixed.LOG_GAUSS_EMPTY
    else:
        template = fixed.LOG_GAUSS if s.stats["hit"] else fixed.LOG_GAUSS_NONE
    s.message = template.format(
        column=s.column,
        n=s.stats["hit"],
        mean=s.stats["avg"],
        low=low,
        high=float("inf") if high is None else high,
    )
    if s.stats.get("share", 1) < fixed.MINORITY_LIMIT:  # only the target is balanced by rows
        s.message += fixed.LOG_NOT_BALANCED.format(share=s.stats["share"] * 100)
    return template == fixed.LOG_GAUSS


def gaussian(s: _Step, key: Column, seed: int) -> Column:
    """Normal(mean, std of the valid cells), cut to the domain and to mean + 3 std."""
    mean, std = draws.steady(s.stats["avg"]), draws.steady(s.stats["sd"])
    low, high = s.bounds
    top = mean + 3 * std if high is None else min(high, mean + 3 * std)
    z = draws.normal(seed, s.column, key)
    cut = F.least(F.greatest(z * F.lit(std) + F.lit(mean), F.lit(float(low))), F.lit(float(top)))
    return F.bround(cut, 0 if s.kind == "integer" else 2)


def _draw(
    df: DataFrame, drawn: list[_Step], changed: dict[str, Column], key: list[str], seed: int
) -> DataFrame:
    """Put constants and Gaussian draws in.  Without an identifying column only
    the rows that need a draw are counted and keyed; the others pass through."""
    if not drawn:
        return df.withColumns(changed) if changed else df
    names = df.columns
    schema = df.schema
    hit = " OR ".join(s.mask() for s in drawn)

    def put(frame: DataFrame) -> DataFrame:
        cells = dict(changed)
        for s in drawn:
            value = gaussian(s, F.col(ROW_KEY), seed).cast(schema[s.column].dataType)
            cells[s.column] = F.when(F.expr(s.mask()), value).otherwise(ref(s.column))
        return frame.withColumns(cells).select(*[ref(c) for c in names])

    if key:
        return put(with_row_key(df, key))
    rest = df.where(f"NOT ({hit})")
    rest = rest.withColumns(changed) if changed else rest
    return rest.unionByName(put(with_row_key(df.where(hit), [])))
