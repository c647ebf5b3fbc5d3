"""The semantic schema of a table: one ``ColumnSpec`` per column.

It is metadata, a few values per column, so it lives on the driver; ``to_df``
and ``alias_df`` show it as tables a person can read, store and edit.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabmend.session import local_table

_SPEC_SCHEMA = pa.schema(
    [
        ("ord", pa.int32()),
        ("column", pa.string()),
        ("role", pa.string()),
        ("semantic_type", pa.string()),
        ("low", pa.float64()),
        ("high", pa.float64()),
        ("minority_value", pa.string()),
        ("description", pa.string()),
    ]
)
_ALIAS_SCHEMA = pa.schema(
    [("column", pa.string()), ("alias", pa.string()), ("canonical", pa.string())]
)


@dataclass(frozen=True)
class ColumnSpec:
    role: str = "feature"
    semantic_type: str = "numerical"
    bounds: tuple[float | None, float | None] | None = None
    aliases: dict[str, str] = field(default_factory=dict)  # alias -> canonical
    minority_value: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class TableSpec:
    columns: dict[str, ColumnSpec] = field(default_factory=dict)
    target: str | None = None
    method: str = "supplied"

    def get(self, column: str) -> ColumnSpec | None:
        return self.columns.get(column)

    def role(self, column: str) -> str:
        spec = self.columns.get(column)
        return spec.role if spec else "feature"

    def semantic(self, column: str) -> str | None:
        spec = self.columns.get(column)
        return spec.semantic_type if spec else None

    def bounds(self, column: str) -> tuple[float | None, float | None] | None:
        spec = self.columns.get(column)
        return spec.bounds if spec else None

    def is_target(self, column: str) -> bool:
        return column == self.target or self.role(column) == "target"

    def with_role(self, role: str) -> list[str]:
        return [c for c, s in self.columns.items() if s.role == role]

    @property
    def id_columns(self) -> list[str]:
        return self.with_role("id")

    @property
    def ignore_columns(self) -> list[str]:
        return self.with_role("ignore")

    def with_aliases(self, column: str, aliases: dict[str, str]) -> TableSpec:
        changed = dict(self.columns)
        changed[column] = replace(changed.get(column, ColumnSpec()), aliases=dict(aliases))
        return replace(self, columns=changed)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            {
                "ord": i,
                "column": name,
                "role": s.role,
                "semantic_type": s.semantic_type,
                "low": s.bounds[0] if s.bounds else None,
                "high": s.bounds[1] if s.bounds else None,
                "minority_value": s.minority_value,
                "description": s.description,
            }
            for i, (name, s) in enumerate(self.columns.items())
        ]
        return local_table(spark, rows, _SPEC_SCHEMA)

    def alias_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            {"column": name, "alias": alias, "canonical": canonical}
            for name, s in self.columns.items()
            for alias, canonical in s.aliases.items()
        ]
        return local_table(spark, rows, _ALIAS_SCHEMA)

    @classmethod
    def from_df(
        cls, columns: DataFrame, aliases: DataFrame | None = None, method: str = "stored"
    ) -> TableSpec:
        """Read back ``to_df`` and ``alias_df``, as stored or edited."""
        maps: dict[str, dict[str, str]] = {}
        for row in aliases.collect() if aliases is not None else []:
            maps.setdefault(row["column"], {})[row["alias"]] = row["canonical"]
        specs = {
            row["column"]: ColumnSpec(
                role=row["role"],
                semantic_type=row["semantic_type"],
                bounds=(row["low"], row["high"])
                if row["low"] is not None or row["high"] is not None
                else None,
                aliases=maps.get(row["column"], {}),
                minority_value=row["minority_value"],
                description=row["description"],
            )
            for row in columns.orderBy("ord").collect()
        }
        target = next((c for c, s in specs.items() if s.role == "target"), None)
        return cls(specs, target, method)


def spec_of(columns: Iterable[tuple[str, ColumnSpec]], target: str | None = None) -> TableSpec:
    return TableSpec(dict(columns), target)
