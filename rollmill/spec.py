"""Declarative descriptions of column maps, matches, merges and dedups.

Everything here is plain data.  ``$S`` and ``$T`` stand for a column of the source and of
the target relation; the operators substitute them when they build expressions.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: SQL type names that Spark spells differently; any other name is passed on.
TYPE_NAMES = {
    "text": "string",
    "uuid": "string",
    "varchar": "string",
    "int": "int",
    "integer": "int",
    "serial": "int",
    "bigserial": "bigint",
    "boolean": "boolean",
    "decimal": "decimal(38,18)",
    "numeric": "decimal(38,18)",
    "timestamptz": "timestamp",
}

_PLACEHOLDER = re.compile(r"\$([ST])\b")


def spark_type(name: str) -> str:
    """The Spark spelling of a declared column type."""
    return TYPE_NAMES.get(name.strip().lower(), name.strip())


def tick(name: str) -> str:
    """A column name quoted for Spark SQL."""
    return "`" + name.replace("`", "``") + "`"


def template(text: str, source: str | None = None, target: str | None = None) -> str:
    """``text`` with ``$S`` and ``$T`` replaced by SQL references.

    Raises ``ValueError`` for a placeholder that has nothing to stand for.
    """

    def put(found: re.Match) -> str:
        ref = source if found[1] == "S" else target
        if ref is None:
            raise ValueError(f"{found[0]} has no column to refer to in {text!r}")
        return ref

    return _PLACEHOLDER.sub(put, text)


def mentions(text: str, side: str) -> bool:
    return any(found == side for found in _PLACEHOLDER.findall(text))


@dataclass(frozen=True)
class ColumnMap:
    """One output column: ``expr`` over ``source``, or a cast of it, or a typed NULL."""

    name: str
    source: str | None = None
    type: str | None = None
    expr: str | None = None
    mapped: bool = True


@dataclass(frozen=True)
class TableSpec:
    """Shape of a working table; every builder method returns a new spec."""

    columns: tuple[ColumnMap, ...] = ()
    constraints: tuple[tuple[str, str], ...] = ()
    group_by: tuple[str, ...] = ()
    default_type: str = "text"
    primary_key: tuple[str, str] | None = None
    schema_of: Any = None

    def with_default_type(self, name: str) -> TableSpec:
        """Type of columns declared from here on without a type of their own."""
        return replace(self, default_type=name)

    def add_column(self, name: str, type: str | None = None) -> TableSpec:
        return replace(self, columns=(*self.columns, ColumnMap(name, None, type or self.default_type, None, False)))

    def map_column(self, name: str, source: str | None = None, type: str | None = None, expr: str | None = None) -> TableSpec:
        if source is None and expr is None:
            raise ValueError(f"column {name!r} needs a source column or an expression")
        return replace(self, columns=(*self.columns, ColumnMap(name, source, type or self.default_type, expr)))

    def constrain(self, column: str, condition: str) -> TableSpec:
        return replace(self, constraints=(*self.constraints, (column, condition)))

    def group_records_by(self, *expressions: str) -> TableSpec:
        return replace(self, group_by=(*self.group_by, *expressions))

    def set_primary_key(self, column: str, type: str = "int") -> TableSpec:
        return replace(self, primary_key=(column, type))

    def copy_schema_from(self, table: DataFrame) -> TableSpec:
        return replace(self, schema_of=table)

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def mapped_column_names(self) -> list[str]:
        return [c.name for c in self.columns if c.mapped]


#: A key of a match step: a column both sides have, or (source column, target column).
Key = str | tuple[str, str]


@dataclass(frozen=True)
class MatchStep:
    """One exact step: all ``keys`` equal, every constraint and join held."""

    keys: tuple[Key, ...]
    constraints: tuple[tuple[str, str], ...] = ()
    joins: tuple[tuple[str, DataFrame, str], ...] = ()
    group: int = 0

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return [(k, k) if isinstance(k, str) else k for k in self.keys]


@dataclass(frozen=True)
class MatchSpec:
    """An ordered cascade of exact steps, followed by trigram steps.

    ``constraints`` and ``joins`` hold for the spec's own steps, not for nested specs.
    """

    target_key: str
    source_key: str
    groups: tuple[Any, ...] = ()
    constraints: tuple[tuple[str, str], ...] = ()
    joins: tuple[tuple[str, DataFrame, str], ...] = ()
    fuzzy_columns: tuple[str, ...] = ()
    nested_shrinks_pool: bool = False

    def __post_init__(self) -> None:
        if not self.target_key:
            raise ValueError("the target needs a primary key to be matched against")

    def exact(self, *keys: Key) -> MatchSpec:
        return replace(self, groups=(*self.groups, tuple(keys)))

    def foreign_key(self, source_key: str, target_key: str) -> MatchSpec:
        return self.exact((source_key, target_key))

    def nested(self, spec: MatchSpec) -> MatchSpec:
        return replace(self, groups=(*self.groups, spec))

    def constrain(self, column: str, condition: str) -> MatchSpec:
        return replace(self, constraints=(*self.constraints, (column, condition)))

    def join_table(self, name: str, table: DataFrame, on: str) -> MatchSpec:
        return replace(self, joins=(*self.joins, (name, table, on)))

    def fuzzy(self, *columns: str) -> MatchSpec:
        return replace(self, fuzzy_columns=(*self.fuzzy_columns, *columns))

    def steps(self, group: int | None = None) -> list[MatchStep]:
        """The cascade flattened: nested specs become steps with their own predicates,
        tagged with the index of the top-level group they stand in."""
        out: list[MatchStep] = []
        for index, entry in enumerate(self.groups):
            tag = index if group is None else group
            if isinstance(entry, MatchSpec):
                out += entry.steps(tag)
            else:
                out.append(MatchStep(entry, self.constraints, self.joins, tag))
        return out

    @property
    def nested_groups(self) -> set[int]:
        return {i for i, entry in enumerate(self.groups) if isinstance(entry, MatchSpec)}


@dataclass(frozen=True)
class MergeSpec:
    """Column rules of an upsert."""

    excluded: frozenset[str] = frozenset()
    preserved: frozenset[str] = frozenset()
    moves: Mapping[str, str] = field(default_factory=dict)
    merge_as: Mapping[str, str] = field(default_factory=dict)
    insert_as: Mapping[str, str] = field(default_factory=dict)
    returns: tuple[tuple[str, str], ...] = ()
    constraints: tuple[tuple[str, str], ...] = ()
    update_only: bool = False
    insert_only: bool = False
    generate_key: bool = False

    def exclude(self, *names: str) -> MergeSpec:
        return replace(self, excluded=self.excluded | set(names))

    def preserve(self, *names: str) -> MergeSpec:
        return replace(self, preserved=self.preserved | set(names))

    def move(self, **old_to_new: str) -> MergeSpec:
        return replace(self, moves={**self.moves, **old_to_new})

    def merge_column_as(self, name: str, expr: str) -> MergeSpec:
        return replace(self, merge_as={**self.merge_as, name: expr})

    def insert_column_as(self, name: str, expr: str) -> MergeSpec:
        return replace(self, insert_as={**self.insert_as, name: expr})

    def return_value(self, expr: str, column: str) -> MergeSpec:
        return replace(self, returns=(*self.returns, (expr, column)))

    def correlated(self, source_columns: Sequence[str]) -> list[str]:
        """Source columns that overwrite the target's on update."""
        taken = {*self.excluded, *self.preserved, *self.merge_as, *self.moves.values()}
        return [c for c in source_columns if c not in taken]

    def update_columns(self, source_columns: Sequence[str]) -> list[str]:
        return [*self.moves.values(), *self.merge_as, *self.correlated(source_columns)]

    def insert_columns(self, source_columns: Sequence[str]) -> list[str]:
        return [*self.insert_as, *(c for c in source_columns if c not in self.excluded and c not in self.insert_as)]


def typed_null(type_name: str | None) -> Column:
    return F.lit(None).cast(spark_type(type_name or "text"))
