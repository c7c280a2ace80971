"""Projection, filter, grouping and join-update of working tables (lazy, one plan each)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import ColumnMap, TableSpec, spark_type, template, tick, typed_null

_S, _T = "_rm_s", "_rm_t"


def _value(column: ColumnMap) -> str:
    ref = tick(column.source) if column.source else None
    if column.expr is not None:
        return template(column.expr, ref)
    return f"CAST({ref} AS {spark_type(column.type or 'text')})"


def shape(source: DataFrame, spec: TableSpec) -> DataFrame:
    """The working table that ``spec`` defines over ``source``.

    Constraints see the source's columns and come before projection and grouping, so they
    reach the scan.  Columns without a source are typed NULLs.  With a schema copied from
    another table, the result has that table's columns and types in its order, NULL where
    the spec maps nothing.  An empty source gives an empty table of the same schema.
    """
    rows = constrain(source, spec.constraints)
    values: dict[str, Column] = {}
    for column in spec.columns:
        values[column.name] = F.expr(_value(column)) if column.mapped else typed_null(column.type)
    if spec.schema_of is not None:
        wanted = spec.schema_of.schema
        out = [values[f.name].cast(f.dataType).alias(f.name) if f.name in values else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    else:
        out = [value.alias(name) for name, value in values.items()]
    if spec.group_by:
        return rows.groupBy(*[F.expr(e) for e in spec.group_by]).agg(*out).select(*[c.name for c in (spec.schema_of.schema if spec.schema_of is not None else spec.columns)])
    return rows.select(*out)


def constrain(source: DataFrame, constraints: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of ``source`` for which every ``(column, "$S ...")`` condition is true."""
    for column, condition in constraints:
        source = source.where(F.expr(template(condition, tick(column))))
    return source


def map_column_from(
    target: DataFrame,
    source: DataFrame,
    key: str | Sequence[str | tuple[str, str]],
    target_column: str,
    source_column: str | None = None,
    expr: str = "$S",
) -> DataFrame:
    """Set ``target_column`` from the row of ``source`` with equal keys.

    ``$S`` is the source column and ``$T`` the target's old value.  Where several source
    rows share a key, their smallest value is taken (NULL counts as smallest); a matched
    NULL overwrites, unmatched rows keep their value, NULL keys never match.
    """
    keys = [key] if isinstance(key, str) else list(key)
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    column = source_column or target_column
    picked = (
        source.where(F.expr(" AND ".join(f"{tick(s)} IS NOT NULL" for s, _ in pairs)))
        .groupBy(*[F.col(tick(s)).alias(f"_k{i}") for i, (s, _) in enumerate(pairs)])
        .agg(F.min(F.struct(F.col(tick(column)).alias("v"))).alias("_hit"))
    )
    s = picked.alias(_S)
    t = target.alias(_T)
    on = [F.col(f"{_T}.{tick(name)}") == F.col(f"{_S}._k{i}") for i, (_, name) in enumerate(pairs)]
    new = F.expr(template(expr, f"{_S}._hit.v", f"{_T}.{tick(target_column)}"))
    old_type = target.schema[target_column].dataType
    out = [
        F.when(F.col(f"{_S}._hit").isNotNull(), new).otherwise(F.col(f"{_T}.{tick(c)}")).cast(old_type).alias(c) if c == target_column else F.col(f"{_T}.{tick(c)}").alias(c)
        for c in target.columns
    ]
    return t.join(s, on, "left").select(*out)


def copy_column(target: DataFrame, source: DataFrame, column: str, key: str | Sequence[str | tuple[str, str]]) -> DataFrame:
    """``target`` with ``column`` copied from ``source`` by key (see ``map_column_from``)."""
    return map_column_from(target, source, key, column)
