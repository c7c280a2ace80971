"""De-duplication of one table against itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import MatchSpec, MergeSpec, tick
from .match import STEP, TARGET_ID, match, number_rows
from .merge import MergeResult, merge


class DuplicateCycleError(ValueError):
    """A record matches itself, or a survivor is itself a duplicate."""


def dedup_links(table: DataFrame, spec: MatchSpec, orientation: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """Every row with the row it duplicates (``working_target_id``) and the step.

    By default a record matches the record of smallest key among those with equal step keys,
    if that is not itself; this takes one aggregation per step and no self-join of rows.
    ``orientation`` replaces the rule by predicates on (column, "$T ... $S").  NULL keys never
    match.  Rows of a group may be a third of the table: only its smallest key travels.
    """
    if spec.fuzzy_columns:
        raise ValueError("trigram steps are not defined for de-duplication")
    if spec.source_key != spec.target_key:
        raise ValueError("de-duplication needs one key column")
    rule = orientation or ((spec.target_key, "$T < $S"),)
    if orientation is None and not any(step.joins or step.constraints for step in spec.steps()):
        return _by_smallest_key(table, spec)
    oriented = MatchSpec(spec.target_key, spec.source_key, _with_rule(spec.groups, rule), (*spec.constraints, *rule), spec.joins)
    return match(table, table, oriented)


def _with_rule(groups, rule):
    out = []
    for entry in groups:
        if isinstance(entry, MatchSpec):
            out.append(MatchSpec(entry.target_key, entry.source_key, _with_rule(entry.groups, rule), (*entry.constraints, *rule), entry.joins))
        else:
            out.append(entry)
    return tuple(out)


def _by_smallest_key(table: DataFrame, spec: MatchSpec) -> DataFrame:
    key = spec.target_key
    linked, best = table, []
    for i, step in enumerate(spec.steps()):
        names = [a for a, _ in step.pairs]
        least = table.where(F.expr(" AND ".join(f"{tick(n)} IS NOT NULL" for n in names))).groupBy(*[F.col(tick(n)).alias(f"_k{i}_{j}") for j, n in enumerate(names)]).agg(F.min(tick(key)).alias(f"_m{i}"))
        on = [F.col(tick(n)) == F.col(f"_k{i}_{j}") for j, n in enumerate(names)]
        linked = linked.join(least, on, "left").drop(*[f"_k{i}_{j}" for j in range(len(names))])
        best.append(F.when(F.col(f"_m{i}") < F.col(tick(key)), F.struct(F.lit(i).alias("o"), F.col(f"_m{i}").alias("t"), F.lit(step.group).alias("g"))))
    found = F.coalesce(*best)
    out = linked.select(*[F.col(tick(c)) for c in table.columns], found["t"].alias(TARGET_ID), found["g"].alias(STEP))
    return number_rows(out, key, keys=table)


def check_links(links: DataFrame, key: str) -> DataFrame:
    """One row: ``reflexive`` rows that point to themselves, and ``chained`` links whose target
    points on to another row."""
    reflexive = links.agg(F.count_if(F.col(tick(key)) == F.col(TARGET_ID)).alias("reflexive"))
    a = links.where(F.col(TARGET_ID).isNotNull()).select(F.col(tick(key)).alias("_a"), F.col(TARGET_ID).alias("_to"))
    b = links.where(F.col(TARGET_ID).isNotNull()).select(F.col(tick(key)).alias("_b"))
    chained = a.join(b, (F.col("_to") == F.col("_b")) & (F.col("_a") != F.col("_b"))).agg(F.count(F.lit(1)).alias("chained"))
    return reflexive.crossJoin(chained)


def collapse(table: DataFrame, links: DataFrame, spec: MergeSpec, key: str, checked: bool = True) -> MergeResult:
    """Delete every duplicate and update its survivor by the column rules.

    The key column is always preserved.  Of several duplicates of one survivor the one with
    the smallest key feeds the update.  With ``checked`` the links are verified first (one
    small action) and ``DuplicateCycleError`` raised for cycles and chains.
    """
    if spec.update_only or spec.insert_only or spec.returns:
        raise ValueError("update_only, insert_only and returned values are not defined for de-duplication")
    if checked:
        found = check_links(links, key).first()
        if found["reflexive"] or found["chained"]:
            raise DuplicateCycleError(f"{found['reflexive']} records match themselves, {found['chained']} links lead to a duplicate")
    gone = links.where(F.col(TARGET_ID).isNotNull())
    survivors = table.join(gone.select(F.col(tick(key)).alias("_rm_gone")), F.col(tick(key)) == F.col("_rm_gone"), "left_anti")
    rules = MergeSpec(spec.excluded, spec.preserved | {key}, spec.moves, spec.merge_as, spec.insert_as, update_only=True)
    return merge(survivors, gone, rules, key, key)


