"""Linking source rows to a target table: exact cascades, then trigram steps.

The exact cascade is one plan.  Every step joins the source to the target on its keys and
yields (source row, step, smallest target key); per source row the smallest (step, key)
wins.  That equals running the steps one after the other, each on the rows still unmatched,
because an exact step depends on earlier ones in no other way.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..spec import MatchSpec, MatchStep, mentions, template, tick
from .trigram import nearest_by_trigram

#: A reference to one side by its name, beside the placeholders.
_QUALIFIED = re.compile(r"\b[st]\.", re.I)

SOURCE_ID, TARGET_ID, STEP = "working_source_id", "working_target_id", "match_step"


def number_rows(df: DataFrame, key: str, name: str = SOURCE_ID, keys: DataFrame | None = None, rows_per_part: int = 200_000) -> DataFrame:
    """``df`` with consecutive numbers from 1 in the order of ``key``, NULL first.

    Rows are cut into parts of about ``rows_per_part``, at most four times the shuffle partitions,
    at fixed bounds drawn once from some twenty keys per part: a row's part depends on its key
    alone, so the counts per part, which shift the numbers inside parts, hold however often the plan
    is run.  Bounds stand in two levels, so a row looks at no more than twice their square root.
    ``keys`` may give the same keys by a cheaper plan than ``df``.
    """
    column = F.col(tick(key))
    order = column.asc_nulls_first()
    known = (keys if keys is not None else df).select(column.alias("_k"))
    n = known.count()
    parts = min(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // rows_per_part)
    if parts < 2:
        return df.withColumn(name, F.row_number().over(Window.orderBy(order)).cast("bigint"))  # no more than two parts' rows
    step = max(1, n // (parts * 20))
    drawn = sorted(r["_k"] for r in known.where(F.col("_k").isNotNull() & (F.pmod(F.xxhash64("_k"), F.lit(step)) == 0)).distinct().collect())
    bounds = [drawn[i * len(drawn) // parts] for i in range(1, parts)] if drawn else []
    width = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    lead, fine = F.array(*[F.lit(g[-1]) for g in groups]), F.array(*[F.array(*map(F.lit, g)) for g in groups])

    def part(c: Column) -> Column:
        if not groups:
            return F.when(c.isNull(), -1).otherwise(0)
        coarse = F.size(F.filter(lead, lambda x: x < c))
        return F.when(c.isNull(), -1).otherwise(coarse * width + F.coalesce(F.size(F.filter(F.get(fine, coarse), lambda x: x < c)), F.lit(0)))

    sizes = known.groupBy(part(F.col("_k")).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")))  # one row per part
    rows = df.withColumn("_part", part(column)).withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return rows.join(shifts, "_part").select(*[F.col(tick(c)) for c in df.columns], (F.col("_shift") + F.col("_row")).alias(name))


def working_source(source: DataFrame, spec: MatchSpec, key_type: str = "bigint") -> DataFrame:
    """The source with a serial id in the order of its key and an empty target link."""
    return number_rows(source, spec.source_key).withColumn(TARGET_ID, F.lit(None).cast(key_type))


def _condition(step: MatchStep) -> Column:
    on = [F.col(f"s.{tick(a)}") == F.col(f"t.{tick(b)}") for a, b in step.pairs]
    on += [F.expr(template(text, f"s.{tick(c)}", f"t.{tick(c)}")) for c, text in step.constraints]
    return reduce(lambda a, b: a & b, on)


def _step_links(source: DataFrame, target: DataFrame, spec: MatchSpec, step: MatchStep, order: int) -> DataFrame:
    sid, tid = spec.source_key, spec.target_key
    needed = sorted({b for _, b in step.pairs} | {c for c, text in step.constraints if mentions(text, "T")})
    named = any(_QUALIFIED.search(text) for _, text in step.constraints)
    if not step.joins and not named and tid not in needed:
        # Targets that agree in all the step looks at stand for their smallest key.
        keys = sorted({b for _, b in step.pairs})
        reduced = target.where(F.expr(" AND ".join(f"{tick(n)} IS NOT NULL" for n in keys)))
        reduced = reduced.groupBy(*[F.col(tick(n)) for n in needed]).agg(F.min(tick(tid)).alias("_rm_hit"))
        t, hit = reduced.alias("t"), F.col("t._rm_hit")
    else:
        t, hit = target.alias("t"), F.col(f"t.{tick(tid)}")
        for name, table, on in step.joins:
            t = t.join(table.alias(name), F.expr(on), "inner")
    pairs = source.alias("s").join(t, _condition(step), "inner")
    return pairs.select(F.col(f"s.{tick(sid)}").alias("sid"), F.lit(order).alias("ord"), F.lit(step.group).alias("grp"), hit.alias("tid")).where("tid IS NOT NULL")


def exact_links(source: DataFrame, target: DataFrame, spec: MatchSpec) -> DataFrame:
    """One row (sid, ord, grp, tid) per source row that an exact step matches."""
    steps = spec.steps()
    if not steps:
        none = F.lit(None).cast(target.schema[spec.target_key].dataType)
        return source.select(F.col(tick(spec.source_key)).alias("sid"), F.lit(0).alias("ord"), F.lit(0).alias("grp"), none.alias("tid")).where("false")
    links = reduce(DataFrame.unionByName, [_step_links(source, target, spec, step, i) for i, step in enumerate(steps)])
    best = links.groupBy("sid").agg(F.min(F.struct("ord", "tid", "grp")).alias("b"))
    return best.select("sid", "b.ord", "b.grp", "b.tid")


def fuzzy_links(source: DataFrame, target: DataFrame, spec: MatchSpec, exact: DataFrame) -> list[DataFrame]:
    """The links of the trigram steps, in order, each (sid, tid).

    The pool of candidates loses the targets matched by top-level exact steps and by earlier
    trigram steps; matches of nested specs stay in the pool unless ``nested_shrinks_pool``.
    Constraints hold for the candidates of a step.  Sequential by nature: a step depends on
    the links of the one before.
    """
    sid, tid = spec.source_key, spec.target_key
    keep = exact if spec.nested_shrinks_pool else exact.where(~F.col("grp").isin(list(spec.nested_groups) or [-1]))
    pool = target.join(keep.select(F.col("tid").alias("_rm_used")).distinct(), F.col(tick(tid)) == F.col("_rm_used"), "left_anti")
    rest = source.join(exact.select(F.col("sid").alias("_rm_done")), F.col(tick(sid)) == F.col("_rm_done"), "left_anti")
    out = []
    for column in spec.fuzzy_columns:
        free = rest
        for c, text in spec.constraints:
            if not mentions(text, "T"):
                free = free.where(F.expr(template(text, tick(c))))
        found = nearest_by_trigram(free, pool, sid, tid, column, [(c, text) for c, text in spec.constraints if mentions(text, "T")])
        out.append(found)
        pool = pool.join(found.select(F.col("tid").alias("_rm_used")).distinct(), F.col(tick(tid)) == F.col("_rm_used"), "left_anti")
        rest = rest.join(found.select(F.col("sid").alias("_rm_done")), F.col(tick(sid)) == F.col("_rm_done"), "left_anti")
    return out


def match(source: DataFrame, target: DataFrame, spec: MatchSpec, numbered: bool = True) -> DataFrame:
    """Every source row with its link: ``working_source_id`` (if ``numbered``),
    ``working_target_id`` and ``match_step``.

    ``match_step`` is the index of the top-level group that matched; a trigram step counts on
    from the number of groups.  NULL keys never match.  Where a step finds several targets,
    the smallest key is taken.  Source keys are taken to be unique; rows with a NULL key are
    kept unmatched.  An empty side gives the source with NULL links.
    """
    exact = exact_links(source, target, spec)
    links = exact.select("sid", "tid", F.col("grp").alias("step"))
    if spec.fuzzy_columns:
        from ..session import cut

        exact = cut(exact)
        links = exact.select("sid", "tid", F.col("grp").alias("step"))
        for i, found in enumerate(fuzzy_links(source, target, spec, exact)):
            links = links.unionByName(found.withColumn("step", F.lit(len(spec.groups) + i)))
    base = number_rows(source, spec.source_key) if numbered else source
    joined = base.join(links.select(F.col("sid").alias("_rm_sid"), F.col("tid").alias(TARGET_ID), F.col("step").alias(STEP)), F.col(tick(spec.source_key)) == F.col("_rm_sid"), "left")
    return joined.drop("_rm_sid")
