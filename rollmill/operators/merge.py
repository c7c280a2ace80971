"""Upsert of matched source rows into a target, as one lazy projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import MergeSpec, mentions, template, tick
from .match import SOURCE_ID, STEP, TARGET_ID, number_rows


@dataclass(frozen=True)
class MergeResult:
    """``target``: the table after the merge.  ``source``: the source with returned values.
    ``updated`` and ``inserted``: the parts, for counting or writing apart."""

    target: DataFrame
    source: DataFrame
    updated: DataFrame
    inserted: DataFrame

    def counts(self) -> dict[str, int]:
        return {"updated": self.updated.where(F.col("_hit")).count(), "inserted": self.inserted.count()}


def _source_columns(linked: DataFrame) -> list[str]:
    return [c for c in linked.columns if c not in (SOURCE_ID, TARGET_ID, STEP)]


def one_per_target(linked: DataFrame) -> DataFrame:
    """Of the rows linked to one target, the one with the smallest ``working_source_id``."""
    cols = [F.col(tick(c)) for c in linked.columns if c not in (TARGET_ID, SOURCE_ID)]
    row = F.struct(F.col(SOURCE_ID), *cols)
    hit = linked.where(F.col(TARGET_ID).isNotNull()).groupBy(TARGET_ID).agg(F.min_by(row, F.col(SOURCE_ID)).alias("_row"))
    return hit.select(TARGET_ID, "_row.*")


def merge(target: DataFrame, linked: DataFrame, spec: MergeSpec, target_key: str, source_key: str) -> MergeResult:
    """Update matched target rows and insert unmatched source rows.

    On update every correlated source column overwrites the target (a NULL too), moved columns
    take the target's own old value, and expressions see old target values.  Insert takes the
    unmatched rows that satisfy the constraints on source columns alone.  Columns the target
    lacks are not written.  An empty source returns the target as it is.
    """
    names = _source_columns(linked)
    known = set(target.columns)
    chosen = one_per_target(linked).withColumn("_hit", F.lit(True))
    joined = target.alias("t").join(chosen.alias("s"), F.col(f"t.{tick(target_key)}") == F.col(f"s.{TARGET_ID}"), "left")

    values = {c: F.col(f"t.{tick(c)}") for c in target.columns}
    if not spec.insert_only:
        hit = F.col("s._hit")
        new = {to: F.col(f"t.{tick(old)}") for old, to in spec.moves.items()}
        new |= {c: F.expr(template(e, f"s.{tick(c)}" if c in names else None, f"t.{tick(c)}")) for c, e in spec.merge_as.items()}
        new |= {c: F.col(f"s.{tick(c)}") for c in spec.correlated(names)}
        for c, value in new.items():
            if c in known:
                values[c] = F.when(hit, value).otherwise(F.col(f"t.{tick(c)}")).cast(target.schema[c].dataType)
    keep = [value.alias(c) for c, value in values.items()]
    updated = joined.select(*keep, F.coalesce(F.col("s._hit"), F.lit(False)).alias("_hit"))

    fresh = linked.where(F.col(TARGET_ID).isNull())
    for column, text in spec.constraints:
        if not mentions(text, "T"):
            fresh = fresh.where(F.expr(template(text, tick(column))))
    if spec.update_only:
        fresh = fresh.where("false")
    fresh = fresh.alias("s")
    put = {c: F.expr(template(e, f"s.{tick(c)}" if c in names else None)) for c, e in spec.insert_as.items()}
    put |= {c: F.col(f"s.{tick(c)}") for c in names if c not in spec.excluded and c not in spec.insert_as}
    inserted = fresh.select(
        *[(put[f.name].cast(f.dataType) if f.name in put else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.schema],
        F.col(SOURCE_ID).alias("_rm_row"),
        F.col(f"s.{tick(source_key)}").alias("_rm_sid"),
    )
    if spec.generate_key:
        top = target.agg(F.coalesce(F.max(tick(target_key)), F.lit(0)).alias("_rm_top"))
        numbered = number_rows(inserted, "_rm_row", "_rm_no").crossJoin(F.broadcast(top))
        inserted = numbered.withColumn(target_key, (F.col("_rm_top") + F.col("_rm_no")).cast(target.schema[target_key].dataType)).drop("_rm_top", "_rm_no")

    source = linked
    if spec.returns:
        source = _write_back(linked, joined, values, inserted, spec, source_key)
    result = updated.select(*[F.col(tick(c)) for c in target.columns]).unionByName(inserted.select(*[F.col(tick(c)) for c in target.columns]))
    return MergeResult(result, source, updated.select(*[F.col(tick(c)) for c in target.columns], "_hit"), inserted.drop("_rm_row", "_rm_sid"))


def _write_back(linked: DataFrame, joined: DataFrame, values: dict, inserted: DataFrame, spec: MergeSpec, source_key: str) -> DataFrame:
    """The source with the returned expressions, which see the rows as written: ``t.`` the
    merged target row, ``s.`` the source row on update; on insert both name the new row."""
    source_cols = [F.col(f"s.{tick(c)}").alias(c) for c in _source_columns(linked)]
    hit = joined.where(F.col("s._hit") & ~F.lit(spec.insert_only))
    after = hit.select(F.col(f"s.{tick(source_key)}").alias("_rm_sid"), F.struct(*source_cols).alias("s"), F.struct(*[v.alias(c) for c, v in values.items()]).alias("t"))
    row = F.struct(*[F.col(tick(c)) for c in inserted.columns if not c.startswith("_rm_")])
    new = inserted.select("_rm_sid", row.alias("t"), row.alias("s"))
    parts = [df.select("_rm_sid", *[F.expr(e).alias(f"_rm_r{i}") for i, (e, _) in enumerate(spec.returns)]) for df in (after, new)]
    got = parts[0].unionByName(parts[1])
    out = linked.join(got, F.col(tick(source_key)) == F.col("_rm_sid"), "left")
    took = {column: f"_rm_r{i}" for i, (_, column) in enumerate(spec.returns)}
    kept = [
        F.when(F.col("_rm_sid").isNotNull(), F.col(took[c])).otherwise(F.col(tick(c))).alias(c) if c in took else F.col(tick(c)) for c in linked.columns
    ]
    extra = [F.col(r).alias(c) for c, r in took.items() if c not in linked.columns]
    return out.select(*kept, *extra)
