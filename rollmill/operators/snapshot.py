"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..spec import tick


def row_hash(values: Mapping[str, Column]) -> Column:
    """64-bit hash of canonical values, in which NULL differs from any text."""
    parts = [F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("~")) for v in values.values()]
    return F.xxhash64(F.concat_ws("\u0001", *parts))


def latest_rows(table: DataFrame, snapshot: str, keys: Mapping[str, Column], compared: Mapping[str, Column], loaded_at: str) -> DataFrame:
    """One row per snapshot and key, the one loaded last: snapshot, keys, hash and values.

    Rows without snapshot or with a NULL or blank key are no records.  Of rows loaded at the
    same moment the one with the largest hash counts.  The aggregation combines before it
    shuffles and its keys are as fine as the records, so a county with a third of all rows
    spreads over all tasks.
    """
    rows = table.select(
        F.col(tick(snapshot)).alias("snapshot"),
        *[v.alias(n) for n, v in keys.items()],
        F.coalesce(F.col(tick(loaded_at)).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("_at"),
        *[v.alias(f"v_{n}") for n, v in compared.items()],
    )
    rows = rows.where(F.expr(" AND ".join(["snapshot IS NOT NULL", *[f"{tick(n)} IS NOT NULL" for n in keys]])))
    rows = rows.withColumn("_hash", row_hash({n: F.col(f"v_{n}") for n in compared}))
    latest = rows.groupBy("snapshot", *keys).agg(F.max(F.struct("_at", "_hash", *[f"v_{n}" for n in compared])).alias("_r"))
    return latest.select("snapshot", *keys, F.col("_r._hash").alias("_hash"), *[F.col(f"_r.v_{n}").alias(n) for n in compared])


def snapshot_diff(table: DataFrame, snapshot: str, keys: Mapping[str, Column], compared: Mapping[str, Column], loaded_at: str) -> DataFrame:
    """Records added, removed or changed between each snapshot and the next.

    Returns snapshot (the later one), the keys, change_kind, and each compared value before
    and after.  A full outer join on (snapshot, key) of each snapshot with the one before;
    a missing side is an addition or removal, unequal row hashes are a change.  The table of
    snapshots has one row per delivery; everything else stays distributed.  One snapshot, or
    an empty table, gives no changes.
    """
    rows = latest_rows(table, snapshot, keys, compared, loaded_at)
    days = table.select(F.col(tick(snapshot)).alias("snapshot")).where("snapshot IS NOT NULL").distinct()
    order = Window.orderBy("snapshot")
    days = days.select("snapshot", F.lag("snapshot").over(order).alias("_before"), F.lead("snapshot").over(order).alias("_next"))
    now = rows.join(days.where("_before IS NOT NULL").select("snapshot"), "snapshot", "left_semi")
    before = rows.join(days.where("_next IS NOT NULL").select("snapshot", "_next"), "snapshot").withColumn("snapshot", F.col("_next")).drop("_next")
    names = ["snapshot", *keys]
    a = before.select(*names, F.col("_hash").alias("_old"), *[F.col(n).alias(f"{n}_before") for n in compared])
    b = now.select(*names, F.col("_hash").alias("_new"), *[F.col(n).alias(f"{n}_after") for n in compared])
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, names, "full_outer").withColumn("change_kind", kind).where("change_kind IS NOT NULL").drop("_old", "_new")
