"""History of changing attributes: a bitemporal ledger built by a sweep-line.

A report says that an attribute of an entity took a value from a day on (*valid* time), and
reached us at some moment (*recorded* time).  The ledger holds, per entity and attribute, rows
with both periods.  A late report splits the interval it falls into: the old row is closed at
the moment the report arrived and its two parts are recorded anew; nothing is overwritten, so
the history can be read as it was known at any time.

Scale.  Reports of an entity are swept in the order they were recorded, with the timelines so
far as the only state; a timeline has at most one entry per calendar day, so the state of a
task is bounded however many reports an entity has.  Reports travel once, as wide rows.  An
entity with more than ``hot_rows`` reports is cut into epochs of recorded time that are swept
in parallel: each epoch starts from the timelines as known at its begin, which windows over
(entity, attribute, day) compute, and rows that stay open over an epoch's end are joined
again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_on_workers
from ..spec import tick

#: Recorded time of reports that came without one: before all others.
UNKNOWN_TIME = "0001-01-01 00:00:00"

_PIECE = "entity string, field_name string, epoch int, value string, valid_from date, valid_to date, recorded_from bigint, recorded_to bigint, came_in boolean, goes_on boolean"


def reports(
    updates: DataFrame,
    entity: str,
    effective_on: str,
    received_at: str,
    fields: Mapping[str, Column],
    tie: str | None = None,
) -> DataFrame:
    """Updates as rows (entity, eff, rec, tie, one column per field in canonical form).

    A NULL field was not reported.  Rows without entity or day, and rows that report nothing,
    do not count.  Of reports that agree in entity, day and moment the one with the largest
    ``tie`` (then value) counts.
    """
    key = F.trim(F.col(tick(entity)).cast("string"))
    values = [F.col(f"f_{n}").isNotNull() for n in fields]
    return updates.select(
        key.alias("entity"),
        F.col(tick(effective_on)).cast("date").alias("eff"),
        F.coalesce(F.col(tick(received_at)).cast("timestamp"), F.lit(UNKNOWN_TIME).cast("timestamp")).alias("rec"),
        (F.col(tick(tie)) if tie else F.lit(0)).cast("bigint").alias("tie"),
        *[v.alias(f"f_{n}") for n, v in fields.items()],
    ).where((F.col("entity") != "") & F.col("eff").isNotNull() & reduce(lambda a, b: a | b, values))


class _Timeline:
    """Days in order with, per day, its value, since when it is recorded, and whether it came
    in from an earlier epoch."""

    def __init__(self) -> None:
        self.days: list = []
        self.held: list[tuple] = []

    def piece(self, at: int, until, goes_on: bool = False) -> tuple:
        value, since, came = self.held[at]
        return value, self.days[at], self.days[at + 1] if at + 1 < len(self.days) else None, since, until, came, goes_on

    def carry(self, day, value) -> None:
        at = bisect_left(self.days, day)
        self.days.insert(at, day)
        self.held.insert(at, (value, None, True))

    def report(self, day, moment, value) -> tuple | None:
        """Record a report; the piece that it closes, if any."""
        at = bisect_left(self.days, day)
        if at < len(self.days) and self.days[at] == day:
            if self.held[at][0] == value:
                return None
            closed = self.piece(at, moment)
            self.held[at] = (value, moment, False)
            return closed
        closed = None
        if at:
            closed = self.piece(at - 1, moment)
            self.held[at - 1] = (self.held[at - 1][0], moment, False)
        self.days.insert(at, day)
        self.held.insert(at, (value, moment, False))
        return closed


def _sweeper(fields: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = [c.split()[0] for c in _PIECE.split(", ")]

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by (entity, epoch, carried first, recorded time, day, tie)."""
        out: list[tuple] = []
        key, last, lines = None, True, {}
        moment: tuple | None = None
        waiting: dict = {}

        def settle() -> None:
            for name, value in waiting.items():
                closed = lines.setdefault(name, _Timeline()).report(moment[1], moment[0], value)
                if closed is not None and closed[3] != closed[4]:
                    out.append((key[0], name, key[1], *closed))
            waiting.clear()

        def finish() -> None:
            settle()
            for name, line in lines.items():
                out.extend((key[0], name, key[1], *line.piece(i, None, not last)) for i in range(len(line.days)))

        def frame() -> pd.DataFrame:
            df = pd.DataFrame(out, columns=columns)
            return df.astype({"recorded_from": "Int64", "recorded_to": "Int64"})

        for batch in batches:
            values = [batch[f"f_{n}"] for n in fields]
            for entity, epoch, final, carried, eff, rec, *got in zip(batch["entity"], batch["epoch"], batch["final"], batch["carried"], batch["eff"], batch["rec"], *values, strict=True):
                if (entity, epoch) != key:
                    if key is not None:
                        finish()
                    key, last, lines, moment = (entity, epoch), epoch >= final, {}, None
                if (rec, eff) != moment or carried:
                    settle()
                    moment = (rec, eff)
                for name, value in zip(fields, got, strict=True):
                    if value is not None:
                        if carried:
                            lines.setdefault(name, _Timeline()).carry(eff, value)
                        else:
                            waiting[name] = value
            if len(out) > 50_000:
                yield frame()
                out.clear()
        if key is not None:
            finish()
        yield frame()

    return sweep


def bitemporal_ledger(rows: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """The ledger of ``reports``: entity, field_name, value, valid_from, valid_to,
    recorded_from, recorded_to; an open end is NULL.

    Reports with a value equal to the one already recorded for the same day add nothing.
    Empty input gives an empty ledger.  One small action counts reports per entity to see
    whether any is hot.
    """
    from ..session import cut

    fields = [c[2:] for c in rows.columns if c.startswith("f_")]
    result = ["entity", "field_name", "value", "valid_from", "valid_to", "recorded_from", "recorded_to"]
    body = ["entity", "epoch", "final", "carried", "eff", "rec", "tie", *(f"f_{n}" for n in fields)]
    plain = rows.select("entity", F.lit(0).alias("epoch"), F.lit(0).alias("final"), F.lit(False).alias("carried"), *body[4:])
    hot_keys = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("entity")
    if hot_keys.isEmpty():
        return _swept(plain, fields).select(*result)

    hours = rows.join(hot_keys, "entity", "left_semi").groupBy("entity", F.date_trunc("hour", "rec").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("entity").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("epoch", F.floor(F.coalesce(F.sum("n").over(running), F.lit(0)) / hot_rows).cast("int"))
    hours = cut(hours.withColumn("final", F.max("epoch").over(Window.partitionBy("entity"))).drop("n"))
    hot = rows.withColumn("hour", F.date_trunc("hour", "rec")).join(hours, ["entity", "hour"]).withColumn("carried", F.lit(False)).select(*body)
    cold = plain.join(hours.select("entity").distinct(), "entity", "left_anti")
    carried = []
    for n in fields:
        value = f"f_{n}"
        one = hot.where(F.col(value).isNotNull()).groupBy("entity", "eff", "epoch", "final").agg(F.max(F.struct("rec", "tie", value))[value].alias(value))
        by_day = Window.partitionBy("entity", "eff").orderBy("epoch")
        known = one.withColumn("until", F.coalesce(F.lead("epoch").over(by_day), F.col("final"))).where("epoch < until")
        known = known.withColumn("epoch", F.explode(F.sequence(F.col("epoch") + 1, F.col("until"))))
        empty = F.lit(None).cast("string")
        carried.append(
            known.select("entity", "epoch", "final", F.lit(True).alias("carried"), "eff", F.lit(UNKNOWN_TIME).cast("timestamp").alias("rec"), F.lit(0).cast("bigint").alias("tie"), *[F.col(value) if m == n else empty.alias(f"f_{m}") for m in fields])
        )
    pieces = _swept(reduce(DataFrame.unionByName, [cold, hot, *carried]), fields)
    same = Window.partitionBy("entity", "field_name", "valid_from", "valid_to", "value").orderBy("epoch", F.col("came_in").desc(), "recorded_from")
    chained = pieces.withColumn("run", F.sum(F.when(F.col("came_in"), 0).otherwise(1)).over(same))
    joined = chained.groupBy("entity", "field_name", "valid_from", "valid_to", "value", "run").agg(
        F.min("recorded_from").alias("recorded_from"), F.max("recorded_to").alias("recorded_to")
    )
    return joined.select(*result)


def _swept(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    order = ["entity", "epoch", F.col("carried").desc(), "rec", "eff", "tie", *(f"f_{n}" for n in fields)]
    ensure_on_workers(rows.sparkSession)
    timed = rows.withColumn("rec", F.unix_micros("rec"))  # whole range of times, as pandas has not
    pieces = timed.repartition("entity", "epoch").sortWithinPartitions(*order).mapInPandas(_sweeper(list(fields)), _PIECE)
    return pieces.withColumns({c: F.timestamp_micros(c) for c in ("recorded_from", "recorded_to")})


def known_at(ledger: DataFrame, moment: Column | None = None) -> DataFrame:
    """The ledger's rows that were in force at a moment of recorded time; now if None."""
    if moment is None:
        return ledger.where("recorded_to IS NULL")
    return ledger.where((F.col("recorded_from") <= moment) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > moment)))


def versions(ledger: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Versions of whole entities from ledger rows of one moment (see ``known_at``): entity,
    valid_from, valid_to and the fields.

    A version begins on each day after which the state differs from before, the first
    included.  One shuffle by entity serves all steps; an entity has at most one row per field
    and calendar day.
    """
    per_field = Window.partitionBy("entity", "field_name").orderBy("valid_from")
    changed = ledger.select("entity", "field_name", "value", "valid_from").repartition("entity").withColumn("before", F.lag("value").over(per_field)).where("before IS NULL OR before <> value")
    wide = changed.groupBy("entity", "valid_from").agg(*[F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n in fields])
    per_entity = Window.partitionBy("entity").orderBy("valid_from")
    so_far = per_entity.rowsBetween(Window.unboundedPreceding, 0)
    filled = wide.select("entity", "valid_from", F.lead("valid_from").over(per_entity).alias("valid_to"), *[F.last(n, ignorenulls=True).over(so_far).alias(n) for n in fields])
    return filled


__all__ = ["bitemporal_ledger", "known_at", "reports", "versions"]
