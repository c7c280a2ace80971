"""Connected components by repeated minima, safe for hubs that hold a third of all nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(members: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, component) from rows (id, key): ids that share a key are connected.

    ``ids`` may give all ids by a cheaper plan than ``members``, which is then run once.

    The component is named by its smallest id.  Keys stand between ids, so a key shared by many
    ids costs one row each and no pairs.  Each round takes the smallest label of every key and
    then of every id, both as aggregations that combine before they shuffle; a round that
    changes nothing is the last.  Only ids that share a key take part in rounds.  Labels are
    written to the shared folder after each round.
    """
    everyone = cut((members if ids is None else ids).select("id").distinct())
    # Keys travel as digests of 16 bytes; keys of one id alone connect nothing.
    links = cut(members.where("key IS NOT NULL").select("id", F.unhex(F.md5(F.col("key").cast("string"))).alias("key")).distinct())
    shared = links.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    links = cut(links.join(shared, "key"))
    labels = cut(links.select("id", F.col("id").alias("component")).distinct())
    while True:
        least = links.join(labels, "id").groupBy("key").agg(F.min("component").alias("least"))
        offers = links.join(least, "key").groupBy("id").agg(F.min("least").alias("least"))
        moved = labels.join(offers, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("least", "component")).alias("component"))
        # Follow the label of the label, which halves the length of chains.
        jump = labels.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
        moved = cut(moved.join(jump, F.col("component") == F.col("_i"), "left").select("id", "old", F.least("component", F.coalesce("_c", "component")).alias("component")))
        labels = moved.select("id", "component")
        if moved.where("old <> component").isEmpty():
            found = labels.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
            return everyone.join(found, F.col("id") == F.col("_i"), "left").select("id", F.coalesce("_c", "id").alias("component"))
