"""Upserts and histories over a stream: each micro-batch is matched and merged as a batch is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.match import match
from ..operators.merge import merge
from ..spec import MatchSpec, MergeSpec


def upsert_stream(
    stream: DataFrame,
    read_target: Callable[[], DataFrame],
    write_target: Callable[[DataFrame, int], None],
    matching: MatchSpec,
    rules: MergeSpec,
) -> DataStreamWriter:
    """A writer that merges every micro-batch into the target.

    ``write_target`` gets the merged table and the batch id; written under that id, a batch
    that is delivered again after a failure replaces its own output.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        target = read_target()
        result = merge(target, match(batch, target, matching), rules, matching.target_key, matching.source_key)
        write_target(result.target, epoch)

    return stream.writeStream.foreachBatch(one)
