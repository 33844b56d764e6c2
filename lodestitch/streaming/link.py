"""Micro-batch linkage: new S1 entities against static targets. All candidates of an S1 arise in its batch, so context is whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking


def exact_links(stream: DataFrame, targets: DataFrame) -> DataFrame:
    """A stream of entities joined with static targets of their country and normalised name."""
    t = targets.select("country", "norm_name", targets["source"].alias("target_source"), targets["id"].alias("target_id"))
    return stream.where("norm_name <> ''").select(stream["id"].alias("s1_id"), "country", "norm_name").join(t, ["country", "norm_name"])


def link_batches(stream: DataFrame, targets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, channels: tuple[str, ...] = ("exact_name", "name_token_sort")) -> StreamingQuery:
    """Run the channels on each micro-batch and hand the merged pairs to `sink` with the batch's number (write by it, and a
    batch that is run again after a failure replaces itself)."""

    def each(batch: DataFrame, number: int) -> None:
        sink(blocking.candidates(batch, targets, channels), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
