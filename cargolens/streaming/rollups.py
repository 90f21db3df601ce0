"""A kept rollup that follows a stream of shipments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cargolens.operators.rollup import Rollup


def follow(stream: DataFrame, rollup: Rollup, name: str, checkpoint: str, *, all_there_is: bool = False) -> StreamingQuery:
    """A query that merges each micro-batch of the stream into the rollup as an increment of its own.

    The increment is named by the query and the batch, and merged once under that name, so a
    batch that is run again after a failure isn't counted twice. checkpoint is the stream's own folder. With all_there_is the
    query ends when what is there is merged.
    """
    writer = stream.writeStream.foreachBatch(lambda rows, k: rollup.add(rows, f"{name}-{k:012}") and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if all_there_is else writer).start()
