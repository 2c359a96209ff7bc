"""New catalog rows matched as they arrive, against a catalog that stands still. An extension: batches run the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kindred.operators.blocking import shared_identifiers
from kindred.operators.catalog import FULL, ColumnMap, build_records, one_row_each


def match_stream(arriving: DataFrame, right: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, columns: ColumnMap = FULL) -> StreamingQuery:
    """Each micro-batch of arriving catalog rows is turned into records and joined with right (records) by identifiers; sink gets the pairs.

    A batch that is run again after a failure has the same id, so a sink that overwrites by id writes each pair once.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(shared_identifiers(build_records(one_row_each(batch, columns.id), columns), right), batch_id)

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
