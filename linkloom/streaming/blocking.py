"""Candidates of arriving reference records.

The index (postings and numbers of the other sources) is a table; arriving records meet it in
each micro-batch by the same equi-joins as in a batch run, so a record's candidates are
those that a batch run over the same index gives it. No state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking as B
from ..operators.prepare import prepare


def candidates_of_stream(arriving: DataFrame, index: DataFrame, sink: str, checkpoint: str, **parameters) -> StreamingQuery:
    """Starts a query that appends each micro-batch's candidates, as Parquet, to sink/batch=N; a batch that is run again replaces its own folder."""

    def run(batch: DataFrame, number: int) -> None:
        B.candidates(prepare(batch), index, **parameters).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
