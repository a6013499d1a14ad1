"""A stream of query contigs searched against a fixed database, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.sketch import Sketches, sketch
from ..params import MapParams
from ..plans.commands import search
from ..runtime import workspaces_of_block


def search_stream(contigs: DataFrame, db: Sketches, sink: Callable[[DataFrame, int], None], checkpoint: str, mp: MapParams = MapParams(), **trigger) -> StreamingQuery:
    """Start a query that sketches every micro-batch of contigs and hands its results to ``sink(df, batch_id)``.

    A genome must arrive within one batch. A batch that is run again has the same id,
    so an idempotent sink gives each result once. What a batch wrote to the shared
    folder is deleted after the sink has had its results.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        with workspaces_of_block():
            sink(search(sketch(batch, db.params), db, mp), batch_id)

    return contigs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
