"""Paths over arriving documents.

Documents are independent, so each micro-batch is answered by the batch engine in foreachBatch; no state and no watermark are needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Documents


def stream_matches(arriving: DataFrame, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, id_col: str = "doc_id", content_col: str = "content", **trigger) -> StreamingQuery:
    """Starts a query that gives sink(matches, batch number) for each micro-batch.  Malformed documents give none."""

    def answer(batch: DataFrame, number: int) -> None:
        sink(Documents(batch, id_col, content_col).valid().xpath(path), number)

    writer = arriving.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
