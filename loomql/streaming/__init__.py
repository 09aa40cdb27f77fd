"""Extension: a query over a streaming frame. The language has no streams of its own; a registered frame may be one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def start(engine: Engine, query: str, name: str, *, mode: str = "append", checkpoint: str | None = None, sink: str = "memory") -> StreamingQuery:
    """Starts a FETCH over registered streaming frames; rows go to the named sink."""
    frame: DataFrame = engine.frame(query)
    writer = frame.writeStream.outputMode(mode).format(sink).queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
