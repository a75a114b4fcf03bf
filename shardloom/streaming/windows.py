"""Event streams: windowed aggregates with watermarks, and routed ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, width: str, late: str, keys: list[str], *aggregates: Column, slide: str | None = None) -> DataFrame:
    """Aggregates by key and tumbling (or sliding) window; rows later than ``late`` are left out of a stream."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(window.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def ingest(engine, table: str, stream: DataFrame, checkpoint: str):
    """A running query that appends each batch of a stream to a table, each row on its shard."""
    target = engine.vschema.find(table)

    def append(batch: DataFrame, number: int) -> None:
        folders = engine.store.write(target.full_name, engine.writer.checked(engine.writer.placed(target, batch)), engine.data(target))
        engine.store.refresh()
        new = engine.data(target).copy()
        for shard, folder in folders.items():
            new.shards.setdefault(shard, []).append(folder)
        engine.stage({target.full_name: new}, set())

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).start()
