"""New pages as a stream: cleaned, cut into chunks and appended, with a record of counts by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking


def chunk_stream(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """Fixed-window chunks of a batch or streaming DataFrame; narrow, so it needs no state."""
    return chunking.fixed(docs, id_col, text_col, size, overlap)


def append_chunks(docs: DataFrame, to: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", size: int = 512, overlap: int = 50):
    """Start a query that appends chunks to a Parquet folder; the file sink's log makes each batch count once."""
    out = chunk_stream(docs, id_col, text_col, size, overlap)
    return out.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, stamp: str = "ts", kind: str = "event_type", value: str = "value", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count and mean by window and kind; rows later than ``late`` behind the newest are dropped in streams."""
    w = F.window(stamp, width)
    return events.withWatermark(stamp, late).groupBy(w, kind).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), kind, "n", "mean")
