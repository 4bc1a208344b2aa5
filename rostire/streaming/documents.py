"""The layers on streams: every layer works on a single document, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pipeline import Pipeline
from ..runtime import shared_dir


def annotate_stream(stream: DataFrame, profile: str | dict = "default", text: str = "text", id_col: str | None = None, **kw) -> DataFrame:
    """A stream of documents as a stream of annotated documents."""
    return Pipeline(profile).process(stream, text, id_col, **kw)


def counts_by_window(stream: DataFrame, ts: str, label: str, width: str = "1 day", slide: str | None = None, late: str = "30 days") -> DataFrame:
    """Rows per event-time window and label, with a watermark that bounds late data."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(window.alias("w"), label).agg(F.count("*").alias("n"))


def write_parquet_stream(out: DataFrame, path: str, name: str) -> StreamingQuery:
    """Write a stream to Parquet with its checkpoint in the shared folder; all that is there is done once."""
    spark = out.sparkSession
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{shared_dir(spark).rstrip('/')}/stream-{name}").trigger(availableNow=True).start()
