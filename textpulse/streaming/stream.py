"""Structured Streaming form of the narrow stages.

The clean / score / combine stages are per-row column expressions, so they
run unchanged on a streaming DataFrame. Only the stateful parts change:

* keep-first de-duplication becomes ``dropDuplicatesWithinWatermark`` on the
  post id (state bounded by the watermark delay);
* the temporal summaries become event-time windows with a watermark, so
  late posts are still counted until the watermark passes them.

``build_stream`` returns the streaming DataFrame; the caller chooses the
sink (``foreachBatch`` to Parquet for exactly-once stage tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.operators import cleaning as CL


def clean_stream(posts: DataFrame, watermark: str = "1 day", ts_col: str = "posted_at",
                 key: str = "post_id") -> DataFrame:
    """CLN-1 on a stream: parse time, watermark, de-duplicate, clean, tokens."""
    df = posts
    if ts_col not in df.columns and "posted_raw" in df.columns:
        from textpulse.functions.dates import parse_timestamp
        df = df.withColumn(ts_col, parse_timestamp("posted_raw"))
    # Watermarks need TIMESTAMP (instant) columns; the NTZ post time is kept
    # as is and an instant copy drives event time.
    df = (df.withColumn("event_ts", F.col(ts_col).cast("timestamp"))
            .withWatermark("event_ts", watermark)
            .dropDuplicatesWithinWatermark([key]))
    df = CL.add_clean_columns(df.drop("posted_raw") if "posted_raw" in df.columns else df)
    df = CL.resolve_language(df)
    return CL.add_tokens(df)


def windowed_counts(clean: DataFrame, window: str = "1 day", ts_col: str = "event_ts") -> DataFrame:
    """Posts per event-time window x language x forum (append mode once the
    watermark closes a window)."""
    return (clean.groupBy(F.window(ts_col, window), "lang", "forum")
                 .agg(F.count(F.lit(1)).alias("n"),
                      F.avg("n_tokens").alias("mean_tokens")))
