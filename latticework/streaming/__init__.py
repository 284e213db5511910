"""Streams into versioned arrays, and regrid over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..frame import ArrayFrame
from ..functions.aggregates import parse_aggregates
from ..operators.aggregation import redimension
from ..schema import SPARK_TO_TYPE, ArraySchema, Attr, Dim, parse_schema
from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, name: str, schema: str | ArraySchema, checkpoint: str, *calls: str) -> StreamingQuery:
    """Each micro-batch is redimensioned and inserted as a new version; late cells replace earlier ones.

    An insert writes the batch's cells only. A batch that is run again after a failure is known by its number and skipped.
    """
    to = parse_schema(schema) if isinstance(schema, str) else schema
    if not store.exists(name):
        store.create(name, to)

    def one(batch: DataFrame, number: int) -> None:
        kinds = dict(batch.dtypes)
        flat = ArrayFrame.of(batch.withColumn("__row", F.monotonically_increasing_id()), ArraySchema(tuple(Attr(c, SPARK_TO_TYPE[kinds[c]], True) for c in batch.columns), (Dim("__row"),)))
        store.insert(redimension(flat, to, *calls), name, batch=f"{checkpoint}:{number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def time_regrid(stream: DataFrame, time: str, width: str, late: str, *calls: str, by: tuple[str, ...] = (), slide: str | None = None) -> DataFrame:
    """Aggregates of event-time windows (tumbling, or sliding by ``slide``), with a watermark for late rows.

    Works on streams and tables alike; state is bounded by the watermark.
    """
    kinds = dict(stream.dtypes)
    flat = ArraySchema(tuple(Attr(c, SPARK_TO_TYPE.get(kinds[c], "string"), True) for c in stream.columns), (Dim("__row"),))
    aggs = parse_aggregates(list(calls), flat)
    source = stream.withWatermark(time, late) if stream.isStreaming else stream
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return source.groupBy(window, *by).agg(*[a.column() for a in aggs]).select(F.col("window.start").alias("start"), *by, *[a.name for a in aggs])
