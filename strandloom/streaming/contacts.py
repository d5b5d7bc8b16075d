"""Contacts and coverage of pairs as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def contact_stream(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The contact matrix of a stream of pairs, kept up to date (update or complete mode).

    The state is one count per pair of segments; it adds up as the batch operator does.
    """
    both = F.explode(F.array(F.struct(F.col(a).alias("t1"), F.col(b).alias("t2")), F.struct(F.col(b).alias("t1"), F.col(a).alias("t2"))))
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(both.alias("p")).groupBy("p.t1", "p.t2").agg(F.count(F.lit(1)).alias("n"))


def windowed_contacts(pairs: DataFrame, a: str, b: str, ts: str, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Contacts per window of event time; rows later than ``late`` are dropped, closed windows are appended."""
    both = F.explode(F.array(F.struct(F.col(a).alias("t1"), F.col(b).alias("t2")), F.struct(F.col(b).alias("t1"), F.col(a).alias("t2"))))
    return (
        pairs.withWatermark(ts, late).where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(F.col(ts), both.alias("p")).groupBy(F.window(ts, width), "p.t1", "p.t2").agg(F.count(F.lit(1)).alias("n"))
    )


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Takes all that is there, into an in-memory table ``name``, then stops."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
