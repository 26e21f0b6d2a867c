"""Streaming queries, driven to the end of their input."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..storage import drop, materialise, own_dir
from ..streaming import episodes as E
from ..streaming import traces as S
from .evaluation import _EPISODE
from .registry import query
from .views import table, traces


#: Events of a delivered file, about.
DELIVERED = 4_000_000
#: 1,024 neighbouring episodes share a key of the state: a delivery brings a third of the events of each.
BUNDLE = 10


def _events(spark, d):
    """The events table as a stream: Structured Streaming reads folders, so its one file or folder is matched by name."""
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet")


@query("stream_window_counts", "SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS start, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    stream = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{own_dir(spark)}/stream-{uuid4().hex}"
    counts = S.windowed_counts(stream, "ts", "0 seconds", "1 day", None, F.col("event_type")).select("start", "key", "n")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    job = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
    job.awaitTermination()
    found = spark.read.parquet(f"{base}/out")
    last = found.agg(F.max("batch").alias("last"))
    return found.join(F.broadcast(last), found.batch == F.col("last")).select(F.col("start").cast("timestamp_ntz").alias("start"), "key", "n")


@query("stream_journal", "SELECT event_id, user_id, event_type FROM events")
def _(spark, d):
    base = f"{own_dir(spark)}/journal-{uuid4().hex}"
    stream = _events(spark, d).select("event_id", "user_id", "event_type")
    for _ in range(2):  # the second run finds nothing new
        S.append_journal(stream, f"{base}/journal", f"{base}/check", ["event_id"], {"table": "events"}).awaitTermination()
    return S.read_journal(spark, f"{base}/journal", stream.schema)


@query("stream_episodes", _EPISODE.format(tools=1, steps=2, seconds=0.5))
def _(spark, d):
    """The fold of recorded episodes, as keyed state of a stream that is stopped after each file and started again from its checkpoint."""
    base = f"{own_dir(spark)}/episodes-{uuid4().hex}"
    times = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    recorded = traces(spark, d).join(times, "event_id").select("trace_id", F.col("sequence").cast("long").alias("sequence"), "kind", "seconds", "ts")
    recorded = materialise(recorded, "recorded")
    files = recorded.count() // (3 * DELIVERED) + 1
    for part in range(3):  # in three deliveries that cut through traces
        delivery = recorded.where(F.pmod(F.col("sequence") + F.col("trace_id"), F.lit(3)) == part)
        # what costs most is a micro-batch, whatever it holds, so files are few; neighbouring traces lie together, so a key of the state comes in one of them
        delivery.repartition(files, F.shiftright("trace_id", BUNDLE)).write.mode("append").parquet(f"{base}/events")
        stream = S.read_events(spark, f"{base}/events", recorded.schema, 2)
        E.run(E.episodes(stream, 2, 1, 0.5, late="3650 days", bundle=BUNDLE), f"{base}/out", f"{base}/check").awaitTermination()
    drop(spark, recorded)
    out = E.latest(spark.read.schema(f"{E.EPISODE}, batch long").parquet(f"{base}/out"))
    return out.select("trace_id", "steps", "tool_calls", "invalid_actions", "python_seconds", "reason")
