"""Indexing events: statistics over tables, windows over streams, and listeners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.tables import ensure_checkpoint_dir

# The kinds of indexing events.
KINDS = """PIPELINE_STARTED PIPELINE_COMPLETED PIPELINE_FAILED STAGE_STARTED STAGE_COMPLETED STAGE_FAILED FILE_PROCESSED FILE_FAILED
ENTITY_CREATED RELATIONSHIP_CREATED PROGRESS_UPDATE PERFORMANCE_METRIC WARNING ERROR CUSTOM""".split()
#: How the kinds of the events table stand for kinds of indexing events.
ALIASES = {"view": "FILE_PROCESSED", "click": "ENTITY_CREATED", "purchase": "RELATIONSHIP_CREATED", "signup": "STAGE_STARTED", "error": "ERROR"}


def kind_of(event_type: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, event_type), F.lit("CUSTOM"))


def statistics(events: DataFrame) -> DataFrame:
    """One row over (kind, ts, count): counts by kind, sums of count (1 where null), first and last time, rates."""
    n = F.coalesce("count", F.lit(1))
    is_ = lambda k: F.col("kind") == k
    seconds = F.try_divide(F.lit(1.0), F.nullif((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6, F.lit(0.0)))
    return events.agg(
        F.count_if(is_("FILE_PROCESSED")).alias("file_count"),
        F.sum(F.when(is_("ENTITY_CREATED"), n).otherwise(0)).cast("bigint").alias("entity_count"),
        F.sum(F.when(is_("RELATIONSHIP_CREATED"), n).otherwise(0)).cast("bigint").alias("relationship_count"),
        F.count_if(is_("ERROR")).alias("error_count"),
        F.count_if(is_("WARNING")).alias("warning_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.round(F.count_if(is_("FILE_PROCESSED")) * seconds, 6).alias("files_per_second"),
    )


# What the message of each kind of event says of it.
MESSAGES = {
    "FILE_PROCESSED": "file processed", "ENTITY_CREATED": "entity created", "RELATIONSHIP_CREATED": "relationship created", "STAGE_STARTED": "stage started", "STAGE_COMPLETED": "stage completed",
    "PROGRESS": "progress", "ERROR": "error", "WARNING": "warning", "CUSTOM": "custom event",
}


def made(events: DataFrame) -> DataFrame:
    """(event_id, ts, kind, message, data) of raw events (event_id, ts, user_id, event_type, value, props): data is a map of the
    fields that are not null, those of the JSON text in props over the event's own."""
    own = F.map_filter(F.create_map(F.lit("source"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type")), lambda k, v: v.isNotNull())
    given = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(given, k))
    data = F.map_filter(F.map_concat(kept, given), lambda k, v: v.isNotNull())
    kind = kind_of(F.col("event_type"))
    names = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return events.select("event_id", "ts", kind.alias("kind"), F.try_element_at(names, kind).alias("message"), data.alias("data"))


def stage_durations(events: DataFrame, start: str, end: str) -> DataFrame:
    """(event_id, source, started, ended, seconds): each end with the last start of its source before it.

    Events are ordered by source and day only; from day to day the last start is carried over one row per source and day,
    so no source is one group. Events without a time are left out.
    """
    day = F.to_date("ts")
    marked = events.where(F.col("kind").isin(start, end) & F.col("ts").isNotNull()).withColumn("day", day).withColumn("begun", F.when(F.col("kind") == start, F.col("ts")))
    days = marked.groupBy("source", "day").agg(F.max("begun").alias("last"))
    earlier = Window.partitionBy("source").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(F.col("source").alias("s"), F.col("day").alias("d"), F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    before = Window.partitionBy("source", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = marked.withColumn("here", F.last("begun", ignorenulls=True).over(before)).where(F.col("kind") == end)
    found = here.join(carried, F.col("source").eqNullSafe(F.col("s")) & (F.col("day") == F.col("d")), "left").withColumn("started", F.coalesce("here", "carried"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return found.where("started IS NOT NULL").select("event_id", "source", "started", F.col("ts").alias("ended"), F.round((micros("ts") - micros("started")) / 1e6, 6).alias("seconds"))


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) over event time, for tables and streams; `late`: watermark of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        rows.groupBy(w.alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
    )


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, session_start, n): runs of events of a user with less than `gap` between them."""
    rows = events.withWatermark("ts", late) if late else events
    return (
        rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("w.start").alias("session_start"), "n")
    )


def drained(spark: SparkSession, source: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a stream gives once all that is there now has been read; written below the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = source.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(source.schema).parquet(f"{base}/out")


def event_log(events: DataFrame, path: str, kinds: list[str] | None = None) -> None:
    """Append events as JSON lines, only the given kinds where any are given."""
    rows = events.where(F.col("kind").isin(kinds)) if kinds else events
    rows.write.mode("append").json(path)
