"""Attributes as known at event time, by version number.

An entity's attribute changes are numbered 1, 2, 3 ... in time order. Each event
gets the number of changes of its entity at or before its time, counted over
narrow rows (entity, time) only, and the attributes come by an equi-join on
(entity, number). No event ever meets a later change.

Hot entities: counts are first aggregated by (entity, time bucket); a window over
an entity's buckets, which are bounded by the time span and not by the rows,
gives the count carried into each bucket; rows are then numbered within (entity,
bucket) only. An entity holding a third of all rows is thus spread over its
buckets, in the join too, as the bucket is part of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a time bucket: the unit by which a hot entity is split.
BUCKET_S = 86_400


def attributes_at(
    events: DataFrame,
    changes: DataFrame,
    *,
    entity: str,
    event_id: str,
    event_time: str,
    change_time: str,
    running_max: dict[str, Column],
    bucket_s: int = BUCKET_S,
) -> DataFrame:
    """(event_id, entity, event_time, version, *running_max) of each event with at least one change at or before it.

    events: needs ``event_id``, ``entity``, ``event_time`` (bigint seconds); one row per event.
    changes: needs ``entity``, ``change_time`` (bigint seconds) and what ``running_max``
    reads. An attribute is the largest value (of any orderable type, struct included)
    of its column over the changes so far; the latest value is the maximum of
    ``struct(time, value)``. Changes of one entity at one second make one version.
    A change at the event's own second counts as known.

    Events or changes with a null entity or time take no part; events before the
    first change give no row; empty tables give an empty result. Other columns are
    ignored.
    """
    e = events.select(F.col(event_id).alias("eid"), F.col(entity).alias("k"), F.col(event_time).alias("t"))
    e = e.where(F.col("k").isNotNull() & F.col("t").isNotNull()).withColumn("b", F.floor(F.col("t") / bucket_s))
    names = list(running_max)
    c = (
        changes.where(F.col(entity).isNotNull() & F.col(change_time).isNotNull())
        .select(F.col(entity).alias("k"), F.col(change_time).alias("t"), *[v.alias(n) for n, v in running_max.items()])
        .groupBy("k", "t")
        .agg(*[F.max(n).alias(n) for n in names])
        .withColumn("b", F.floor(F.col("t") / bucket_s))
    )

    # What is carried into each (entity, bucket): an exclusive prefix over the entity's buckets.
    of_changes = c.groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"), *[F.max(n).alias(n) for n in names])
    of_events = e.select("k", "b").distinct()
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        of_changes.unionByName(of_events, allowMissingColumns=True)
        .groupBy("k", "b")
        .agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.max(n).alias(n) for n in names])
        .select("k", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("version"), *[F.max(n).over(before).alias(n) for n in names])
    )

    # Number changes and events within their bucket. kind orders equal times: carry, change, event.
    local = Window.partitionBy("k", "b").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    start = carry.select("k", "b", (F.col("b") * bucket_s - 1).cast("bigint").alias("t"), F.lit(0).alias("kind"), F.col("version").alias("add"), *names)
    own = c.select("k", "b", "t", F.lit(1).alias("kind"), F.lit(1).cast("bigint").alias("add"), *names)
    versions = start.unionByName(own).select("k", "b", F.sum("add").over(local).alias("version"), *[F.max(n).over(local).alias(n) for n in names])

    narrow = (
        start.select("k", "b", "t", "kind", "add", F.lit(None).cast(e.schema["eid"].dataType).alias("eid"))
        .unionByName(own.select("k", "b", "t", "kind", "add", F.lit(None).cast(e.schema["eid"].dataType).alias("eid")))
        .unionByName(e.select("k", "b", "t", F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("add"), "eid"))
    )
    numbered = (
        narrow.withColumn("version", F.sum("add").over(local))
        .where((F.col("kind") == 2) & (F.col("version") > 0))
        .select("eid", "k", "b", "t", "version")
    )
    return (
        numbered.join(versions.where(F.col("version") > 0), ["k", "b", "version"])
        .select(F.col("eid").alias(event_id), F.col("k").alias(entity), F.col("t").alias(event_time), "version", *names)
    )
