"""Sessions separated by inactivity, by a sweep line.

Every event puts +1 at its time and -1 at its time plus the gap. Read in time
order, additions before removals at equal times, the running sum falls to zero
exactly where a session has been inactive for longer than the gap. Sums are first
taken by (key, time bucket) with map-side combine; a window over a key's buckets
carries them over, so that a key with a third of all rows is worked on by as many
tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_S = 1_800
BUCKET_S = 86_400


def sessionize(events: DataFrame, *, key: str, time: str, gap_s: int = GAP_S, weight: Column | None = None, bucket_s: int = BUCKET_S) -> DataFrame:
    """(key, session_no, start_s, end_s, duration_s, n_events): one row per session.

    events: ``key`` (any orderable type) and ``time`` (bigint seconds). Two neighbouring
    events of a key belong to one session if they are at most ``gap_s`` apart (exactly
    ``gap_s`` is together). ``weight`` is how many events a row stands for (1). session_no
    counts from 1 within the key. Rows with a null key or time belong to no session;
    equal times are one point with their weights added; an empty table gives no rows;
    columns other than the named ones are ignored.
    """
    w = F.lit(1) if weight is None else weight
    each = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("k"), F.col(time).cast("bigint").alias("t"), w.cast("bigint").alias("n"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    deltas = each.select(
        "k",
        F.explode(
            F.array(
                F.struct(F.col("t").alias("t"), one.alias("up"), zero.alias("down"), F.col("n").alias("n")),
                F.struct((F.col("t") + gap_s).alias("t"), zero.alias("up"), one.alias("down"), zero.alias("n")),
            )
        ).alias("d"),
    ).select("k", F.floor(F.col("d.t") / bucket_s).alias("b"), "d.*")
    # Rows meet by (key, bucket) once; the sums by time, the join with what is carried over and the sweep all keep that partitioning.
    # However many events a key has at one time, they open it once.
    steps = deltas.repartition("k", "b").groupBy("k", "b", "t").agg(F.max("up").alias("up"), F.max("down").alias("down"), F.sum("n").alias("n"))

    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.groupBy("k", "b").agg(F.sum(F.col("up") - F.col("down")).alias("open"), F.sum("n").alias("n"))
    carry = sums.select("k", "b", F.coalesce(F.sum("open").over(before), zero).alias("open"), F.coalesce(F.sum("n").over(before), zero).alias("n_open"))

    local = Window.partitionBy("k", "b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.join(carry, ["k", "b"]).select(
        "k", "t", "up", "down", "n",
        (F.col("open") + F.sum(F.col("up") - F.col("down")).over(local)).alias("after"),
        (F.col("n_open") + F.sum("n").over(local)).alias("n_after"),
    )
    # A session starts where the sum was zero before an addition, and closes where it is zero afterwards.
    edges = swept.select(
        "k", "t", "n_after",
        ((F.col("up") > 0) & (F.col("after") - F.col("up") + F.col("down") == 0)).alias("starts"),
        (F.col("after") == 0).alias("closes"),
        (F.col("n_after") - F.col("n")).alias("n_before"),
    ).where(F.col("starts") | F.col("closes"))
    # Edges of a key alternate: start, close, start, close ...; their number is bounded by the time span over the gap.
    order = Window.partitionBy("k").orderBy("t")
    paired = edges.select("k", "t", "starts", "n_before", F.lead("t").over(order).alias("closed"), F.lead("n_after").over(order).alias("n_closed"))
    sessions = paired.where("starts")
    end = F.col("closed") - gap_s
    return sessions.select(
        F.col("k").alias(key),
        F.row_number().over(order).cast("bigint").alias("session_no"),
        F.col("t").alias("start_s"),
        end.alias("end_s"),
        (end - F.col("t")).alias("duration_s"),
        (F.col("n_closed") - F.col("n_before")).alias("n_events"),
    )
