"""As-of and band joins that never become nested loops, however hot a key is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.versions import BUCKET_S, attributes_at


def asof_backward(left: DataFrame, right: DataFrame, *, key: str, left_id: str, left_time: str, right_time: str, values: dict[str, Column], order: Column | None = None, bucket_s: int = BUCKET_S) -> DataFrame:
    """(left_id, key, left_time, *values): the values of the last right row at or before each left row.

    Times are bigint seconds. Of right rows at one time the largest (``order``, values) counts. Left rows before the
    first right row, and null keys and times, give no row. See attributes_at for hot keys.
    """
    tie = [] if order is None else [order.alias("__o")]
    latest = F.struct(F.col(right_time).alias("__t"), *tie, *[v.alias(n) for n, v in values.items()])
    joined = attributes_at(left, right, entity=key, event_id=left_id, event_time=left_time, change_time=right_time, running_max={"__latest": latest}, bucket_s=bucket_s)
    return joined.select(left_id, key, left_time, F.col("__latest.__t").alias(right_time), *[F.col(f"__latest.{n}").alias(n) for n in values])


def band_join(left: DataFrame, right: DataFrame, *, on: list[str], left_time: str, right_time: str, lo: int, hi: int, how: str = "inner") -> DataFrame:
    """left joined with the right rows of the same ``on`` whose time lies in [left_time + lo, left_time + hi].

    Times are bigint; names other than ``on`` must differ. Rows meet by time bucket as wide as the band, each left row in
    the one or two buckets its band touches, so the join is an equi-join whose work is bounded by
    the matches, with no key too. how: inner, left_semi or left_anti; the latter two need ``__row`` unique in left, which they
    keep. Null times match nothing.
    """
    if hi < lo:
        raise ValueError("the band is empty")
    width = max(1, hi - lo + 1)
    first, last = F.floor((F.col(left_time) + lo) / width), F.floor((F.col(left_time) + hi) / width)
    probes = left.where(F.col(left_time).isNotNull()).withColumn("__b", F.explode(F.sequence(first, last)))
    buckets = right.where(F.col(right_time).isNotNull()).withColumn("__b", F.floor(F.col(right_time) / width))
    within = F.col(right_time).between(F.col(left_time) + lo, F.col(left_time) + hi)
    if how == "inner":
        return probes.join(buckets, [*on, "__b"]).where(within).drop("__b")
    p, b = probes.alias("p"), buckets.alias("b")
    same = F.col("p.__b") == F.col("b.__b")
    for c in on:
        same &= F.col(f"p.{c}") == F.col(f"b.{c}")
    near = F.col(f"b.{right_time}").between(F.col(f"p.{left_time}") + lo, F.col(f"p.{left_time}") + hi)
    hit = p.join(b, same & near, "left_semi").select("__row").distinct()
    return left.join(hit, "__row", how)


def interval_lookup(points: DataFrame, intervals: DataFrame, *, on: str, time: str, start: str, end: str, point_id: str, values: dict[str, Column]) -> DataFrame:
    """(point_id, on, time, *values) of the interval that holds each point; intervals of one ``on`` mustn't overlap.

    The last interval begun is found as-of and kept if it hasn't ended: bounds are inclusive.
    """
    found = asof_backward(points, intervals, key=on, left_id=point_id, left_time=time, right_time=start, values={"__end": F.col(end), **values})
    return found.where(F.col(time) <= F.col("__end")).drop("__end")
