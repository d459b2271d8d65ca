"""Peaks and running sets inside sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Seconds of a time bucket: the unit by which a hot key is split.
BUCKET_S = 86_400


def _in_buckets(points: DataFrame, time: str, span_s: int) -> DataFrame:
    """points with ``__b``, their time bucket, and once more with ``__own`` false in the next one if they lie within ``span_s`` of it: a window over (key, bucket) then sees all that a point's span holds."""
    width = max(BUCKET_S, span_s)
    b = F.floor(F.col(time) / width)
    late = F.col(time) > (b + 1) * width - span_s
    places = F.when(late, F.array(F.struct(b.alias("__b"), F.lit(True).alias("__own")), F.struct((b + 1).alias("__b"), F.lit(False).alias("__own")))).otherwise(F.array(F.struct(b.alias("__b"), F.lit(True).alias("__own"))))
    return points.select("*", F.inline(places))


def peak_count(events: DataFrame, *, by: list[str], time: str, span_s: int) -> DataFrame:
    """(*by, peak): the most events of a group in any ``span_s`` seconds. Times are bigint seconds.

    Equal times are counted first, so that the frame runs over seconds and not over rows; a group's seconds are split by time buckets.
    """
    points = events.where(F.col(time).isNotNull()).groupBy(*by, time).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by, "__b").orderBy(time).rangeBetween(-(span_s - 1), 0)
    return _in_buckets(points, time, span_s).withColumn("n", F.sum("n").over(w)).where("__own").groupBy(*by).agg(F.max("n").alias("peak"))


def peak_distinct(events: DataFrame, *, by: list[str], time: str, value: str, span_s: int) -> DataFrame:
    """(*by, peak): the most different values of a group in any ``span_s`` seconds; nulls are left out."""
    points = events.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(*by, time, value).distinct()
    w = Window.partitionBy(*by, "__b").orderBy(time).rangeBetween(-(span_s - 1), 0)
    return _in_buckets(points, time, span_s).withColumn("n", F.size(F.collect_set(value).over(w))).where("__own").groupBy(*by).agg(F.max("n").alias("peak"))


def switches(events: DataFrame, *, agent: str, time: str, tie: str, value: str) -> DataFrame:
    """(agent, n_events, n_switches, n_new): how often an agent's value differs from its last one, and how often it is one it never used.

    First uses are an aggregate. Rows are put in order within the agent's time buckets only; a bucket's first row gets the last value of the buckets before.
    """
    rows = events.where(F.col(value).isNotNull() & F.col(time).isNotNull()).withColumn("__b", F.floor(F.col(time) / BUCKET_S))
    ends = rows.groupBy(agent, "__b").agg(F.max(F.struct(F.col(time).alias("t"), F.col(tie).alias("i"), F.col(value).alias("v"))).alias("__e"))
    before = Window.partitionBy(agent).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(agent, "__b", F.max("__e").over(before)["v"].alias("__carried"))
    order = Window.partitionBy(agent, "__b").orderBy(time, tie)
    last = F.coalesce("__last", "__carried")
    changed = rows.withColumn("__last", F.lag(value).over(order)).join(carry, [agent, "__b"]).groupBy(agent).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(last.isNotNull() & (last != F.col(value))).alias("n_switches"))
    new = rows.groupBy(agent).agg((F.countDistinct(value) - 1).alias("n_new"))
    return changed.join(new, agent)


def variant_switches(posts: DataFrame, *, post: str, agent: str, page: str, time: str, variants: str, window_s: int = 43_200) -> DataFrame:
    """One row of eight counts: turns of agents to a variant they had not used, by what others' posts on the page show in the ``window_s`` seconds before and after.

    events; visible_before: the new variant stood there; visible_after_prior_users: it stands there afterwards, from agents who had used it before the turn; visible_after_any_author;
    any_post_before, any_post_after; any_variant_post_before, any_variant_post_after. Posts of the same second and the agent's own never count. A turn needs an earlier
    post of the agent with some variant, so it is found by first uses, which are aggregates: no agent's posts are put in order.
    """
    from strandline.operators.band import band_join

    rows = posts.select(F.col(post).alias("i"), F.col(agent).alias("a"), F.col(page).alias("pg"), F.col(time).alias("t"), F.col(variants).alias("vs")).where("a IS NOT NULL AND t IS NOT NULL")
    used = rows.select("i", "a", "pg", "t", F.explode("vs").alias("v"))
    first = used.groupBy("a", "v").agg(F.min(F.struct("t", "i", "pg")).alias("f"))
    begun = used.groupBy("a").agg(F.min(F.struct("t", "i")).alias("b"))
    turns = first.join(begun, "a").where(F.struct("f.t", "f.i") > F.col("b")).select(F.concat_ws("\x1f", "a", "v").alias("e"), F.col("a").alias("own"), F.col("v").alias("new"), F.col("f.pg").alias("pg"), F.col("f.t").alias("t"))
    near = band_join(turns, rows.select("pg", F.col("a").alias("other"), F.col("t").alias("u"), "vs"), on=["pg"], left_time="t", right_time="u", lo=-window_s, hi=window_s).where("other <> own AND u <> t")
    near = near.join(first.select(F.col("a").alias("other"), F.col("v").alias("new"), F.col("f.t").alias("since")), ["other", "new"], "left")
    before, shows, some = F.col("u") < F.col("t"), F.array_contains("vs", F.col("new")), F.size("vs") > 0
    flags = {"visible_before": before & shows, "visible_after_prior_users": ~before & shows & (F.col("since") < F.col("t")), "visible_after_any_author": ~before & shows, "any_post_before": before, "any_post_after": ~before, "any_variant_post_before": before & some, "any_variant_post_after": ~before & some}
    per = near.groupBy("e").agg(*[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in flags.items()])
    return turns.join(per, "e", "left").agg(F.count(F.lit(1)).alias("events"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in flags])


def ranked(df: DataFrame, order: Column, tie: str) -> DataFrame:
    """df with ``rank`` from 1 by ``order`` (a hash), then ``tie``: rows are numbered within buckets of the hash and buckets carried over, so nothing is sorted in one task."""
    rows = df.withColumn("__h", order).withColumn("__b", F.shiftright("__h", 54))
    sums = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))  # at most 1,024 rows
    carry = sums.select("__b", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__c"))
    return rows.join(F.broadcast(carry), "__b").withColumn("rank", F.col("__c") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", tie))).drop("__h", "__b", "__c")


def dealt_trait(traits: DataFrame, *, agent: str, trait: str, reps: int, seed: int = 7) -> DataFrame:
    """(rep, agent, trait): the agents' traits dealt anew among all of them, ``reps`` times: a trait of the same spread that hangs on nothing. Two rankings by keyed hashes meet by rank."""
    each = traits.select(F.col(agent).alias("a"), F.col(trait).alias("v")).where("a IS NOT NULL AND v IS NOT NULL")
    out = None
    for rep in range(1, reps + 1):
        to, source = (ranked(each, F.xxhash64(F.lit(seed), F.lit(rep), F.lit(side), "a"), "a") for side in (0, 1))
        one = to.select("rank", "a").join(source.select("rank", "v"), "rank").select(F.lit(rep).alias("rep"), F.col("a").alias(agent), F.col("v").alias(trait))
        out = one if out is None else out.unionByName(one)
    return out
