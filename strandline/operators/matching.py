"""Joins with a condition on how many rows match, and pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_match(left: DataFrame, right: DataFrame, *, on: list[str], left_id: str, right_id: str, condition: Column | None = None) -> DataFrame:
    """(left_id, right_id) of each left row that matches exactly one right id; the names of both sides other than ``on`` must differ."""
    joined = left.join(right, on)
    if condition is not None:
        joined = joined.where(condition)
    return joined.groupBy(left_id).agg(F.min(right_id).alias(right_id), F.max(right_id).alias("__max")).where(F.col(right_id) == F.col("__max")).drop("__max")


def multi_holders(df: DataFrame, *, item: str, owner: str) -> DataFrame:
    """(item, n_owners) of items that more than one owner holds."""
    return df.where(F.col(item).isNotNull()).groupBy(item).agg(F.countDistinct(owner).alias("n_owners")).where(F.col("n_owners") > 1)


def any_match(left: DataFrame, right: DataFrame, *, on: str, agrees: Column) -> DataFrame:
    """left with ``status``: unmatched, agree (some right row does) or differ."""
    hits = left.join(right, on).groupBy(on).agg(F.max(agrees.cast("int")).alias("__hit"))
    status = F.when(F.col("__hit").isNull(), "unmatched").when(F.col("__hit") == 1, "agree").otherwise("differ")
    return left.join(hits, on, "left").withColumn("status", status).drop("__hit")


def latest_fields(log: DataFrame, *, key: str, time: str, seq: str, fields: list[str], cleared: Column) -> DataFrame:
    """(key, *fields): an append-only log folded to its state.

    The last writer wins for each field; an event for which ``cleared`` holds empties all fields set before it. Each field is one
    aggregate (max_by over (time, seq)), so the log is combined before it is shuffled and a long history is never collected.
    """
    at = F.struct(F.col(time).alias("t"), F.col(seq).alias("q"))
    wiped = log.groupBy(key).agg(F.max(F.when(cleared, at)).alias("__wiped"))
    live = log.join(wiped, key, "left").where(F.col("__wiped").isNull() | (at > F.col("__wiped")))
    state = live.groupBy(key).agg(*[F.max(F.when(F.col(f).isNotNull(), F.struct(at.alias("at"), F.col(f).alias("v")))).alias(f) for f in fields])
    return log.select(key).distinct().join(state, key, "left").select(key, *[F.col(f"{f}.v").alias(f) for f in fields])


#: Of the calls on the posts of one edit, the first of these that any post has counts.
PRECEDENCE = ("confirm", "reassign", "unsure", "reject")


def folded_verdicts(log: DataFrame, *, target: str, owner: str) -> DataFrame:
    """(target, verdict, assign_to, verdict_from, tags, notes): the state of each target after an append-only log.

    log: (target, owner, post, at, seq, verdict, assign_to, tags array, note); ``post`` names a part of the target, null the whole; null fields are not set by an event.
    Last writer wins; ``clear`` empties a verdict. An event on a post makes the verdict anew from the posts' calls, by PRECEDENCE and the latest of equal ones, where a reassignment to the
    target's own owner counts as a confirmation; a later verdict on the whole overrides that. tags: of the whole, or the union over posts if any post set some; notes: all, in order. verdict_from: edit or posts.
    """
    at = F.struct("at", "seq")
    none = F.array().cast("array<string>")
    last = lambda c, when=F.lit(True): F.max(F.when(F.col(c).isNotNull() & when, F.struct(at.alias("at"), F.col(c).alias("v"))))
    each = log.where(F.col("post").isNotNull()).groupBy(target, "post").agg(F.max(owner).alias("__owner"), last("verdict").alias("v"), last("assign_to").alias("a"), last("tags").alias("g"), F.max(at).alias("last_at"))
    said = F.when(F.col("v.v") == "clear", None).when((F.col("v.v") == "reassign") & (F.col("a.v").isNull() | (F.col("a.v") == F.col("__owner"))), "confirm").otherwise(F.col("v.v"))
    each = each.withColumn("said", said)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("said")), F.lit(0))
    best = F.when(F.col("said").isNotNull(), F.struct((-F.when(rank == 0, 99).otherwise(rank)).alias("r"), F.col("v.at").alias("at"), F.col("said").alias("said"), F.col("a.v").alias("to")))
    posts = each.groupBy(target).agg(F.max(best).alias("best"), F.max("last_at").alias("last_post"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col("g.v"))))).alias("post_tags"), F.max(F.col("g").isNotNull().cast("int")).alias("tagged"))
    whole = log.join(posts.select(target, "last_post"), target, "left")
    later = F.col("last_post").isNull() | (at > F.col("last_post"))
    mine = F.col("post").isNull()
    edits = whole.groupBy(target).agg(last("verdict", mine & later).alias("v"), last("assign_to", mine & later).alias("a"), last("tags", mine).alias("g"), F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("at", "seq", "note")))).alias("n"))
    j = edits.join(posts, target, "left")
    by_edit = F.col("v").isNotNull()
    verdict = F.when(by_edit, F.nullif(F.col("v.v"), F.lit("clear"))).otherwise(F.col("best.said"))
    assign = F.coalesce(F.col("a.v"), F.when(~by_edit & (F.col("best.said") == "reassign"), F.col("best.to")))
    return j.select(
        target, verdict.alias("verdict"), assign.alias("assign_to"), F.when(verdict.isNotNull(), F.when(by_edit, "edit").otherwise("posts")).alias("verdict_from"),
        F.coalesce(F.when(F.col("tagged") == 1, F.col("post_tags")), F.col("g.v"), none).alias("tags"), F.transform("n", lambda x: x["note"]).alias("notes"))


def merged_claims(posts: DataFrame, *, edit: str, writer: str, section: str, ranks: list[str], rules: str, place: str) -> DataFrame:
    """(edit, writer, section, rules, n_posts): what each writer claims in an edit: the strongest section of its posts there, by ``ranks``, and all their rules in the order of the posts, each once."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ranks)), F.col(section)), F.lit(0)), F.lit(99))
    both = posts.groupBy(edit, writer).agg(F.min(F.struct(rank.alias("r"), F.col(place).alias("p"), F.col(section).alias("s"))).alias("lead"), F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(rules).alias("x")))).alias("all"), F.count(F.lit(1)).alias("n_posts"))
    return both.select(edit, writer, F.col("lead.s").alias(section), F.array_distinct(F.flatten(F.transform("all", lambda y: F.coalesce(y["x"], F.array().cast("array<string>"))))).alias(rules), "n_posts")


def reconciled(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(check_name, recomputed, stored, equal): a one-row table of aggregates compared pair by pair."""
    row = df.agg(*[c.cast("double").alias(f"{n}__{i}") for n, pair in checks.items() for i, c in enumerate(pair)])
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"{n}__0").alias("recomputed"), F.col(f"{n}__1").alias("stored")) for n in checks])
    return row.select(F.explode(pairs).alias("p")).select("p.*", F.expr("p.recomputed <=> p.stored").alias("equal"))


def enforced(checks: DataFrame) -> DataFrame:
    """The checks of ``reconciled``; raises when the plan runs if any pair differs."""
    return checks.where(F.assert_true(F.col("equal"), F.concat(F.lit("doesn't reconcile: "), F.col("check_name"))).isNull())
