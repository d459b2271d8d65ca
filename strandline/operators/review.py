"""Review calls on assignments: each changes who an edit is placed with, in a fixed order.

assignments: (rev, name, time, label). calls: (call_no, decision, name, target, revs array). The order of the decisions is part
of their meaning: attribute, reassign, exclude, merge, then split and partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.lineage import durable

DECISIONS = ("attribute", "reassign", "exclude", "merge", "split", "partition", "keep", "not_alias")


def problems(calls: DataFrame, assignments: DataFrame) -> DataFrame:
    """(call_no, problem): calls that mustn't be applied. An empty result means that all may be."""
    known = assignments.select("name").distinct().withColumn("known", F.lit(True))
    c = calls.join(known, "name", "left")
    listed = calls.where(F.size("revs") > 0).select("call_no", F.explode("revs").alias("rev"))
    held_twice = calls.where(F.col("decision").isin("split", "partition", "reassign", "exclude", "attribute")).select("call_no", "name", F.explode("revs").alias("rev")).groupBy("rev").agg(F.countDistinct("call_no").alias("n"), F.min("call_no").alias("call_no")).where("n > 1")
    missing = listed.join(assignments.select("rev").distinct(), "rev", "left_anti").join(calls.select("call_no", "decision"), "call_no").where("decision <> 'attribute'")
    needs_target = F.col("decision").isin("merge", "reassign", "attribute") & (F.coalesce(F.col("target"), F.lit("")) == "")
    bad = [
        c.where(~F.col("decision").isin(*DECISIONS)).select("call_no", F.lit("unknown decision").alias("problem")),
        c.where(needs_target).select("call_no", F.lit("no target").alias("problem")),
        c.where((F.col("decision") == "merge") & (F.col("name") == F.col("target"))).select("call_no", F.lit("merge into itself").alias("problem")),
        c.where(F.col("known").isNull() & (F.col("decision") != "attribute")).select("call_no", F.lit("unknown name").alias("problem")),
        held_twice.select("call_no", F.lit("revision in two calls").alias("problem")),
        missing.select("call_no", F.lit("unknown revision").alias("problem")).distinct(),
    ]
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    return out


def _of(calls: DataFrame, decision: str) -> DataFrame:
    return calls.where(F.col("decision") == decision)


#: Merges in a row: each round doubles how many are followed.
MERGE_ROUNDS = 8


def _followed(merged: DataFrame) -> DataFrame:
    """(name, to): merges with those of their targets followed, a to b to c as a to c. Raises if they go round in a circle."""
    merged = durable(merged)
    for _ in range(MERGE_ROUNDS):
        further = merged.select(F.col("name").alias("to"), F.col("to").alias("next"))
        stepped = durable(merged.join(further, "to", "left").select("name", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if not stepped.where("moved").take(1):
            return stepped.select("name", "to")
        merged = durable(stepped.select("name", "to"))
    raise ValueError("merges go round in a circle")


def apply_calls(assignments: DataFrame, calls: DataFrame, unsigned: DataFrame | None = None, split: bool = True) -> DataFrame:
    """(rev, name, part, signed_as, time, label) after all calls; signed_as keeps the name a moved edit had. split: False leaves splits and partitions to split_parts.

    Unsigned edits (rev, time, label) may be attributed; an edit already assigned can't be. A split cuts a writer's edits, in time order,
    before each listed revision; a partition puts the listed revisions into a part of their own and drops nothing.
    """
    a = assignments.select("rev", "name", "time", "label", F.lit(None).cast("string").alias("signed_as"))
    if unsigned is not None:
        given = _of(calls, "attribute").select("target", F.explode("revs").alias("rev"))
        free = unsigned.join(assignments.select("rev"), "rev", "left_anti").join(given, "rev")
        a = a.unionByName(free.select("rev", F.col("target").alias("name"), "time", "label", F.lit(None).cast("string").alias("signed_as")))
    moved = _of(calls, "reassign").select(F.col("target").alias("to"), F.explode("revs").alias("rev"))
    a = a.join(moved, "rev", "left").select("rev", F.coalesce("to", "name").alias("name"), "time", "label", F.when(F.col("to").isNotNull(), F.col("name")).otherwise(F.col("signed_as")).alias("signed_as"))
    out = _of(calls, "exclude").select(F.explode("revs").alias("rev")).distinct()
    a = a.join(out, "rev", "left_anti")
    merged = _followed(_of(calls, "merge").groupBy("name").agg(F.min("target").alias("to")))
    a = a.join(merged, "name", "left").select("rev", F.coalesce("to", "name").alias("name"), "time", "label", F.when(F.col("to").isNotNull(), F.coalesce("signed_as", "name")).otherwise(F.col("signed_as")).alias("signed_as"))
    return split_parts(a, calls) if split else a


def split_parts(a: DataFrame, calls: DataFrame) -> DataFrame:
    """(rev, name, part, signed_as, time, label): parts of each writer's edits, from 1.

    Cuts and partitions concern few writers: only theirs are put in order; all others' edits are part 1 as they are.
    """
    touched = calls.where(F.col("decision").isin("split", "partition")).select("name").distinct()
    whole = a.join(touched, "name", "left_anti").select("rev", "name", F.lit(1).cast("bigint").alias("part"), "signed_as", "time", "label")
    a = a.join(touched, "name", "left_semi")
    cuts = _of(calls, "split").select("name", F.explode("revs").alias("rev"), F.lit(1).alias("cut")).distinct()
    order = Window.partitionBy("name").orderBy("time", "rev")
    a = a.join(cuts, ["name", "rev"], "left").withColumn("first", F.row_number().over(order) == 1)
    # A cut before the first edit opens no empty part.
    part = F.coalesce(F.sum(F.when(F.col("first"), 0).otherwise(F.coalesce("cut", F.lit(0)))).over(order), F.lit(0)) + 1
    a = a.withColumn("part", part)
    apart = _of(calls, "partition").select("name", "call_no", F.explode("revs").alias("rev"))
    a = a.join(apart, ["name", "rev"], "left")
    last = F.max("part").over(Window.partitionBy("name"))
    own = F.dense_rank().over(Window.partitionBy("name").orderBy(F.col("call_no").asc_nulls_first()))
    base = F.max(F.when(F.col("call_no").isNull(), 1).otherwise(0)).over(Window.partitionBy("name"))
    a = a.withColumn("part", F.when(F.col("call_no").isNull(), F.col("part")).otherwise(last + own - base))
    return whole.unionByName(a.select("rev", "name", F.col("part").cast("bigint").alias("part"), "signed_as", "time", "label"))


def already_by_rule(calls: DataFrame, ruled: DataFrame) -> DataFrame:
    """(call_no, rev): attributions that a rule form gives by itself. ruled: (rev, name)."""
    given = _of(calls, "attribute").select("call_no", F.col("target").alias("name"), F.explode("revs").alias("rev"))
    return given.join(ruled.select("rev", "name"), ["rev", "name"], "left_semi").select("call_no", "rev")


def expanded_proposals(proposals: DataFrame, assignments: DataFrame) -> DataFrame:
    """(call_no, name, rev) of pending proposals, a row per revision: those that give a whole writer (``source``) stand for all revisions that writer holds."""
    one = proposals.where("rev IS NOT NULL").select("call_no", "name", "rev")
    whole = proposals.where("rev IS NULL AND source IS NOT NULL").select("call_no", "name", F.col("source").alias("__s"))
    return one.unionByName(whole.join(assignments.select(F.col("name").alias("__s"), "rev"), "__s").select("call_no", "name", "rev"))


def proposal_conflicts(proposals: DataFrame, assignments: DataFrame) -> DataFrame:
    """(rev, n_names): revisions that pending proposals give to different names; an empty result means that all may be applied."""
    return expanded_proposals(proposals, assignments).groupBy("rev").agg(F.countDistinct("name").alias("n_names")).where("n_names > 1")


def apply_proposals(assignments: DataFrame, proposals: DataFrame, unsigned: DataFrame | None = None, reviewed: DataFrame | None = None) -> DataFrame:
    """(rev, name, signed_as, time, label, proposed): assignments with each proposed edit at its proposed writer, marked; a moved edit keeps its name in signed_as.

    proposals: (call_no, name, rev, source), see expanded_proposals; reviewed: (rev) that a review has placed, which stay; so do edits the writer already holds. An unsigned edit (rev, time, label) is
    placed; other revisions that nobody holds are ignored. Raises when the plan runs if a revision is given to two names.
    """
    rows = expanded_proposals(proposals, assignments).groupBy("rev").agg(F.min(F.struct("call_no", "name")).alias("c"), F.countDistinct("name").alias("n"))
    rows = rows.where(F.assert_true(F.col("n") == 1, F.lit("a revision is proposed to two names")).isNull()).select("rev", F.col("c.name").alias("to"))
    if reviewed is not None:
        rows = rows.join(reviewed.select("rev").distinct(), "rev", "left_anti")
    joined = assignments.join(rows, "rev", "left")
    moves = F.col("to").isNotNull() & (F.col("to") != F.col("name"))
    held = joined.select("rev", F.when(moves, F.col("to")).otherwise(F.col("name")).alias("name"), F.when(moves, F.coalesce("signed_as", "name")).otherwise(F.col("signed_as")).alias("signed_as"), "time", "label", F.coalesce(moves, F.lit(False)).alias("proposed"))
    if unsigned is None:
        return held
    free = unsigned.join(assignments.select("rev"), "rev", "left_anti").join(rows, "rev").select("rev", F.col("to").alias("name"), F.lit(None).cast("string").alias("signed_as"), "time", "label", F.lit(True).alias("proposed"))
    return held.unionByName(free)


def placement(assignments: DataFrame, calls: DataFrame, *, unsigned: DataFrame | None = None, proposals: DataFrame | None = None, families: DataFrame | None = None, alias_s: int = 600, containment_s: int = 86_400, floor: int = 2) -> DataFrame:
    """(rev, name, part, signed_as, how): every edit with the writer it ends up with: calls, proposals, aliases, containment, splits, and the floor, in this order.

    assignments: (rev, name, time, label, page_key); families: (rev, family). A writer with under ``floor`` edits after proposals is a one-off; its edits go to the only writer of
    the same alias key, page and label within ``alias_s`` seconds, else to the only one whose name its words contain (see containment). how: signed, proposed, alias, containment, or one_off for
    writers that still have fewer edits than the floor.
    """
    from strandline.operators.trajectories import containment

    pages = assignments.select("rev", "page_key")
    if unsigned is not None and "page_key" in unsigned.columns:
        pages = pages.unionByName(unsigned.select("rev", "page_key"))
    a = apply_calls(assignments, calls, unsigned, split=False)
    reviewed = calls.where(F.col("decision").isin("attribute", "reassign")).select(F.explode("revs").alias("rev"))
    a = apply_proposals(a, proposals, unsigned, reviewed) if proposals is not None else a.withColumn("proposed", F.lit(False))
    a = a.join(pages, "rev", "left")
    if families is not None:
        a = a.join(families.select("rev", "family"), "rev", "left")
    else:
        a = a.withColumn("family", F.lit(None).cast("string"))
    a = durable(a)

    def sided(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        n = df.groupBy("name").agg(F.count(F.lit(1)).alias("__n"))
        both = df.join(n, "name").withColumn("t", F.col("time").cast("bigint"))
        return both.where(F.col("__n") < floor), both.where(F.col("__n") >= floor)

    few, many = sided(a)
    by_alias = placeable(few.select("rev", "name", "page_key", "label", "t"), many.select(F.col("name").alias("target"), "name", "page_key", "label", "t"), window_s=alias_s)
    a = a.join(by_alias, "rev", "left").select("rev", F.coalesce("target", "name").alias("name"), F.when(F.col("target").isNotNull(), F.coalesce("signed_as", "name")).otherwise(F.col("signed_as")).alias("signed_as"), "time", "label", "page_key", "family", F.when(F.col("target").isNotNull(), "alias").when(F.col("proposed"), "proposed").otherwise("signed").alias("how"))
    a = durable(a)
    few, many = sided(a)
    inside = containment(few.select("rev", "name", "family", "t"), many.select(F.col("name").alias("target"), "name", "family", "t"), window_s=containment_s)
    a = a.join(inside, "rev", "left").select("rev", F.coalesce("target", "name").alias("name"), F.when(F.col("target").isNotNull(), F.coalesce("signed_as", "name")).otherwise(F.col("signed_as")).alias("signed_as"), "time", "label", F.when(F.col("target").isNotNull(), "containment").otherwise(F.col("how")).alias("how"))
    a = durable(a)
    parts = split_parts(a.select("rev", "name", "signed_as", "time", "label"), calls).join(a.select("rev", "how"), "rev")
    n = parts.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return parts.join(n, "name").select("rev", "name", "part", "signed_as", F.when(F.col("n") < floor, "one_off").otherwise(F.col("how")).alias("how"))


def alias_candidates(names: DataFrame, *, name: str, not_alias: DataFrame | None = None) -> DataFrame:
    """(name_a, name_b): names of one alias key, equal but for case or just one of them dated; pairs in not_alias are left out."""
    from strandline.functions import text as tx

    n = names.select(F.col(name).alias("n")).where(F.col("n").isNotNull() & ~tx.is_generic(F.col("n"))).distinct()
    n = n.withColumn("k", tx.alias_key(F.col("n"))).withColumn("dated", F.size(tx.date_tags(F.col("n"))) > 0)
    x, y = n.alias("x"), n.alias("y")
    pairs = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.n") < F.col("y.n"))).where((F.lower("x.n") == F.lower("y.n")) | (F.col("x.dated") != F.col("y.dated")))
    pairs = pairs.select(F.col("x.n").alias("name_a"), F.col("y.n").alias("name_b"))
    if not_alias is not None:
        pairs = pairs.join(not_alias.select(F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b")).distinct(), ["name_a", "name_b"], "left_anti")
    return pairs


def placeable(one_offs: DataFrame, targets: DataFrame, *, window_s: int = 600) -> DataFrame:
    """(rev, target): one-off edits that belong to exactly one writer of the same alias key, page and label within ``window_s`` seconds.

    one_offs: (rev, name, page_key, label, t); targets: (target, name, page_key, label, t), a row per edit.
    """
    from strandline.functions import text as tx
    from strandline.operators.band import band_join

    left = one_offs.where(~tx.is_generic(F.col("name"))).select("rev", "page_key", "label", F.col("t").alias("t_left"), tx.alias_key(F.col("name")).alias("k"))
    right = targets.where(~tx.is_generic(F.col("name"))).select("target", "page_key", "label", F.col("t").alias("t_right"), tx.alias_key(F.col("name")).alias("k"))
    near = band_join(left, right, on=["k", "page_key", "label"], left_time="t_left", right_time="t_right", lo=-window_s, hi=window_s)
    return near.groupBy("rev").agg(F.min("target").alias("target"), F.max("target").alias("__m")).where("target = __m").select("rev", "target")
