"""Writers assembled from their edits, where their names come from, and which one-off names belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators.band import band_join
from strandline.operators.stats import ordered_mode


def assemble(edits: DataFrame, *, name: str, scope: str, family: str, page: str, time: str, rev: str, flag: Column | None = None, floor: int = 2) -> DataFrame:
    """(name, n_in_scope, n_family, n_relay, n_elsewhere, n_pages, first, last, span_hours, families, primary_family, n_flagged) of writers with at least ``floor`` edits in scope.

    Scope is family, relay or other. first and last are those of the edits in scope; families is ``family:n;...`` by count and name; of families with
    equal counts the one seen first is primary. Rows without a name belong to nobody.
    """
    e = edits.where(F.col(name).isNotNull()).withColumn("__in", F.col(scope).isin("family", "relay"))
    flagged = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    base = e.groupBy(name).agg(
        F.count_if("__in").alias("n_in_scope"), F.count_if(F.col(scope) == "family").alias("n_family"), F.count_if(F.col(scope) == "relay").alias("n_relay"), F.count_if(~F.col("__in")).alias("n_elsewhere"),
        F.countDistinct(page).alias("n_pages"), F.min(F.when(F.col("__in"), F.col(time))).alias("first"), F.max(F.when(F.col("__in"), F.col(time))).alias("last"), F.count_if(flagged).alias("n_flagged"),
    ).where(F.col("n_in_scope") >= floor)
    inside = e.where(F.col("__in") & F.col(family).isNotNull())
    counts = inside.groupBy(name, family).agg(F.count(F.lit(1)).alias("n"))
    # As many entries as there are families.
    written = counts.groupBy(name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(family).alias("f"), "n"))), lambda s: F.concat(s["f"], F.lit(":"), s["n"])), ";").alias("families"))
    primary = ordered_mode(inside.withColumn("__at", F.struct(F.col(time), F.col(rev))), by=name, value=family, first="__at").select(name, F.col(family).alias("primary_family"))
    return base.join(written, name, "left").join(primary, name, "left").withColumn("span_hours", F.round((F.col("last") - F.col("first")) / 3600, 2))


def name_origin(names: DataFrame, *, name: str, signed: DataFrame, labels: DataFrame, titles: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, origin): the first place of signoff, label, page title and post text that holds each name, else coined.

    signed, labels: one column of names; titles, texts: one column of tokens. All are semi-joins on whole names, so no text is searched for every name.
    """
    out = names.select(F.col(name).alias("n")).where("n IS NOT NULL").distinct()
    for where, df in (("signoff", signed), ("label", labels), ("page title", titles), ("post text", texts)):
        held = df.select(F.col(df.columns[0]).alias("n")).distinct().withColumn(where, F.lit(where))
        out = out.join(held, "n", "left")
    return out.select(F.col("n").alias(name), F.coalesce("signoff", "label", "`page title`", "`post text`", F.lit("coined")).alias("origin"))


def containment(one_offs: DataFrame, targets: DataFrame, *, window_s: int = 86_400) -> DataFrame:
    """(rev, target): one-off edits whose name's words are a run of just one writer's name, or the other way round, with a date in common, in that writer's
    families where both are known, within ``window_s`` seconds of one of their edits.

    one_offs: (rev, name, family, t); targets: (target, name, family, t), a row per edit. Names meet by their date tags, an equi-join; the time is a band.
    """
    left = one_offs.select("rev", F.col("name").alias("one_name"), F.col("family").alias("one_family"), F.col("t").alias("t_left"), F.explode(tx.date_tags(F.col("name"))).alias("tag"))
    right = targets.select("target", F.col("name").alias("target_name"), F.col("family").alias("target_family"), F.col("t").alias("t_right"), F.explode(tx.date_tags(F.col("name"))).alias("tag"))
    near = band_join(left, right, on=["tag"], left_time="t_left", right_time="t_right", lo=-window_s, hi=window_s)
    a, b = tx.tokens_of(F.col("one_name")), tx.tokens_of(F.col("target_name"))
    fits = (tx.has_run(a, b) | tx.has_run(b, a)) & (F.col("one_family").isNull() | F.col("target_family").isNull() | (F.col("one_family") == F.col("target_family")))
    return near.where(fits).groupBy("rev").agg(F.min("target").alias("target"), F.max("target").alias("__m")).where("target = __m").select("rev", "target")


def shared_keys(rows: DataFrame, *, writer: str, key: list[str], most: int | None = None) -> DataFrame:
    """(writer_a, writer_b, n_keys), a < b: writers that hold the same exact keys. Keys of a single writer are dropped before the join.

    most: keys of more writers than that say nothing about two of them; they are left out only if this is given.
    """
    each = rows.select(F.col(writer).alias("w"), F.struct(*key).alias("k")).where(F.col("w").isNotNull()).distinct()
    held = each.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if most is not None:
        held = held.where(F.col("n") <= most)
    kept = each.join(held.select("k"), "k")
    a, b = kept.alias("a"), kept.alias("b")
    return a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.w") < F.col("b.w"))).groupBy(F.col("a.w").alias("writer_a"), F.col("b.w").alias("writer_b")).agg(F.count(F.lit(1)).alias("n_keys"))


def asked_revision(reads: DataFrame, revisions: DataFrame, *, read: str, page: str, asked: str, time: str, seq: str, saved: str) -> DataFrame:
    """(read, page, asked, how): reads that name a revision: asked if it exists and was saved by then, else unresolved. Others give no row."""
    number = F.expr(f"try_cast({asked} AS int)")
    r = reads.where(F.col(asked).rlike(r"^\d+$")).select(F.col(read).alias("r"), F.col(page).alias("p"), number.alias("q"), F.col(time).alias("t"))
    v = revisions.select(F.col(page).alias("p"), F.col(seq).alias("q"), F.col(saved).alias("s")).distinct()
    how = F.when(F.max((F.col("s") <= F.col("t")).cast("int")) == 1, "asked").otherwise("unresolved")
    return r.join(v, ["p", "q"], "left").groupBy("r", "p", "q").agg(how.alias("how")).select(F.col("r").alias(read), F.col("p").alias(page), F.col("q").alias("asked"), "how")


def conformity(posts: DataFrame, *, post: str, agent: str, page: str, time: str, variants: str, back_s: int, ahead_s: int) -> DataFrame:
    """(side, n_items, n_alike, n_nearest): whether posts use a variant that others' posts on the page show, in the past and in the future.

    The past is [t - back_s, t), the future (t, t + ahead_s]; posts of the same second and the agent's own never count. n_items: posts with variants that see some on that side;
    n_alike: those that share one with any of them; n_nearest: those that share one with the nearest. variants: an array column.
    """
    p = posts.where(F.size(variants) > 0).select(F.col(post).alias("i"), F.col(agent).alias("own"), F.col(page).alias("pg"), F.col(time).alias("t"), F.col(variants).alias("mine"))
    q = posts.where(F.size(variants) > 0).select(F.col(agent).alias("other"), F.col(page).alias("pg"), F.col(time).alias("u"), F.col(variants).alias("theirs"))
    near = band_join(p, q, on=["pg"], left_time="t", right_time="u", lo=-back_s, hi=ahead_s).where("own <> other AND t <> u")
    side = near.withColumn("side", F.when(F.col("u") < F.col("t"), "past").otherwise("future")).withColumn("alike", F.arrays_overlap("mine", "theirs").cast("int"))
    # Of equally near posts any alike counts.
    per = side.groupBy("side", "i").agg(F.max("alike").alias("alike"), F.min(F.struct(F.abs(F.col("t") - F.col("u")).alias("d"), (-F.col("alike")).alias("a"))).alias("nearest"))
    return per.groupBy("side").agg(F.count(F.lit(1)).alias("n_items"), F.sum("alike").alias("n_alike"), F.sum(-F.col("nearest.a")).alias("n_nearest"))


def name_conformity(posts: DataFrame, parts: DataFrame, *, post: str, agent: str, page: str, time: str, ahead_s: int = 43_200) -> DataFrame:
    """(part, side, agent, page, t, own, visible, nearest): each agent's name parts beside those of others who posted on its first page before, and in the ``ahead_s`` seconds after.

    parts: (agent, part, value), a row per part of a name. Agents who created their first page are left out, as there was nothing to copy. visible: the set of values of the others; nearest: the value of the nearest
    of them (of equally near ones the least). Others are taken once per agent, by their last post before and their first after, so a hot page costs as many rows as it has agents.
    """
    rows = posts.where(F.col(agent).isNotNull() & F.col(time).isNotNull()).select(F.col(post).alias("i"), F.col(agent).alias("a"), F.col(page).alias("pg"), F.col(time).alias("t"))
    first = rows.groupBy("a").agg(F.min(F.struct("t", "i", "pg")).alias("f")).select("a", F.col("f.t").alias("t"), F.col("f.pg").alias("pg"))
    made = rows.groupBy("pg").agg(F.min(F.struct("t", "i", "a")).alias("m")).select("pg", F.col("m.a").alias("maker"))
    own = first.join(made, "pg").where("a <> maker").drop("maker")
    others = rows.select("pg", F.col("a").alias("other"), F.col("t").alias("u"))
    met = own.join(others, "pg").where("other <> a AND u <> t").where(F.col("u") <= F.col("t") + ahead_s)
    side = F.when(F.col("u") < F.col("t"), "past").otherwise("future")
    near = met.groupBy("a", "pg", "t", side.alias("side"), "other").agg(F.min(F.abs(F.col("t") - F.col("u"))).alias("d"))
    named = parts.select(F.col(parts.columns[0]).alias("who"), "part", "value")
    valued = near.join(named.withColumnsRenamed({"who": "other", "value": "theirs"}), "other").join(named.withColumnsRenamed({"who": "a", "value": "own"}), ["a", "part"])
    out = valued.groupBy("part", "side", "a", "pg", "t", "own").agg(F.array_sort(F.collect_set("theirs")).alias("visible"), F.min(F.struct("d", "theirs")).alias("n"))
    return out.select("part", "side", F.col("a").alias(agent), F.col("pg").alias(page), "t", "own", "visible", F.col("n.theirs").alias("nearest"))


def tool_mix(requests: DataFrame, *, agent: str, tool: Column, time: str, request: str, gap_s: int = 1_800, least: int = 5) -> DataFrame:
    """(agent, tool, n, purity, n_sharing, n_sessions, same_share): each agent's dominant tool, its share, how many agents it dominates, and the share of the agent's sessions of ``least`` requests or more with the same one.

    Of equally frequent tools the one used first counts. same_share is null with under two such sessions.
    """
    from strandline.operators.band import interval_lookup
    from strandline.operators.sessions import sessionize

    r = requests.where(F.col(agent).isNotNull() & F.col(time).isNotNull()).select(F.col(agent).alias("a"), tool.alias("tool"), F.col(time).alias("t"), F.col(request).alias("i")).withColumn("at", F.struct("t", "i"))
    dominant = ordered_mode(r, by="a", value="tool", first="at").withColumnsRenamed({"n": "n_top"})
    total = r.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    sharing = dominant.groupBy("tool").agg(F.count(F.lit(1)).alias("n_sharing"))
    sessions = sessionize(r, key="a", time="t", gap_s=gap_s)
    placed = interval_lookup(r, sessions.where(F.col("n_events") >= least), on="a", time="t", start="start_s", end="end_s", point_id="i", values={"session_no": F.col("session_no")}).select("i", "session_no")
    in_session = r.join(placed, "i").withColumn("k", F.struct("a", "session_no"))
    tops = ordered_mode(in_session, by="k", value="tool", first="at").select("k.a", F.col("tool").alias("session_tool"))
    same = tops.join(dominant.select("a", "tool"), "a").groupBy("a").agg(F.count(F.lit(1)).alias("n_sessions"), F.avg((F.col("session_tool") == F.col("tool")).cast("int")).alias("s"))
    out = dominant.join(total, "a").join(sharing, "tool").join(same, "a", "left")
    return out.select(F.col("a").alias(agent), "tool", "n", "purity", "n_sharing", F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"), F.when(F.col("n_sessions") >= 2, F.col("s")).alias("same_share"))
