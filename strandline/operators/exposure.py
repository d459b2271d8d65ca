"""Sessions with evidence of who was behind them, and what they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import is_generic
from strandline.operators.band import asof_backward, interval_lookup
from strandline.operators.lineage import durable
from strandline.operators.sessions import GAP_S, sessionize


def evidence_kind(owns: Column, owned: Column, generic: Column, n_users: Column) -> Column:
    """What a session's name is to the writer who saved under it: own, borrowed, generic, shared or private."""
    return F.when(owns, "own").when(owned, "borrowed").when(generic, "generic").when(n_users > 1, "shared").otherwise("private")


def session_tier(strong: Column, weak: Column, exclusive: Column) -> Column:
    """strong, weak: arrays of writers; exclusive: the only writer of the name near the session, or null."""
    extra = F.size(F.array_except(weak, strong))
    return (
        F.when((F.size(strong) == 1) & (extra == 0), "session").when((F.size(strong) > 1) | ((F.size(strong) == 1) & (extra > 0)), "ambiguous")
        .when(F.size(weak) > 0, "weak").when(exclusive.isNotNull(), "exclusive").otherwise("none")
    )


def evidence_basis(kinds: Column) -> Column:
    """own, private2, private1 or exclusive, from ``kind:n;kind:n``."""
    m = F.str_to_map(kinds, F.lit(";"), F.lit(":"))
    count = lambda k: F.coalesce(F.try_element_at(m, F.lit(k)).cast("int"), F.lit(0))
    return F.when(count("own") > 0, "own").when(count("private") >= 2, "private2").when(count("private") == 1, "private1").otherwise("exclusive")


def read_before(uses: DataFrame, reads: DataFrame, *, agent: str, page: str, lag_s: int = 0) -> DataFrame:
    """uses with ``how``: confirmed (the agent read the page at least ``lag_s`` before), arrived_between (read it, but later than that) or no_named_read.

    uses: (use_id, agent, page, t); reads: (agent, page, t). Only the first read of each agent and page counts, so it is one aggregate
    and one equi-join.
    """
    first = reads.where(F.col("t").isNotNull()).groupBy(agent, page).agg(F.min("t").alias("first_read"))
    how = F.when(F.col("first_read") <= F.col("t") - lag_s, "confirmed").when(F.col("first_read") <= F.col("t"), "arrived_between").otherwise("no_named_read")
    return uses.join(first, [agent, page], "left").withColumn("how", how)


def adoption(uses: DataFrame, *, token: str, agent: str, family: str, time: str) -> DataFrame:
    """(token, origin, first_use, n_users, n_families, n_elsewhere): who coined each token, and how many took it up, in which families.

    A token's origin is the agent of its earliest use (of equal times the least name); adopters are all others; n_elsewhere counts
    adopters whose own first use was in another family than the origin's.
    """
    firsts = uses.where(F.col(agent).isNotNull()).groupBy(token, agent).agg(F.min(F.struct(F.col(time).alias("t"), F.col(family).alias("f"))).alias("u"))
    origin = firsts.groupBy(token).agg(F.min(F.struct(F.col("u.t").alias("t"), F.col(agent).alias("a"), F.col("u.f").alias("f"))).alias("o"), F.count(F.lit(1)).alias("n_users"), F.countDistinct("u.f").alias("n_families"))
    elsewhere = firsts.join(origin.select(token, "o"), token).where((F.col(agent) != F.col("o.a")) & (F.col("u.f") != F.col("o.f"))).groupBy(token).agg(F.count(F.lit(1)).alias("n_elsewhere"))
    return origin.join(elsewhere, token, "left").select(token, F.col("o.a").alias("origin"), F.col("o.t").alias("first_use"), "n_users", "n_families", F.coalesce("n_elsewhere", F.lit(0)).alias("n_elsewhere"))


def run_of(writer: Column) -> Column:
    """A writer's name without the number of a part (``name#2``)."""
    return F.split(writer, "#")[0]


def saved_by(requests: DataFrame, revisions: DataFrame) -> DataFrame:
    """(name, t, writer): logged saves with the writer of the revision that was saved on the page in that second under that name.

    requests: (name, page_key, t) of saves; revisions: (page_key, label, t, writer). Several names often save one page in one second, so the label must be the name.
    """
    r = revisions.where("writer IS NOT NULL").select("page_key", F.col("label").alias("name"), "t", "writer")
    return requests.select("name", "page_key", "t").join(r, ["page_key", "name", "t"]).select("name", "t", "writer")


def session_evidence(requests: DataFrame, saves: DataFrame, *, owners: DataFrame, labels: DataFrame, spans: DataFrame, generic: Column | None = None, gap_s: int = GAP_S, window_s: int = 86_400) -> DataFrame:
    """(name, session_no, start_s, end_s, n_events, tier, verdict, kinds): the sessions of each name with who was behind them.

    requests: (name, t), seconds; saves: (name, t, writer), each at a request's time; owners: (name, writer), the names that writers sign with; labels: (name, writer), all names that
    edits of writers carry; spans: (writer, first_s, last_s). A save says what the name is to its writer (see evidence_kind): own and private ones are strong; weak ones bring the
    name's owners with them. A session without saves belongs to the only writer with strong saves under its name, if the name was never weak nor generic and it lies
    within that writer's span, ``window_s`` wider at both ends. kinds: ``kind:n;...`` of the saves. generic: over ``name``; names of
    several words or a bare date unless given.
    """
    stock = is_generic(F.col("name")) if generic is None else generic
    # What several branches read is written once: plans stay small.
    sessions = durable(sessionize(requests, key="name", time="t", gap_s=gap_s))
    own = owners.select("name", "writer").where("name IS NOT NULL AND writer IS NOT NULL").distinct()
    n_users = labels.where("name IS NOT NULL AND writer IS NOT NULL").groupBy("name").agg(F.countDistinct(run_of(F.col("writer"))).alias("n_users"))
    pairs = saves.select("name", "writer").distinct().join(own.withColumn("owns", F.lit(True)), ["name", "writer"], "left").join(own.select("name").distinct().withColumn("owned", F.lit(True)), "name", "left").join(n_users, "name", "left")
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    pairs = pairs.select("name", "writer", evidence_kind(known("owns"), known("owned"), stock, F.coalesce("n_users", F.lit(0))).alias("kind"))
    numbered = durable(saves.where("writer IS NOT NULL").select("name", "t", "writer").withColumn("save_id", F.monotonically_increasing_id()))
    placed = interval_lookup(numbered, sessions, on="name", time="t", start="start_s", end="end_s", point_id="save_id", values={"session_no": F.col("session_no")}).select("save_id", "name", "session_no")
    each = durable(placed.join(numbered.select("save_id", "writer"), "save_id").join(pairs, ["name", "writer"]))
    strong = F.col("kind").isin("own", "private")
    counts = each.groupBy("name", "session_no", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("name", "session_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda s: F.concat(s["kind"], F.lit(":"), s["n"])), ";").alias("kinds"))
    # As many as saved in a session; owners of a weak session's name count as its writers.
    sets = each.groupBy("name", "session_no").agg(F.collect_set(F.when(strong, F.col("writer"))).alias("strong"), F.collect_set(F.when(~strong, F.col("writer"))).alias("weak"))
    owning = own.groupBy("name").agg(F.collect_set("writer").alias("owning"))
    sets = sets.join(owning, "name", "left").withColumn("weak", F.when(F.size("weak") > 0, F.array_union("weak", F.coalesce("owning", F.array().cast("array<string>")))).otherwise(F.col("weak"))).drop("owning")
    by_name = each.groupBy("name").agg(F.countDistinct(F.when(strong, run_of(F.col("writer")))).alias("n_runs"), F.max((~strong).cast("int")).alias("weak_name"))
    only = each.where(strong).select("name", "writer").distinct().join(by_name.where("n_runs = 1 AND weak_name = 0").select("name"), "name").where(~stock)
    fits = sessions.join(only, "name").join(spans, "writer").where((F.col("start_s") >= F.col("first_s") - window_s) & (F.col("end_s") <= F.col("last_s") + window_s))
    sole = fits.groupBy("name", "session_no").agg(F.min("writer").alias("sole"), F.max("writer").alias("__m")).where("sole = __m").select("name", "session_no", "sole")
    none = F.array().cast("array<string>")
    out = sessions.join(sets, ["name", "session_no"], "left").join(counts, ["name", "session_no"], "left").join(sole, ["name", "session_no"], "left").withColumns({"strong": F.coalesce("strong", none), "weak": F.coalesce("weak", none)})
    tier = session_tier(F.col("strong"), F.col("weak"), F.col("sole"))
    verdict = F.when(tier == "session", F.get("strong", F.lit(0))).when(tier == "exclusive", F.col("sole"))
    return out.select("name", "session_no", "start_s", "end_s", "n_events", tier.alias("tier"), verdict.alias("verdict"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def with_basis(reads: DataFrame, sessions: DataFrame, *, read: str, bases: tuple[str, ...] | None = None) -> DataFrame:
    """(read, name, t, verdict, basis) of the reads that lie in a session with a verdict; only those of the given bases.

    reads: (read, name, t); sessions: as session_evidence gives them.
    """
    known = sessions.where("verdict IS NOT NULL").withColumn("basis", evidence_basis(F.col("kinds")))
    out = interval_lookup(reads, known, on="name", time="t", start="start_s", end="end_s", point_id=read, values={"verdict": F.col("verdict"), "basis": F.col("basis")})
    return out.where(F.col("basis").isin(*bases)).select(read, "name", "t", "verdict", "basis") if bases else out.select(read, "name", "t", "verdict", "basis")


def interval_calls(points: DataFrame, calls: DataFrame, *, on: str, time: str, start: str, end: str, point_id: str, call: str) -> DataFrame:
    """(point_id, call): the hand call whose interval, bounds included, holds each point; raises when the plan runs if two calls of one ``on`` overlap.

    Overlaps are found among the calls: each one begins behind the latest end of those before it.
    """
    latest = asof_backward(calls.withColumn("__before", F.col(start) - 1), calls, key=on, left_id=call, left_time="__before", right_time=start, values={"__reach": F.struct(F.col(end), F.col(call))})
    twice = calls.groupBy(on, start).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(1).alias("x"))
    overlapping = latest.where(F.col(f"__reach.{end}") > F.col("__before")).select(F.lit(1).alias("x")).unionByName(twice)
    count = overlapping.agg(F.count(F.lit(1)).alias("n_overlaps"))
    checked = calls.crossJoin(F.broadcast(count)).where(F.assert_true(F.col("n_overlaps") == 0, F.lit("overlapping calls")).isNull())
    return interval_lookup(points, checked, on=on, time=time, start=start, end=end, point_id=point_id, values={call: F.col(call)}).select(point_id, call)


def active_count(points: DataFrame, sessions: DataFrame, *, by: str, point_id: str, time: str, window_s: int) -> DataFrame:
    """(point_id, n): how many (``by``, agent) were active in the ``window_s`` seconds before each point, the point's own second not included.

    sessions: (by, agent, start_s, end_s), of each agent with a gap of ``window_s``, so an agent is active before a point exactly if the point lies behind a session's start and no later than its end plus the window.
    So the count is the difference of two running counts, found as-of: agents and points never meet.
    """
    # +1 from the second behind the start, -1 from the second behind end + window.
    steps = sessions.select(by, F.explode(F.array(F.struct((F.col("start_s") + 1).alias("at"), F.lit(1).alias("d")), F.struct((F.col("end_s") + window_s + 1).alias("at"), F.lit(-1).alias("d")))).alias("s")).groupBy(by, "s.at").agg(F.sum("s.d").alias("d"))
    running = running_total(steps, by=by, at="at", value="d")
    found = asof_backward(points.select(point_id, by, time), running, key=by, left_id=point_id, left_time=time, right_time="at", values={"n": F.col("total")})
    return found.select(point_id, "n")


def agents_within(points: DataFrame, marks: DataFrame, *, point_id: str, agent: str, time: str, lo: int, hi: int) -> DataFrame:
    """(point_id, own, others): how many agents have a mark in [time + lo, time + hi] of each point: the point's own agent (0 or 1), and others.

    points: (point_id, agent, time); marks: (agent, time). Counted as-of (see active_count), for everybody and for each agent, so points never meet marks however many
    there are in the window. Points with a null time give no row.
    """
    shifted = marks.where(F.col(agent).isNotNull() & F.col(time).isNotNull()).select(agent, (F.col(time) - (hi + 1)).alias(time))
    sessions = durable(sessionize(shifted, key=agent, time=time, gap_s=hi - lo + 1).select(agent, "start_s", "end_s").withColumn("__all", F.lit(0)))
    p = points.where(F.col(time).isNotNull()).select(point_id, agent, time).withColumn("__all", F.lit(0))
    count = lambda by, name: active_count(p, sessions, by=by, point_id=point_id, time=time, window_s=hi - lo + 1).withColumnRenamed("n", name)
    both = p.select(point_id).join(count("__all", "__every"), point_id, "left").join(count(agent, "own"), point_id, "left")
    own = F.coalesce("own", F.lit(0))
    return both.select(point_id, own.alias("own"), (F.coalesce("__every", F.lit(0)) - own).alias("others"))


def running_total(steps: DataFrame, *, by: str, at: str, value: str, bucket_s: int = 86_400) -> DataFrame:
    """(by, at, total): the sum of a key's values up to and including each time; sums of time buckets are carried over, so a hot key is spread over its buckets."""
    from pyspark.sql import Window

    b = F.floor(F.col(at) / bucket_s)
    rows = steps.withColumn("__b", b)
    sums = rows.groupBy(by, "__b").agg(F.sum(value).alias("__s"))
    carry = sums.select(by, "__b", F.coalesce(F.sum("__s").over(Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__c"))
    local = Window.partitionBy(by, "__b").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carry, [by, "__b"]).select(by, at, (F.col("__c") + F.sum(value).over(local)).alias("total"))


def decoy_rates(targets: DataFrame, reads: DataFrame, *, families: DataFrame, touches: DataFrame, dropped: DataFrame | None = None, window_s: int = 86_400, page_window_s: int = 86_400) -> DataFrame:
    """(target_id, agent, page, t, hit, reader_rate, family_rate, page_rate): whether an agent read a page in the ``window_s`` seconds before a target's time, beside three decoys.

    targets: (target_id, agent, page, t); reads: (agent, page, t, session_id); families: (agent, family), one each; touches: (agent, page), who had to do with a page, never decoys for it; dropped: (target_id, session_id), sessions of
    the agent that don't count for a target. Targets whose agent has no other read in the window are left out.
    reader_rate: of all other agents active in the window who didn't touch the page, the share that read it; family_rate: of those of the agent's
    family; page_rate: of the pages of other agents' targets of that family within ``page_window_s``, which the agent didn't touch, the share that the agent read. Null where there is nobody, or no page.

    Agents active in a window are counted as-of (see active_count), so targets never meet all readers.
    """
    from strandline.operators.band import band_join

    # What several branches read is written once: plans stay small.
    r = durable(reads.where("agent IS NOT NULL AND t IS NOT NULL").select("agent", "page", "t", "session_id"))
    fam = families.select("agent", "family").where("family IS NOT NULL")
    touched = durable(touches.select("agent", "page").where("agent IS NOT NULL AND page IS NOT NULL").distinct())
    targets = durable(targets.select("target_id", "agent", "page", "t"))
    # The agent's own reads in the window, without dropped sessions.
    mine = band_join(targets.select("target_id", "agent", F.col("page").alias("wanted"), "t"), r.withColumnRenamed("t", "t_read"), on=["agent"], left_time="t", right_time="t_read", lo=-window_s, hi=-1)
    raw = mine.groupBy("target_id").agg(F.max((F.col("page") == F.col("wanted")).cast("int")).alias("raw_hit"))
    if dropped is not None:
        mine = mine.join(dropped.select("target_id", "session_id").distinct(), ["target_id", "session_id"], "left_anti")
    mine = durable(mine)
    own = mine.groupBy("target_id").agg(F.max(F.coalesce((F.col("page") == F.col("wanted")).cast("int"), F.lit(0))).alias("hit"))
    kept = targets.join(own, "target_id").join(raw, "target_id").join(fam, "agent", "left").join(touched.withColumn("in_touch", F.lit(1)), ["agent", "page"], "left")
    kept = durable(kept.select("target_id", "agent", "page", "t", "hit", F.coalesce("raw_hit", F.lit(0)).alias("raw_hit"), "family", F.coalesce("in_touch", F.lit(0)).alias("in_touch")))

    active = durable(sessionize(r, key="agent", time="t", gap_s=window_s).select("agent", "start_s", "end_s").withColumn("all", F.lit("all")))
    on_page = durable(sessionize(r.where("page IS NOT NULL").select(F.struct("agent", "page").alias("k"), "t"), key="k", time="t", gap_s=window_s).select("k.agent", "k.page", "start_s", "end_s").join(touched, ["agent", "page"], "left_anti"))
    # Touchers of a page that were active anywhere.
    touchers = durable(active.drop("all").join(touched.join(kept.select("page").distinct(), "page", "left_semi"), "agent"))
    points = kept.withColumn("all", F.lit("all"))

    def rates(points: DataFrame, everybody: DataFrame, by: str, readers: DataFrame, those: DataFrame, name: str) -> DataFrame:
        page_key = "page" if by == "all" else "pf"
        n_active = active_count(points, everybody, by=by, point_id="target_id", time="t", window_s=window_s).withColumnRenamed("n", "n_active")
        n_hit = active_count(points, readers, by=page_key, point_id="target_id", time="t", window_s=window_s).withColumnRenamed("n", "n_hit")
        n_touch = active_count(points, those, by=page_key, point_id="target_id", time="t", window_s=window_s).withColumnRenamed("n", "n_touch")
        z = lambda c: F.coalesce(F.col(c), F.lit(0))
        out = points.select("target_id", "in_touch", "raw_hit").join(n_active, "target_id", "left").join(n_hit, "target_id", "left").join(n_touch, "target_id", "left")
        # The agent is active itself: among the touchers, or to be taken out here.
        others = z("n_active") - z("n_touch") - (1 - F.col("in_touch"))
        hits = z("n_hit") - F.when(F.col("in_touch") == 0, F.col("raw_hit")).otherwise(0)
        return out.select("target_id", F.when(others > 0, hits / others).alias(name))

    everyone = rates(points, active, "all", on_page, touchers, "reader_rate")
    pf = F.struct("page", "family")
    in_family = lambda df: df.join(fam, "agent").withColumn("pf", pf)
    family = rates(points.where("family IS NOT NULL").withColumn("pf", pf), active.join(fam, "agent"), "family", in_family(on_page), in_family(touchers), "family_rate")

    # Pages of others' targets of the family, near in time.
    near = band_join(kept.where("family IS NOT NULL").select("target_id", "agent", "page", "t", "family"), targets.join(fam, "agent").select("family", F.col("agent").alias("other"), F.col("page").alias("decoy"), F.col("t").alias("t_other")), on=["family"], left_time="t", right_time="t_other", lo=-page_window_s, hi=page_window_s - 1)
    pages = near.where("other <> agent AND decoy <> page").select("target_id", "agent", "decoy").distinct().join(touched.withColumnRenamed("page", "decoy"), ["agent", "decoy"], "left_anti")
    seen = mine.select("target_id", F.col("page").alias("decoy"), F.lit(1).alias("read")).distinct()
    page = pages.join(seen, ["target_id", "decoy"], "left").groupBy("target_id").agg(F.avg(F.coalesce("read", F.lit(0))).alias("page_rate"))
    return kept.select("target_id", "agent", "page", "t", "hit").join(everyone, "target_id", "left").join(family, "target_id", "left").join(page, "target_id", "left").select("target_id", "agent", "page", "t", "hit", "reader_rate", "family_rate", "page_rate")
