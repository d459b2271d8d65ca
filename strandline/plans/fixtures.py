"""Queries over small literal rows, for operators whose cases the tables don't hold. Their SQL is the expected result, worked out by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import claims, exposure, lines, matching, review, trajectories

HUNKS = "array<struct<op string, a0 int, a1 int, b0 int, b1 int>>"

#: Texts with a name in the place of a signature: (rev, label, text).
SIGNATURES = [
    ("r01", None, "seen it\nthanks -- [[AdaMar13X]]"), ("r02", None, "-- Sep21 late watcher"), ("r03", None, "done -- AdaScout1 for now"), ("r04", None, "done -- AdaScout1$(date +%s)"), ("r05", None, "x -- May24OAI and more"),
    ("r06", None, "Live cohort -- AdaScout1: we saw R2"), ("r07", None, "-- AdaScout1: did you see it"), ("r08", None, "LIVE AdaScout1: R2 is up"), ("r09", None, "AdaScout1 UPDATE (two): R2"), ("r10", None, "AdaScout1: our R3 arrived"),
    ("r11", None, "AdaScout1: are you there?"), ("r12", "AdaScout1", "AdaScout1: are you there?"), ("r13", None, "AdaScout1: R3 is late"), ("r14", "AdaScout1", "AdaScout1: R3 is late"), ("r15", "SectorAgentMay24OAI", "May24OAI: R3 is late"), ("r16", "Other", "May24OAI: our R3"),
    ("r17", None, "one\ntwo\nAdaScout1: our R3 in line three"), ("r18", None, "AdaScout1: our R3\nsee -- [[BeaMay01Y]]"), ("r19", None, "plain text"), ("r20", None, None), ("r21", None, ""), ("r22", None, "hi -- Bob\nLIVE AdaScout1: now"), ("r23", None, "LIVE AdaScout1: now\nhi -- Bob"),
]

#: Posts with clocks: (writer, post, family, own tags, text).
POSTS = [
    ("w1", "p1", "f", ["mar13"], "R3 arrived 10:15:20; deadline 10:20."), ("w1", "p2", "g", ["mar13"], "R3 arrived 14:15:20"), ("w1", "p3", "f", ["mar13"], "R3 answer at 10:25:00"), ("w2", "p4", "f", ["mar13"], "R3 arrived 10:15:20"),
    ("w2", "p5", "f", ["mar13"], "R4 arrived/deadline 11:00:00/11:05:00"), ("w3", "p6", "h", ["may01"], "our R3 arrived 10:15:20"), ("w4", "p7", "f", ["jun02"], "your R3 was due 10:15:20 UTC"), ("w4", "p8", "f", ["jun02"], "Projected G3 05:13:32, G4 05:20:08"), ("w4", "p9", "f", ["jun02"], "Q1+2h15 (13:45:39)"),
    ("w5", "q1", "f", None, "May28: are you active? R5 was due task 14:18:54"), ("w5", "q2", "f", None, "now 03:54, no R2 yet"), ("w5", "q3", "f", None, None), ("w6", "q4", "f", [], "R4-Slovak 10:00 and G4-KY about 11:00:01"),
]

REVISIONS = [
    ("p@1", "p", 1, None, "a\nb café", None), ("p@2", "p", 2, "p@1", "a\nb caf�\nc -- Ada_L", [("replace", 1, 2, 1, 2), ("insert", 2, 2, 2, 9)]), ("p@3", "p", 3, "p@2", "a\n\nnew\n", [("replace", 1, 3, 1, 4), ("delete", 0, 1, 0, 0)]), ("p@4", "p", 4, "p@3", None, [("insert", 0, 0, 0, 1)]),
]

ASSIGNED = [
    ("e1", "Ada", 10, "L1", "p"), ("e2", "Ada", 20, "L1", "p"), ("e3", "Bea", 30, "L2", "p"), ("e4", "Bea", 40, "L2", "q"), ("e5", "Cy", 50, "L3", "q"), ("e6", "AdaMar13", 70, "L1", "p"), ("e7", "Dee", 80, "L4", "q"), ("e8", "Dee", 90, "L4", "q"), ("e9", "Eve", 95, "L5", "q"), ("f1", "Fay", 97, "L6", "p"),
    ("g1", "GusScoutApr02", 100, "L7", "r"), ("g2", "GusScoutApr02", 200, "L7", "r"), ("g3", "GusScoutApr02Helper", 300, "L8", "s"),
]
CALLS = [
    (1, "reassign", "Bea", "Ada", ["e4"]), (2, "exclude", "Dee", None, ["e8"]), (3, "merge", "Cy", "Dee", None), (4, "merge", "Dee", "Bea", None), (5, "split", "Ada", None, ["e2"]), (6, "attribute", None, "Eve", ["u1"]),
]
BAD_CALLS = [
    (1, "merge", "Ada", "Ada", None), (2, "merge", "Nobody", "Ada", None), (3, "reassign", "Bea", None, ["e3"]), (4, "dance", "Ada", "Bea", None), (5, "exclude", "Ada", None, ["e1"]), (6, "reassign", "Ada", "Bea", ["e1"]), (7, "exclude", "Ada", None, ["zz"]), (8, "keep", "Ada", None, None),
]
PROPOSED = [(1, "Ada", "e3", None), (2, "Ada", "u1", None), (3, "Bea", None, "Fay"), (4, "Ada", "e1", None), (5, "Cy", "e4", None), (6, "Cy", "nn", None)]
_ASSIGNED, _CALLS = "rev string, name string, time int, label string, page_key string", "call_no int, decision string, name string, target string, revs array<string>"

VERDICTS = [
    ("t1", "w", None, 1, 1, "confirm", None, ["a"], "first"), ("t1", "w", None, 2, 1, "reject", None, None, None), ("t1", "w", None, 3, 1, None, "v", ["b"], "second"), ("t2", "w", None, 1, 1, "confirm", None, None, None), ("t2", "w", None, 2, 1, "clear", None, None, None),
    ("t3", "w", "x", 1, 1, "reject", None, ["k"], None), ("t3", "w", "y", 2, 1, "reassign", "v", ["m"], None), ("t3", "w", "z", 3, 1, "unsure", None, None, "n"), ("t4", "w", "x", 1, 1, "reassign", "w", None, None), ("t4", "w", "y", 2, 1, "reject", None, None, None), ("t5", "w", "x", 1, 1, "confirm", None, None, None),
    ("t5", "w", None, 2, 1, "reject", None, None, None), ("t6", "w", None, 1, 1, "reject", None, None, None), ("t6", "w", "x", 2, 1, "confirm", None, None, None), ("t7", "w", "x", 1, 1, "confirm", None, None, None), ("t7", "w", "x", 2, 1, "clear", None, None, None), ("t8", "w", None, 1, 1, None, None, ["only"], None),
]


def _signed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNATURES, "rev string, label string, text string")


def signature_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Each form and branch, those turned down too."""
    return lines.rule_signed(_signed(spark), rev="rev", text="text", label="label", rejected=True)


def read_signed(spark: SparkSession, sf: str) -> DataFrame:
    """P10: a rule form below the last signed line wins."""
    return lines.read_signed(_signed(spark), rev="rev", text="text", label="label")


def _revisions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REVISIONS, f"rev string, page string, seq int, base string, text string, hunks {HUNKS}")


def hunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that a revision's hunks wrote and that no earlier revision of the page holds."""
    df = _revisions(spark)
    fresh = df.select("page", "seq", F.explode(lines.fresh_numbers(F.size(F.split("text", "\n", -1)), F.col("hunks"))).alias("line_no"))
    return lines.novel_lines(df, page="page", seq="seq", text="text").join(fresh, ["page", "seq", "line_no"], "left_semi").select("seq", "line_no", "line")


def review_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Re-encoded lines and signed fresh lines of each revision."""
    df = _revisions(spark)
    return lines.review_flags(df, lines.reencoded_lines(df, df, rev="rev", text="text", base="base", hunks="hunks"), rev="rev", text="text", hunks="hunks")


def written_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines an edit wrote and those that claimed spans of characters touch."""
    spans = spark.createDataFrame([("p@2", 0, 1), ("p@3", 0, 1), ("p@3", 4, 4)], "rev string, begin int, end int")
    return lines.written_lines(_revisions(spark), spans, rev="rev", text="text", hunks="hunks").select("rev", F.array_join("lines", "|").alias("lines"))


def _posts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POSTS, "writer string, post string, family string, tags array<string>, text string")


def claim_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Every clock with its round, event, status, owner and clock."""
    c = _posts(spark).select("post", F.explode(claims.claims(F.col("text"), F.col("tags"))).alias("c"))
    return c.select("post", "c.raw", F.coalesce("c.tag", F.lit("-")).alias("tag"), F.coalesce("c.round", F.lit(0)).alias("round"), "c.event", "c.status", "c.owner", "c.clock", "c.qualified", "c.inherited", "c.precision")


def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a writer's posts by rounds that agree and disagree."""
    got = claims.contradictions(_posts(spark), writer="writer", post="post", text="text", own="tags")
    return got.select("writer", "post_a", "post_b", "n_agree", "n_disagree", F.coalesce("max_gap_s", F.lit(-1)).alias("max_gap_s"))


def task_clashes(spark: SparkSession, sf: str) -> DataFrame:
    """Families of a writer that agree with none of its others."""
    return claims.task_clashes(_posts(spark), writer="writer", post="post", text="text", family="family", own="tags")


def merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Writers with exact times in common."""
    writers = spark.createDataFrame([("w1", ["f", "g"], ["mar13"]), ("w2", ["f"], ["mar13"]), ("w3", ["h"], ["may01"]), ("w4", ["f"], ["jun02"])], "writer string, fams array<string>, tags array<string>")
    return claims.merge_candidates(_posts(spark), writers, writer="writer", post="post", text="text", families="fams", tags="tags", own="tags")


def placeable(spark: SparkSession, sf: str) -> DataFrame:
    """One-off edits with just one writer of the alias key, page and label, 600 seconds around."""
    one = spark.createDataFrame([("o1", "AdaMar13", "p", "L", 1_000), ("o2", "AdaMar13", "p", "L", 2_201), ("o3", "AdaMar13", "p", "M", 1_000), ("o4", "Bea", "p", "L", 1_000), ("o5", "May 3", "p", "L", 1_000)], "rev string, name string, page_key string, label string, t long")
    many = spark.createDataFrame([("T1", "Ada", "p", "L", 1_600), ("T2", "Bea", "p", "L", 900), ("T3", "bea", "p", "L", 1_100)], "target string, name string, page_key string, label string, t long")
    return review.placeable(one, many)


def contained(spark: SparkSession, sf: str) -> DataFrame:
    """One-off edits whose name's words are a run of just one writer's, or the other way round."""
    one = spark.createDataFrame([("o1", "ScoutApr02", "f", 1_000), ("o2", "GusScoutApr02Helper", None, 1_000), ("o3", "ScoutApr03", "f", 1_000), ("o4", "ScoutApr02", "g", 1_000), ("o5", "ScoutApr02", "f", 200_000), ("o6", "HelperMay01", "f", 1_000)], "rev string, name string, family string, t long")
    many = spark.createDataFrame([("GusScoutApr02", "GusScoutApr02", "f", 2_000), ("AnHelperMay01", "AnHelperMay01", "f", 900), ("BoHelperMay01", "BoHelperMay01", "f", 900)], "target string, name string, family string, t long")
    return trajectories.containment(one, many)


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Names that are one alias key, equal but for case or just one of them dated."""
    names = spark.createDataFrame([("Ada",), ("ADA",), ("AdaMar13",), ("AdaMay01",), ("Bea",), ("Bea_",), ("Mar13",), (None,), ("Ada",)], "name string")
    pairs = review.alias_candidates(names, name="name", not_alias=spark.createDataFrame([("AdaMay01", "Ada")], "name_a string, name_b string"))
    return pairs


def same_agents(spark: SparkSession, sf: str) -> DataFrame:
    """Whether two names can be one writer's."""
    df = spark.createDataFrame([("AdaMar13X", "ada"), ("AdaMar13", "AdaMay01"), ("Ada", "AdaScout"), ("Ada", "Bea"), ("Mar13Ada_", "ada")], "a string, b string")
    return df.select("a", "b", lines.same_agent(F.col("a"), F.col("b")).alias("same"))


def saves(spark: SparkSession, sf: str) -> DataFrame:
    """A save belongs to the revision of its page and second that carries its name."""
    q = spark.createDataFrame([("Ada", "p", 5), ("Bea", "p", 5), ("Ada", "q", 5), ("Ada", "p", 6), ("Cy", "p", 5)], "name string, page_key string, t long")
    v = spark.createDataFrame([("p", "Ada", 5, "w1"), ("p", "Bea", 5, "w2"), ("p", "Cy", 5, None), ("q", "Cy", 5, "w3"), ("p", "Ada", 7, "w4")], "page_key string, label string, t long, writer string")
    return exposure.saved_by(q, v)


def called(spark: SparkSession, sf: str) -> DataFrame:
    """M2, M3, M5-M7: assignments after attribution, reassignment, exclusion, merges in a chain and a split."""
    a, c = spark.createDataFrame(ASSIGNED, _ASSIGNED), spark.createDataFrame(CALLS, _CALLS)
    unsigned = spark.createDataFrame([("u1", 60, "L5")], "rev string, time int, label string")
    return review.apply_calls(a, c, unsigned).select("rev", "name", "part", F.coalesce("signed_as", F.lit("-")).alias("signed_as"))


def call_problems(spark: SparkSession, sf: str) -> DataFrame:
    """M1: calls that mustn't be applied."""
    return review.problems(spark.createDataFrame(BAD_CALLS, _CALLS), spark.createDataFrame(ASSIGNED, _ASSIGNED))


def proposed(spark: SparkSession, sf: str) -> DataFrame:
    """M4: pending proposals applied: moves, an unsigned edit, a whole writer, edits that are reviewed or held already."""
    a = spark.createDataFrame(ASSIGNED, _ASSIGNED).withColumn("signed_as", F.lit(None).cast("string")).drop("page_key")
    p = spark.createDataFrame(PROPOSED, "call_no int, name string, rev string, source string")
    unsigned = spark.createDataFrame([("u1", 60, "L5")], "rev string, time int, label string")
    out = review.apply_proposals(a, p, unsigned, spark.createDataFrame([("e4",)], "rev string"))
    return out.select("rev", "name", F.coalesce("signed_as", F.lit("-")).alias("signed_as"), "proposed")


def proposal_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """M4: revisions that two proposals give to different names, one of them through its writer."""
    p = spark.createDataFrame([(1, "Ada", "e5", None), (2, "Bea", None, "Cy"), (3, "Bea", "e3", None)], "call_no int, name string, rev string, source string")
    return review.proposal_conflicts(p, spark.createDataFrame(ASSIGNED, _ASSIGNED))


def placement(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain from calls to the floor."""
    a, c = spark.createDataFrame(ASSIGNED, _ASSIGNED), spark.createDataFrame(CALLS, _CALLS)
    unsigned = spark.createDataFrame([("u1", 60, "L5", "q"), ("u2", 61, "L6", "p")], "rev string, time int, label string, page_key string")
    proposals = spark.createDataFrame([(1, "Fay", "u2", None)], "call_no int, name string, rev string, source string")
    return review.placement(a, c, unsigned=unsigned, proposals=proposals).select("rev", "name", "part", F.coalesce("signed_as", F.lit("-")).alias("signed_as"), "how")


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts set, overwritten, cleared, made from posts by precedence, and overridden; tags and notes."""
    log = spark.createDataFrame(VERDICTS, "target string, owner string, post string, at int, seq int, verdict string, assign_to string, tags array<string>, note string")
    out = matching.folded_verdicts(log, target="target", owner="owner")
    dash = lambda c: F.coalesce(F.col(c), F.lit("-")).alias(c)
    return out.select("target", dash("verdict"), dash("assign_to"), dash("verdict_from"), F.array_join("tags", ",").alias("tags"), F.array_join("notes", ",").alias("notes"))


def merged_claims(spark: SparkSession, sf: str) -> DataFrame:
    """What each writer claims in an edit."""
    posts = spark.createDataFrame([("e1", "w", "weak", ["R2"], 1), ("e1", "w", "strong", ["R1", "R2"], 2), ("e1", "v", "weak", None, 3), ("e2", "w", "odd", ["R9"], 1)], "edit string, writer string, section string, rules array<string>, place int")
    out = matching.merged_claims(posts, edit="edit", writer="writer", section="section", ranks=["strong", "weak"], rules="rules", place="place")
    return out.select("edit", "writer", "section", F.array_join("rules", ",").alias("rules"), "n_posts")


def nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in an order of several keys in which nulls come last, numbered; the first filled of two names."""
    from pyspark.sql import Window

    df = spark.createDataFrame([(1, "b", None), (2, None, "x"), (3, "a", "z"), (4, "a", None), (5, "~", "y"), (6, "", "v")], "id int, k string, m string")
    order = Window.orderBy(F.asc_nulls_last("k"), F.desc_nulls_last("m"), "id")
    return df.select("id", F.row_number().over(order).alias("place"), F.coalesce(F.nullif("k", F.lit("")), "m", F.lit("-")).alias("first"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fx_signature_forms": signature_forms, "fx_read_signed": read_signed, "fx_hunk_lines": hunk_lines, "fx_review_flags": review_flags, "fx_written_lines": written_lines, "fx_claims": claim_fields, "fx_contradictions": contradictions, "fx_task_clashes": task_clashes, "fx_merge_candidates": merge_candidates,
    "fx_placeable": placeable, "fx_contained": contained, "fx_aliases": aliases, "fx_same_agents": same_agents, "fx_saves": saves, "fx_calls": called, "fx_call_problems": call_problems, "fx_proposals": proposed, "fx_proposal_conflicts": proposal_conflicts, "fx_placement": placement,
    "fx_verdicts": verdicts, "fx_merged_claims": merged_claims, "fx_nulls_last": nulls_last,
}

#: The results worked out by hand: columns, and rows.
EXPECTED: dict[str, tuple[str, list[tuple]]] = {
    "fx_signature_forms": ("rev rule name line_no", [
        ('r01', 'R1', 'AdaMar13X', 1), ('r02', 'R5', 'Sep21 late watcher', 0), ('r03', 'R3', 'AdaScout1', 0), ('r04', 'R3', 'AdaScout1', 0), ('r06', 'R2', 'AdaScout1', 0), ('r07', 'x_vocative', 'AdaScout1', 0),
        ('r08', 'R4', 'AdaScout1', 0), ('r09', 'R4', 'AdaScout1', 0), ('r10', 'R4', 'AdaScout1', 0), ('r11', 'x_vocative', 'AdaScout1', 0), ('r12', 'R4', 'AdaScout1', 0), ('r13', 'x_other', 'AdaScout1', 0),
        ('r14', 'R4', 'AdaScout1', 0), ('r15', 'R4', 'May24OAI', 0), ('r16', 'x_bare_date', 'May24OAI', 0), ('r18', 'R1', 'BeaMay01Y', 1), ('r22', 'R4', 'AdaScout1', 1), ('r23', 'R4', 'AdaScout1', 0),
    ]),
    "fx_read_signed": ("rev name line_no rule", [
        ('r01', 'AdaMar13X', 1, 'R1'), ('r02', 'Sep21 late watcher', 0, 'R5'), ('r03', 'AdaScout1', 0, 'R3'), ('r04', 'AdaScout1', 0, 'R3'), ('r06', 'AdaScout1', 0, 'R2'), ('r08', 'AdaScout1', 0, 'R4'),
        ('r09', 'AdaScout1', 0, 'R4'), ('r10', 'AdaScout1', 0, 'R4'), ('r12', 'AdaScout1', 0, 'R4'), ('r14', 'AdaScout1', 0, 'R4'), ('r15', 'May24OAI', 0, 'R4'), ('r18', 'BeaMay01Y', 1, 'R1'), ('r22', 'AdaScout1', 1, 'R4'),
        ('r23', 'Bob', 1, None),
    ]),
    "fx_hunk_lines": ("seq line_no line", [
        (1, 0, 'a'), (1, 1, 'b café'), (2, 2, 'c -- Ada_L'), (3, 1, ''), (3, 2, 'new'), (3, 3, ''),
    ]),
    "fx_review_flags": ("rev n_reencoded n_signed", [
        ('p@1', 0, 0), ('p@2', 1, 1), ('p@3', 0, 0), ('p@4', 0, 0),
    ]),
    "fx_written_lines": ("rev lines", [
        ('p@1', 'a|b café'), ('p@2', 'a|b caf�|c -- Ada_L'), ('p@3', 'a||new'),
    ]),
    "fx_claims": ("post raw tag round event status owner clock qualified inherited precision", [
        ('p1', '10:15:20', 'R', 3, 'arrival', 'reported', 'unmarked', 'unspecified', False, False, 'second'), ('p1', '10:20', 'R', 3, 'deadline', 'reported', 'unmarked', 'unspecified', False, True, 'minute'),
        ('p2', '14:15:20', 'R', 3, 'arrival', 'reported', 'unmarked', 'unspecified', False, False, 'second'), ('p3', '10:25:00', 'R', 3, 'answer', 'reported', 'unmarked', 'unspecified', False, False, 'second'),
        ('p4', '10:15:20', 'R', 3, 'arrival', 'reported', 'unmarked', 'unspecified', False, False, 'second'), ('p5', '11:00:00', 'R', 4, 'arrival', 'reported', 'unmarked', 'unspecified', False, False, 'second'),
        ('p5', '11:05:00', 'R', 4, 'deadline', 'unspecified', 'unmarked', 'unspecified', False, False, 'second'), ('p6', '10:15:20', 'R', 3, 'arrival', 'reported', 'self', 'unspecified', False, False, 'second'),
        ('p7', '10:15:20', 'R', 3, 'due', 'predicted', 'peer', 'other', False, False, 'second'), ('p8', '05:13:32', 'G', 3, 'due', 'predicted', 'unmarked', 'unspecified', False, False, 'second'),
        ('p8', '05:20:08', 'G', 4, 'due', 'predicted', 'unmarked', 'unspecified', False, False, 'second'), ('p9', '13:45:39', 'Q', 1, 'derived', 'derived', 'unmarked', 'unspecified', False, False, 'second'),
        ('q1', '14:18:54', 'R', 5, 'due', 'predicted', 'peer', 'task', False, False, 'second'), ('q2', '03:54', '-', 0, 'now', 'reported', 'unmarked', 'unspecified', False, False, 'minute'),
        ('q4', '10:00', '-', 0, 'unspecified', 'unspecified', 'unmarked', 'unspecified', False, False, 'minute'), ('q4', '11:00:01', 'G', 4, 'unspecified', 'unspecified', 'unmarked', 'unspecified', True, False, 'second'),
    ]),
    "fx_contradictions": ("writer post_a post_b n_agree n_disagree max_gap_s", [
        ('w1', 'p1', 'p2', 0, 1, 14120), ('w1', 'p1', 'p3', 1, 0, -1), ('w1', 'p2', 'p3', 0, 1, 13820),
    ]),
    "fx_task_clashes": ("writer family", [
        ('w1', 'f'), ('w1', 'g'),
    ]),
    "fx_merge_candidates": ("writer_a writer_b n_keys same_date contested", [
        ('w1', 'w2', 1, True, True),
    ]),
    "fx_placeable": ("rev target", [
        ('o1', 'T1'),
    ]),
    "fx_contained": ("rev target", [
        ('o1', 'GusScoutApr02'), ('o2', 'GusScoutApr02'),
    ]),
    "fx_aliases": ("name_a name_b", [
        ('ADA', 'Ada'), ('ADA', 'AdaMar13'), ('ADA', 'AdaMay01'), ('Ada', 'AdaMar13'),
    ]),
    "fx_same_agents": ("a b same", [
        ('Ada', 'AdaScout', True), ('Ada', 'Bea', False), ('AdaMar13', 'AdaMay01', True), ('AdaMar13X', 'ada', True), ('Mar13Ada_', 'ada', True),
    ]),
    "fx_saves": ("name t writer", [
        ('Ada', 5, 'w1'), ('Bea', 5, 'w2'),
    ]),
    "fx_calls": ("rev name part signed_as", [
        ('e1', 'Ada', 1, '-'), ('e2', 'Ada', 2, '-'), ('e3', 'Bea', 1, '-'), ('e4', 'Ada', 2, 'Bea'), ('e5', 'Bea', 1, 'Cy'), ('e6', 'AdaMar13', 1, '-'), ('e7', 'Bea', 1, 'Dee'), ('e9', 'Eve', 1, '-'), ('f1', 'Fay', 1, '-'),
        ('g1', 'GusScoutApr02', 1, '-'), ('g2', 'GusScoutApr02', 1, '-'), ('g3', 'GusScoutApr02Helper', 1, '-'), ('u1', 'Eve', 1, '-'),
    ]),
    "fx_call_problems": ("call_no problem", [
        (1, 'merge into itself'), (2, 'unknown name'), (3, 'no target'), (4, 'unknown decision'), (5, 'revision in two calls'), (7, 'unknown revision'),
    ]),
    "fx_proposals": ("rev name signed_as proposed", [
        ('e1', 'Ada', '-', False), ('e2', 'Ada', '-', False), ('e3', 'Ada', 'Bea', True), ('e4', 'Bea', '-', False), ('e5', 'Cy', '-', False), ('e6', 'AdaMar13', '-', False), ('e7', 'Dee', '-', False), ('e8', 'Dee', '-', False),
        ('e9', 'Eve', '-', False), ('f1', 'Bea', 'Fay', True), ('g1', 'GusScoutApr02', '-', False), ('g2', 'GusScoutApr02', '-', False), ('g3', 'GusScoutApr02Helper', '-', False), ('u1', 'Ada', '-', True),
    ]),
    "fx_proposal_conflicts": ("rev n_names", [
        ('e5', 2),
    ]),
    "fx_placement": ("rev name part signed_as how", [
        ('e1', 'Ada', 1, '-', 'signed'), ('e2', 'Ada', 2, '-', 'signed'), ('e3', 'Bea', 1, '-', 'signed'), ('e4', 'Ada', 2, 'Bea', 'signed'), ('e5', 'Bea', 1, 'Cy', 'signed'), ('e6', 'Ada', 2, 'AdaMar13', 'alias'),
        ('e7', 'Bea', 1, 'Dee', 'signed'), ('e9', 'Eve', 1, '-', 'signed'), ('f1', 'Fay', 1, '-', 'signed'), ('g1', 'GusScoutApr02', 1, '-', 'signed'), ('g2', 'GusScoutApr02', 1, '-', 'signed'),
        ('g3', 'GusScoutApr02', 1, 'GusScoutApr02Helper', 'containment'), ('u1', 'Eve', 1, '-', 'signed'), ('u2', 'Fay', 1, '-', 'proposed'),
    ]),
    "fx_verdicts": ("target verdict assign_to verdict_from tags notes", [
        ('t1', 'reject', 'v', 'edit', 'b', 'first,second'), ('t2', '-', '-', '-', '', ''), ('t3', 'reassign', 'v', 'posts', 'k,m', 'n'), ('t4', 'confirm', '-', 'posts', '', ''), ('t5', 'reject', '-', 'edit', '', ''),
        ('t6', 'confirm', '-', 'posts', '', ''), ('t7', '-', '-', '-', '', ''), ('t8', '-', '-', '-', 'only', ''),
    ]),
    "fx_merged_claims": ("edit writer section rules n_posts", [
        ('e1', 'v', 'weak', '', 1), ('e1', 'w', 'strong', 'R2,R1', 2), ('e2', 'w', 'odd', 'R9', 1),
    ]),
    "fx_nulls_last": ("id place first", [
        (1, 4, 'b'), (2, 6, 'x'), (3, 2, 'a'), (4, 3, 'a'), (5, 5, '~'), (6, 1, 'v'),
    ]),
}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of a literal table."""
    listed = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {listed}) AS v({', '.join(columns.split())})"


ORACLE = {name: _values(*table) for name, table in EXPECTED.items()}
