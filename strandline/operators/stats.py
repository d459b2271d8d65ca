"""Statistics as DataFrame operators: stratified odds ratios, at-risk rows, permutation, bootstrap, leave-one-out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96
#: A stratum's shuffles are drawn in blocks of so many.
REPS_A_BLOCK = 500


def strata_counts(rows: DataFrame, *, stratum: list[str], exposed: str, outcome: str) -> DataFrame:
    """(*stratum, a, b, c, d): exposed with and without the outcome, unexposed with and without it."""
    e, y = F.col(exposed).cast("boolean"), F.col(outcome).cast("boolean")
    return rows.groupBy(*stratum).agg(F.count_if(e & y).alias("a"), F.count_if(e & ~y).alias("b"), F.count_if(~e & y).alias("c"), F.count_if(~e & ~y).alias("d"))


def mantel_haenszel(strata: DataFrame) -> DataFrame:
    """One row (n_strata, odds_ratio, ci_low, ci_high) of 2x2 counts a, b, c, d.

    Strata of fewer than two rows, or without exposed or unexposed rows, are left out. The interval is the one of
    Robins, Breslow and Greenland at 95 %. Null where either sum is zero.
    """
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    used = strata.where((n >= 2) & (F.col("a") + F.col("b") > 0) & (F.col("c") + F.col("d") > 0))
    r, s, p, q = F.col("a") * F.col("d") / n, F.col("b") * F.col("c") / n, (F.col("a") + F.col("d")) / n, (F.col("b") + F.col("c")) / n
    sums = used.agg(F.count(F.lit(1)).alias("n_strata"), F.sum(r).alias("r"), F.sum(s).alias("s"), F.sum(p * r).alias("pr"), F.sum(p * s + q * r).alias("mixed"), F.sum(q * s).alias("qs"))
    sums = sums.withColumn("r", F.nullif("r", F.lit(0.0))).withColumn("s", F.nullif("s", F.lit(0.0)))
    ratio = F.col("r") / F.col("s")
    variance = F.col("pr") / (2 * F.col("r") * F.col("r")) + F.col("mixed") / (2 * F.col("r") * F.col("s")) + F.col("qs") / (2 * F.col("s") * F.col("s"))
    half = F.exp(F.lit(Z95) * F.sqrt(variance))
    return sums.select("n_strata", ratio.alias("odds_ratio"), (ratio / half).alias("ci_low"), (ratio * half).alias("ci_high"))


def at_risk(rows: DataFrame, *, agent: str, time: str, outcome: Column, tie: str) -> DataFrame:
    """The rows of each agent up to and including its first outcome: all if it has none. Ordered by (time, tie).

    The first outcome is an aggregate joined back, so an agent's rows are never sorted in one task.
    """
    first = rows.where(outcome).groupBy(agent).agg(F.min(F.struct(F.col(time).alias("t"), F.col(tie).alias("i"))).alias("__first"))
    joined = rows.join(first, agent, "left")
    return joined.where(F.col("__first").isNull() | (F.struct(F.col(time).alias("t"), F.col(tie).alias("i")) <= F.col("__first"))).drop("__first")


def shuffled_hits(pairs: np.ndarray, seen: np.ndarray, reps: int, rng: np.random.Generator) -> np.ndarray:
    """Of each of ``reps`` shuffles of a stratum's values among its items, how many items see the value they get.

    pairs: the count of each (set, value); seen: which values each set holds. Where sets times values are
    fewer than the items, a shuffle's table of counts is drawn with its margins fixed, cell by cell, which has the same
    distribution and costs the same for any number of items (under 10^9 a stratum); otherwise the values are dealt one by one.
    """
    of_set, of_value = pairs.sum(1), pairs.sum(0)
    hits = np.zeros(reps, np.int64)
    if pairs.size >= of_set.sum():
        sets, values = np.repeat(np.arange(len(of_set)), of_set), np.repeat(np.arange(len(of_value)), of_value)
        for k in range(reps):
            hits[k] = np.count_nonzero(seen[sets, rng.permutation(values)])
        return hits
    left = np.tile(of_value, (reps, 1))
    for size, held in zip(of_set, seen):
        need, rest = np.full(reps, size), left.sum(1)
        for v in range(len(of_value)):
            rest = rest - left[:, v]
            got = need if v == len(of_value) - 1 else rng.hypergeometric(left[:, v], rest, need)
            left[:, v] -= got
            need = need - got
            if held[v]:
                hits += got
    return hits


def permutation_test(items: DataFrame, *, item: str, stratum: str, own: str, visible: str, reps: int, seed: int = 1, by: str | None = None, weight: str | None = None) -> DataFrame:
    """One row (n_items, observed, null_mean, excess, p_value): do own values agree with the visible ones beyond chance?

    items: own a value, visible an array of values; rows with an empty one are left out first; item only names them. In each of ``reps`` shuffles the own
    values are dealt anew within their stratum, by a generator keyed with seed, stratum and shuffles, so the result doesn't hang on
    how rows are placed. observed counts items whose own value is visible; p is (1 + shuffles at or above it) / (reps + 1). With
    ``by``, a row for each of its values, which comes first; with ``weight``, a row stands for so many items.

    Only counts of (stratum, own, visible) are shuffled; a stratum's shuffles are drawn in blocks by Arrow batches.
    """
    kept = items.where(F.col(own).isNotNull() & (F.size(visible) > 0)).select((F.col(by) if by else F.lit(0)).alias("b"), F.col(stratum).alias("s"), F.col(own).alias("o"), F.sort_array(F.array_distinct(visible)).alias("v"), (F.col(weight) if weight else F.lit(1)).alias("n"))
    counts = kept.groupBy("b", "s", "o", "v").agg(F.sum("n").alias("n"))
    observed = counts.groupBy("b").agg(F.sum("n").alias("n_items"), F.sum(F.when(F.array_contains("v", F.col("o")), F.col("n")).otherwise(0)).alias("observed"))

    def deal(group: pa.Table) -> pa.Table:
        own_values, sets, n = group["o"].to_pylist(), [tuple(v) for v in group["v"].to_pylist()], group["n"].to_pylist()
        values, kinds = {o: k for k, o in enumerate(sorted(set(own_values), key=repr))}, {v: k for k, v in enumerate(sorted(set(sets), key=repr))}
        pairs, seen = np.zeros((len(kinds), len(values)), np.int64), np.zeros((len(kinds), len(values)), bool)
        for o, v, c in zip(own_values, sets, n):
            pairs[kinds[v], values[o]] = c
        for v, k in kinds.items():
            seen[k, [values[o] for o in set(v) if o in values]] = True
        block = group["block"][0].as_py()
        many = min(REPS_A_BLOCK, reps - block * REPS_A_BLOCK)
        rng = np.random.default_rng([seed, group["key"][0].as_py() & 0xFFFFFFFFFFFFFFFF, block])
        return pa.table({"b": pa.repeat(group["b"][0], many), "rep": pa.array(np.arange(many) + block * REPS_A_BLOCK), "hits": pa.array(shuffled_hits(pairs, seen, many, rng))})

    each = counts.withColumn("key", F.xxhash64("b", "s")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // REPS_A_BLOCK))))
    # So few bytes would be one task; a number given is kept.
    each = each.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "b", "s", "block")
    dealt = each.groupBy("b", "s", "block").applyInArrow(deal, f"b {kept.schema['b'].dataType.simpleString()}, rep long, hits long")
    nulls = dealt.groupBy("b", "rep").agg(F.sum("hits").alias("hits"))
    total = nulls.join(observed, "b").groupBy("b", "n_items", "observed").agg(F.avg("hits").alias("null_mean"), F.count_if(F.col("hits") >= F.col("observed")).alias("above"))
    return total.select(*([F.col("b").alias(by)] if by else []), "n_items", "observed", "null_mean", (F.col("observed") - F.col("null_mean")).alias("excess"), ((1 + F.col("above")) / F.lit(reps + 1)).alias("p_value"))


def calibrated(tests: DataFrame, *, trial: str) -> DataFrame:
    """One row (n_trials, observed_ratio, median, low, high, p_value) of the rows of ``permutation_test`` by trial: 0 the real values, others dealt ones.

    A trial's ratio is observed / null_mean, and null ones are left out; median (the upper one), low and high are of the dealt trials, and p is (1 + trials at or
    above the real ratio) / (n_trials + 1). Nulls if there is no trial 0 or no other.
    """
    ratio = F.col("observed") / F.nullif("null_mean", F.lit(0.0))
    one = tests.agg(F.max(F.when(F.col(trial) == 0, ratio)).alias("observed_ratio"), F.array_sort(F.collect_list(F.when(F.col(trial) != 0, ratio))).alias("x"))  # as many numbers as there are trials
    n = F.size("x")
    pick = lambda k: F.when(n > 0, F.get("x", k))
    above = F.size(F.filter("x", lambda r: r >= F.col("observed_ratio")))
    return one.select(n.alias("n_trials"), "observed_ratio", pick((n / 2).cast("int")).alias("median"), pick(F.lit(0)).alias("low"), pick(n - 1).alias("high"), F.when((n > 0) & F.col("observed_ratio").isNotNull(), (1 + above) / (n + 1)).alias("p_value"))


def cluster_bootstrap(rows: DataFrame, *, cluster: str, hit: str, decoy: str, reps: int = 1000, seed: int = 1, least: int = 10) -> DataFrame:
    """One row (n, excess, ci_low, ci_high): mean hit minus mean decoy, with the 2.5 % and 97.5 % order statistics of ``reps`` resamples of clusters.

    A cluster's weight in a resample is Poisson with mean 1, drawn by a keyed hash: the distributed form of drawing clusters with
    replacement. Clusters are summed up first, so a resample works on cluster sums and never on rows. No row at all if there are
    fewer than ``least`` rows.
    """
    sums = rows.groupBy(F.col(cluster).alias("c")).agg(F.sum(F.col(hit).cast("double")).alias("h"), F.sum(F.col(decoy).cast("double")).alias("d"), F.count(F.lit(1)).alias("n"))
    whole = sums.agg(F.sum("n").alias("n"), ((F.sum("h") - F.sum("d")) / F.sum("n")).alias("excess")).where(F.col("n") >= least)
    u = (F.pmod(F.xxhash64(F.lit(seed), "rep", "c"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    edges, p, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += p
        edges.append(total)
        p /= k + 1
    weight = sum(((u > e).cast("int") for e in edges[1:]), (u > edges[0]).cast("int"))
    drawn = sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("w", weight)
    stats = drawn.groupBy("rep").agg(F.sum(F.col("w") * (F.col("h") - F.col("d"))).alias("x"), F.sum(F.col("w") * F.col("n")).alias("m")).where(F.col("m") > 0).select((F.col("x") / F.col("m")).alias("x"))
    ordered = stats.agg(F.array_sort(F.collect_list("x")).alias("xs"))  # as many numbers as there are resamples
    pick = lambda share: F.element_at("xs", F.greatest(F.lit(1), (F.size("xs") * share).cast("int") + 1))
    return whole.crossJoin(F.broadcast(ordered)).select("n", "excess", F.least(pick(0.025), pick(0.974)).alias("ci_low"), F.greatest(pick(0.025), pick(0.974)).alias("ci_high"))


def leave_one_out(rows: DataFrame, *, row: str, group: str, candidate: str, trait: str) -> DataFrame:
    """(row, group, candidate, credit): how well the trait of each row tells its candidate from the others of its group.

    A candidate's score is its share of the trait over all its other rows, with 0.5 added to each count over the traits that
    exist; the best of the group's candidates get 1 between them. Groups of one candidate are left out; so are rows with a null.

    Only a row's own candidate loses the row from its counts, so the others' scores hang on (candidate, trait) alone. The two best scores of each
    group and trait, with how many have them, are aggregates of candidates times traits; rows never meet candidates.
    """
    r = rows.select(F.col(row).alias("r"), F.col(group).alias("g"), F.col(candidate).alias("c"), F.col(trait).alias("f")).where("r IS NOT NULL AND g IS NOT NULL AND c IS NOT NULL AND f IS NOT NULL")
    by_trait = r.groupBy("c", "f").agg(F.count(F.lit(1)).alias("n_f"))
    totals = r.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = r.agg(F.countDistinct("f").alias("v"))  # one row
    members, traits = r.select("g", "c").distinct(), r.select("g", "f").distinct()
    many = members.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= 2).select("g")
    scores = (
        members.join(many, "g").join(traits, "g").join(by_trait, ["c", "f"], "left").join(totals, "c").crossJoin(F.broadcast(vocabulary))
        .withColumn("score", (F.coalesce("n_f", F.lit(0)) + 0.5) / (F.col("n") + 0.5 * F.col("v")))
    )
    counted = scores.groupBy("g", "f", "score").agg(F.count(F.lit(1)).alias("k"))
    first = counted.groupBy("g", "f").agg(F.max(F.struct("score", "k")).alias("one"))
    second = counted.join(first, ["g", "f"]).where(F.col("score") < F.col("one.score")).groupBy("g", "f").agg(F.max(F.struct("score", "k")).alias("two"))
    best = first.join(second, ["g", "f"], "left")
    own = r.join(best, ["g", "f"]).join(by_trait, ["c", "f"]).join(totals, "c").crossJoin(F.broadcast(vocabulary))
    with_row = (F.col("n_f") + 0.5) / (F.col("n") + 0.5 * F.col("v"))
    without = (F.col("n_f") - 1 + 0.5) / (F.col("n") - 1 + 0.5 * F.col("v"))
    alone_best = (with_row == F.col("one.score")) & (F.col("one.k") == 1)
    rival = F.when(alone_best, F.col("two.score")).otherwise(F.col("one.score"))
    rivals = F.when(alone_best, F.col("two.k")).otherwise(F.col("one.k") - (with_row == F.col("one.score")).cast("int"))
    credit = F.when(rival.isNull() | (without > rival), 1.0).when(without == rival, 1.0 / (rivals + 1)).otherwise(0.0)
    return own.select(F.col("r").alias(row), F.col("g").alias(group), F.col("c").alias(candidate), credit.alias("credit"))


def circular_gap(a: Column, b: Column, period: int = 86_400) -> Column:
    """Distance of two seconds of the day around the clock."""
    d = F.pmod(F.abs(a - b), F.lit(period))
    return F.least(d, F.lit(period) - d)


def ordered_mode(rows: DataFrame, *, by: str, value: str, first: str) -> DataFrame:
    """(by, value, n, purity): the commonest value of each ``by``; of equals the one seen first (least ``first``, then least value)."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("f"))
    total = counts.groupBy(by).agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("m"), F.col("f"), F.col(value).alias("v"), F.col("n"))).alias("best"))
    return total.select(by, F.col("best.v").alias(value), F.col("best.n").alias("n"), (F.col("best.n") / F.col("all")).alias("purity"))


def at_ranks(rows: DataFrame, *, by: str, value: str, ranks: dict[str, Column], width: float = 1.0) -> DataFrame:
    """(by, *ranks): the values of each group at given ranks from 1; ranks: expressions over ``n``, the group's size.

    Values are counted by buckets of ``width`` first; only the buckets that hold a wanted rank are put in order, so a group with all the rows is never sorted in one task.
    """
    from pyspark.sql import Window

    r = rows.where(F.col(by).isNotNull() & F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).alias("v"), F.floor(F.col(value) / width).alias("b"))
    counts = r.groupBy("g", "b").agg(F.count(F.lit(1)).alias("m"))
    sizes = counts.groupBy("g").agg(F.sum("m").alias("n"))
    upto = counts.withColumn("after", F.sum("m").over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = sizes.select("g", F.explode(F.array(*[F.struct(F.lit(k).alias("what"), c.cast("bigint").alias("rank")) for k, c in ranks.items()])).alias("w")).select("g", "w.*")
    held = upto.join(wanted, "g").where((F.col("rank") <= F.col("after")) & (F.col("rank") > F.col("after") - F.col("m"))).select("g", "b", "what", (F.col("rank") - F.col("after") + F.col("m")).alias("place"))
    near = r.join(held.select("g", "b").distinct(), ["g", "b"]).withColumn("place", F.row_number().over(Window.partitionBy("g", "b").orderBy("v")))
    return near.join(held, ["g", "b", "place"]).groupBy(F.col("g").alias(by)).agg(*[F.max(F.when(F.col("what") == k, F.col("v"))).alias(k) for k in ranks])
