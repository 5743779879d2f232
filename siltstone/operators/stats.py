"""Summaries, balance, paired statistics and reward-group diagnostics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.draws import drawn_sums

# Fixed value: the 97.5th percentile of the normal distribution.
Z = 1.959963984540054


def rate(hits: Column, total: Column) -> Column:
    return F.try_divide(hits.cast("double"), total)


def evaluation_summary(records: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of (correct, extractable, exact_format, truncated,
    input_tokens, output_tokens); averages leave out nulls."""
    n, c, e = F.count(F.lit(1)), F.count_if("correct"), F.count_if("extractable")
    return records.groupBy(*by).agg(
        n.alias("examples"), c.alias("correct"), e.alias("extractable"), F.count_if("exact_format").alias("exact_format"), F.count_if("truncated").alias("truncated"),
        rate(c, n).alias("accuracy"), rate(e, n).alias("extraction_rate"), rate(c, e).alias("accuracy_extractable"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.avg("output_tokens").alias("mean_output_tokens"))


def rescore_summary(records: DataFrame) -> DataFrame:
    """Counts over (exact, value, expected, category) of rescored responses."""
    return records.agg(F.count(F.lit(1)).alias("examples"), F.count_if("exact").alias("exact_format"), F.count("value").alias("extractable"), F.count_if(F.col("value") == F.col("expected")).alias("correct"), F.count_if(F.col("value").isNull()).alias("rejected"),
                       F.count_if(F.col("category") == "conflicting_answers").alias("conflicting"), F.count_if(F.col("category") == "generation_truncated").alias("truncated"))


def reward_summary(rewards: DataFrame, *by: str) -> DataFrame:
    """Totals over (total, correct, penalised) of rewarded completions."""
    return rewards.groupBy(*by).agg(F.count(F.lit(1)).alias("completions"), F.round(F.sum("total"), 6).alias("total"), F.count_if("correct").alias("correct"), F.count_if("penalised").alias("penalised"))


def failure_counts(records: DataFrame) -> DataFrame:
    """Overlapping failure counts of the records, in one pass."""
    wrong = ~F.col("correct")
    return records.agg(
        F.count(F.lit(1)).alias("examples"), F.count_if("correct").alias("correct"), F.count_if(wrong).alias("wrong"), F.count_if(wrong & F.col("extractable")).alias("wrong_extractable"),
        F.count_if(~F.col("extractable")).alias("not_extractable"), F.count_if("truncated").alias("truncated"), F.count_if("failed").alias("generation_failures"), F.count_if(~F.col("exact_format")).alias("inexact_format"))


def margins(rows: DataFrame, sets: list[list[str]], distinct: dict[str, str] | None = None) -> DataFrame:
    """Counts for several groupings in one pass; columns out of a set are null.
    ``distinct``: names of distinct counts and what they count."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(n) for n, c in (distinct or {}).items()])


def distribution(rows: DataFrame, value: str, *by: str, points=(25, 50, 75, 90, 95, 99)) -> DataFrame:
    """Count, extremes, mean, deviations and exact, linearly interpolated
    percentiles. Values are counted first, so a group's state is its distinct
    values, not its rows."""
    v, n = F.col("_v"), F.col("_n")
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    whole, mean = F.sum("_n"), F.sum(v * n) / F.sum("_n")
    out = counted.groupBy(*by).agg(whole.alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), mean.alias("mean"), *[F.percentile(v, p / 100, n).alias(f"p{p}") for p in points])
    # squares about the mean: about zero they would lose digits
    about = counted.join(F.broadcast(out.select(*by, F.col("mean").alias("_m"))), list(by)) if by else counted.crossJoin(F.broadcast(out.select(F.col("mean").alias("_m"))))  # one row
    spread = about.groupBy(*by).agg((F.sum(n * (v - F.col("_m")) * (v - F.col("_m"))) / F.sum("_n")).alias("population_variance"), F.try_divide(F.sum(n * (v - F.col("_m")) * (v - F.col("_m"))), F.sum("_n") - 1).alias("sample_variance"))
    return out.join(spread, list(by)) if by else out.crossJoin(spread)  # one row


def standardized_difference(rows: DataFrame, value: str, arm: str, one, two, *by: str) -> DataFrame:
    """|mean difference| over the root of the mean sample variance; without
    variance 0 for equal means, else infinite."""
    v = lambda a: F.when(F.col(arm) == a, F.col(value))
    out = rows.groupBy(*by).agg(F.avg(v(one)).alias("_m1"), F.avg(v(two)).alias("_m2"), F.var_samp(v(one)).alias("_v1"), F.var_samp(v(two)).alias("_v2"))
    gap, pooled = F.abs(F.col("_m1") - F.col("_m2")), (F.coalesce("_v1", F.lit(0.0)) + F.coalesce("_v2", F.lit(0.0))) / 2
    return out.select(*by, F.when(pooled > 0, gap / F.sqrt(pooled)).when(gap == 0, 0.0).otherwise(F.lit(float("inf"))).alias("smd"))


def moments(rows: DataFrame, values: list[str], name: str) -> DataFrame:
    """One row: {name}_n, and {name}_s_v and {name}_q_v, the sums of each value and
    of its square."""
    v = lambda c: F.col(c).cast("double")
    return rows.agg(F.count(F.lit(1)).alias(f"{name}_n"), *[F.sum(v(c)).alias(f"{name}_s_{c}") for c in values], *[F.sum(v(c) * v(c)).alias(f"{name}_q_{c}") for c in values])


def largest_gap(n: Column, s: Column, q: Column, m: Column, t: Column, r: Column) -> Column:
    """The standardized difference from counts, sums and sums of squares."""
    gap = F.abs(s / n - t / m)
    pooled = F.sqrt(F.greatest(F.lit(0.0), ((q - s * s / n) / (n - 1) + (r - t * t / m) / (m - 1)) / 2))
    return F.when(pooled > 0, gap / pooled).when(gap == 0, 0.0).otherwise(F.lit(float("inf")))


def categorical_balance(rows: DataFrame, level: str, arm: str, one, two) -> DataFrame:
    """|p1 - p2| of every level of either arm."""
    n = rows.groupBy(F.col(level).alias("level")).agg(F.count_if(F.col(arm) == one).alias("_a"), F.count_if(F.col(arm) == two).alias("_b")).filter("_a + _b > 0")
    whole = rows.agg(F.count_if(F.col(arm) == one).alias("_na"), F.count_if(F.col(arm) == two).alias("_nb"))
    return n.crossJoin(F.broadcast(whole)).select("level", F.abs(rate(F.col("_a"), F.col("_na")) - rate(F.col("_b"), F.col("_nb"))).alias("difference"))  # one row


def wilson_lower(hits: Column, total: Column, z: float = Z) -> Column:
    """The lower bound of Wilson's interval; 0 without trials."""
    n = total.cast("double")
    p = hits / n
    middle = p + z * z / (2 * n)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(total > 0, (middle - spread) / (1 + z * z / n)).otherwise(0.0)


def transitions(rows: DataFrame, *flags: str) -> DataFrame:
    """Counts of each combination of flags."""
    return rows.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


def category_effects(rows: DataFrame, category: str, base: str, one: str, two: str, limit: float = 0.02) -> DataFrame:
    """Accuracies by category, their differences, and whether the second arm is
    no more than ``limit`` below the first."""
    out = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"{c}_accuracy") for c in (base, one, two)])
    delta = F.col(f"{two}_accuracy") - F.col(f"{one}_accuracy")
    return out.withColumn("delta", delta).withColumn("within_limit", delta >= -limit - 1e-12)


def paired_bootstrap(differences: DataFrame, column: str, seed: int, replicates: int, ordered: bool = True) -> DataFrame:
    """The 2.5th and 97.5th percentile of resampled means of -1, 0 and 1.

    ``ordered``: the replicates draw what ``random.Random(seed).randrange`` would,
    in its order (a fixed rule: the high bits of the generator's words, those out
    of range passed over), so the vector of one byte an evaluated item has to come
    to the driver; items x replicates numbers are drawn from it by all tasks. Without it only the
    counts of -1, 0 and 1 matter and are all that is collected: resamples are
    multinomial draws from them, of the same distribution, for any number of items."""
    counts = {r[0]: r[1] for r in differences.groupBy(F.col(column).cast("int")).count().collect()}
    if set(counts) - {-1, 0, 1}:
        raise ValueError("differences are -1, 0 or 1")
    n = sum(counts.values())
    if not n:
        return differences.sparkSession.createDataFrame([], "n int, mean double, low double, high double")
    if ordered:
        if n.bit_length() > 32:
            raise ValueError(f"{n} items take more than a word of the generator a draw; resample by counts")
        values = differences.orderBy("id").select(F.col(column).cast("byte")).toArrow().column(0).to_numpy()
        sums = drawn_sums(differences.sparkSession, values, seed, replicates)
    else:
        drawn = np.random.default_rng(seed).multinomial(n, [counts.get(k, 0) / n for k in (-1, 0, 1)], replicates)
        sums = (drawn[:, 2] - drawn[:, 0]).tolist()
    low, high = (linear_percentile(sorted(s / n for s in sums), p) for p in (0.025, 0.975))
    return differences.sparkSession.createDataFrame([(n, (counts.get(1, 0) - counts.get(-1, 0)) / n, low, high)], "n int, mean double, low double, high double")


def linear_percentile(ordered: list[float], p: float) -> float:
    """Between the two values at p * (n - 1)."""
    low, part = divmod(p * (len(ordered) - 1), 1)
    above = ordered[min(int(low) + 1, len(ordered) - 1)]
    return ordered[int(low)] * (1.0 - part) + above * part


def reward_groups(rows: DataFrame, group: str, reward: str, completion: str, components: list[str] = (), correct: str | None = None) -> DataFrame:
    """Mean, population variance, distinct rewards and completions of a group,
    whether each component is the same for all, and how many are correct."""
    same = F.lit(True)
    for c in components:
        same = same & F.min(c).eqNullSafe(F.max(c))
    finite = F.bool_and(F.col(reward).isNotNull() & ~F.isnan(reward) & (F.abs(reward) < float("inf")))
    right = F.count_if(correct) if correct else F.lit(None).cast("long")
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(reward).alias("mean"), F.var_pop(reward).alias("variance"), F.count_distinct(reward).alias("ranks"), F.count_distinct(completion).alias("completions"), finite.alias("finite"), same.alias("components_equal"), right.alias("correct"))


def advantages(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """Adds ``advantage``: reward less the group's mean."""
    return rows.join(rows.groupBy(group).agg(F.avg(reward).alias("_m")), group).withColumn("advantage", F.col(reward) - F.col("_m")).drop("_m")


def zero_variance_class(groups: DataFrame, size: int | None = None) -> DataFrame:
    """Adds ``outcome``: null where rewards differ, else the first class that
    applies. A group of another size, with a reward that is not finite, or whose
    components differ where its rewards do not, is invalid."""
    wrong_size = F.lit(False) if size is None else F.col("n") != size
    return groups.withColumn("outcome", F.when(wrong_size | ~F.col("finite"), "invalid_or_ambiguous").when(F.col("ranks") > 1, F.lit(None)).when(~F.col("components_equal"), "invalid_or_ambiguous").when(F.col("completions") == 1, "output_identical")
                             .when(F.col("correct") == F.col("n"), "all_correct_saturated").when(F.col("correct") == 0, "all_incorrect_saturated").otherwise("output_diverse_reward_indistinguishable"))


def overlap_rate(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """Shared items over all items, summed over keys that both sides have; counted,
    so no key's items are held together."""
    side = lambda df, n: df.select(key, item, F.lit(n).alias("_w"))
    each = side(left, 1).unionByName(side(right, 2)).groupBy(key, item).agg(F.bit_or("_w").alias("_w"))
    by = each.groupBy(key).agg(F.count_if(F.col("_w") == 3).alias("_s"), F.count(F.lit(1)).alias("_e"), F.bit_or("_w").alias("_w")).filter("_w = 3")
    return by.agg(F.sum("_s").alias("shared"), F.sum("_e").alias("either")).withColumn("rate", rate(F.col("shared"), F.col("either")))


FAN = 4096


def tree_digest(rows: DataFrame, order: str, value: Column) -> DataFrame:
    """One row ``digest``: SHA-256 over the ordered rows, as a tree of fixed fan-out.

    Rows are cut by the leading digits of their rank, not of their key's value, so
    null, repeated and far apart keys do not crowd a node: a range sort numbers the
    partitions' rows, and each level digests FAN consecutive digests of the one
    below. No rows have the digest of the empty string."""
    from siltstone.operators.ranks import ordinal

    level = ordinal(rows.select(F.col(order).alias("_o"), F.sha2(value, 256).alias("_h")), [], ["_o", "_h"], "_n").select("_n", "_h")
    most = rows.count()
    while most > 1:
        level = level.groupBy(F.expr(f"_n div {FAN}").alias("_n")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_h"))), lambda x: x["_h"]), ""), 256).alias("_h"))
        most = -(-most // FAN)
    return level.agg(F.coalesce(F.max("_h"), F.sha2(F.lit(""), 256)).alias("digest"))


def token_kl(policy: Column, reference: Column) -> Column:
    """exp(reference - policy) - (reference - policy) - 1."""
    gap = reference - policy
    return F.expm1(gap) - gap


def clipped_objective(rows: DataFrame, ratio: str, advantage: str, mask: str, clip: float, divisor: float, kl: str | None = None, beta: float = 0.0) -> DataFrame:
    """One row: the masked sum of -min(r a, clip(r) a) over a fixed divisor, beta
    times that of the token KL, and both together."""
    r, a = F.col(ratio), F.col(advantage)
    bound = F.least(F.greatest(r, F.lit(1 - clip)), F.lit(1 + clip))
    masked = lambda x: F.sum(F.when(F.col(mask), x).otherwise(0.0)) / divisor
    policy, far = masked(-F.least(r * a, bound * a)), masked(F.col(kl)) * beta if kl else F.lit(0.0)
    return rows.agg(policy.alias("policy"), far.alias("kl"), (policy + far).alias("objective"))


def norms(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Norms, cosine and the largest entries of two aligned vectors."""
    a, b = F.col(x), F.col(y)
    s = rows.agg(F.sum(a * a).alias("_a"), F.sum(b * b).alias("_b"), F.sum(a * b).alias("_c"), F.max(F.abs(a)).alias("max_x"), F.max(F.abs(b)).alias("max_y"))
    return s.select(F.sqrt("_a").alias("norm_x"), F.sqrt("_b").alias("norm_y"), F.try_divide(F.col("_c"), F.sqrt("_a") * F.sqrt("_b")).alias("cosine"), "max_x", "max_y")
