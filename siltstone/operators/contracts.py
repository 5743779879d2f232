"""Joins that promise something about their keys, and proofs about rows.

A join with a contract first finds what breaks it (a key missing on a side, twice
on a side) by aggregation, and raises with one such key; what passes is joined as
usual. The check and the join read the same shuffle of narrow keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractBroken(ValueError):
    """A key that breaks what a join or a table promises."""


def key_faults(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, fault): keys that some side lacks ('missing in x') or has more than
    once ('repeated in x'), and null keys ('null in x')."""
    counted = [df.select(F.col(key).alias("key"), F.lit(name).alias("side")) for name, df in sides.items()]
    whole = reduce(DataFrame.unionByName, counted).groupBy("key").agg(*[F.count_if(F.col("side") == n).alias(n) for n in sides])
    found = F.array_compact(F.array(*[x for n in sides for x in (
        F.when(F.col("key").isNull() & (F.col(n) > 0), f"null in {n}"), F.when(F.col("key").isNotNull() & (F.col(n) == 0), f"missing in {n}"), F.when(F.col("key").isNotNull() & (F.col(n) > 1), f"repeated in {n}"))]))
    return whole.select(F.col("key").cast("string").alias("key"), F.explode(found).alias("fault"))


def require_equal_keys(sides: dict[str, DataFrame], key: str) -> None:
    """Raises ContractBroken unless all sides have the same keys, each once."""
    bad = key_faults(sides, key).orderBy("fault", "key").first()
    if bad:
        raise ContractBroken(f"{key} {bad['key']}: {bad['fault']}")


def aligned_join(sides: dict[str, DataFrame], key: str, checked: bool = True) -> DataFrame:
    """Sides joined one to one on a key that all of them have; columns other than
    the key are named side_column."""
    if checked:
        require_equal_keys(sides, key)
    named = [df.select(key, *[F.col(c).alias(f"{n}_{c}") for c in df.columns if c != key]) for n, df in sides.items()]
    return reduce(lambda a, b: a.join(b, key), named)


def prefix_join(prefixes: DataFrame, prefix: str, rows: DataFrame, key: str) -> DataFrame:
    """Rows joined to the prefixes that their key begins with, by an equi-join for
    each length of prefix (which are few)."""
    lengths = sorted(r[0] for r in prefixes.select(F.length(prefix)).distinct().limit(257).collect() if r[0])
    if len(lengths) > 256:
        raise ValueError("prefixes of more than 256 lengths")
    cut = rows.withColumn("_at", F.explode(F.array(*map(F.lit, lengths)))).withColumn(prefix, F.expr(f"left({key}, _at)")).filter(F.length(prefix) == F.col("_at")).drop("_at")
    return cut.join(prefixes.filter(F.length(prefix) > 0), prefix)


def equality_flags(left: DataFrame, right: DataFrame, block: list[str], columns: list[str], key: str) -> DataFrame:
    """(left, right, same_c ...) of all pairs of failures within a block."""
    a = left.select(*block, F.col(key).alias("left"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = right.select(*block, F.col(key).alias("right"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    return a.join(b, block).select("left", "right", *[F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")).alias(f"same_{c}") for c in columns])


def positional_join(left: DataFrame, right: DataFrame, position: str, prompt: str) -> DataFrame:
    """Pairs at one position with one prompt; other columns named left_, right_."""
    named = lambda df, n: df.select(position, prompt, *[F.col(c).alias(f"{n}_{c}") for c in df.columns if c not in (position, prompt)])
    return named(left, "left").join(named(right, "right"), [position, prompt])


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, changed): names of the fields that differ between two runs' rows."""
    j = before.alias("b").join(after.alias("a"), key)
    return j.select(key, F.array_compact(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields])).alias("changed"))


def listed(rows: DataFrame, manifest: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Rows that a manifest lists, with their position in it."""
    return rows.join(manifest.select(key, position), key)


def first_listed(manifest: DataFrame, n: int, position: str = "position") -> DataFrame:
    """The first ``n`` entries of a manifest, in its order."""
    return manifest.orderBy(position).limit(n)


def uniqueness(rows: DataFrame, *keys: str) -> DataFrame:
    """One row: rows, and for each key whether no two rows share it."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), *[(F.count_distinct(k) == F.count(F.lit(1))).alias(f"{k}_unique") for k in keys])


def failures(records: DataFrame, correct: Column, error: Column) -> DataFrame:
    """Rows that ran and are wrong."""
    return records.filter(~correct & error.isNull())


def pair_policy(jaccard: Column, similarity: Column, exact: Column, template: Column, structure: Column, same_frame: Column, same_signature: Column, policy: dict) -> Column:
    """struct(outcome, reason) of a pair of a set that shall be diverse. A policy
    has ngram_reject, reject and review; with ``evidence`` (reject_ngram,
    review_ngram, frame_review) a similarity counts only with support."""
    said = lambda outcome, reason: F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason"))
    rules = [(exact, "reject", "exact_normalized_text"), (template, "reject", "numeric_template_copy"), (structure, "reject", "latent_structure_copy"), (jaccard >= policy["ngram_reject"], "reject", "token_ngram_overlap")]
    support = policy.get("evidence")
    if support is None:
        rules += [(similarity >= policy["reject"], "reject", "semantic_similarity"), (similarity >= policy["review"], "manual_review", "semantic_similarity_band")]
    else:
        signed = same_signature if support.get("signature", True) else F.lit(False)
        rules += [((similarity >= policy["reject"]) & ((jaccard >= support["reject_ngram"]) | signed), "reject", "supported_semantic_duplicate"),
                  ((similarity >= policy["review"]) & ((jaccard >= support["review_ngram"]) | signed | (same_frame & (similarity >= support["frame_review"]))), "manual_review", "supported_semantic_review")]
    return F.coalesce(*[F.when(c, said(o, r)) for c, o, r in rules], said("pass", "all_checks_passed"))


def reuse_policy(exact: Column, latent: Column, neutral: Column, plan_use: Column, plan_cap: Column, neutral_use: Column, neutral_cap: Column, paraphrase: Column, same_plan: Column, one_use: bool = False, capped: bool = True, paraphrase_outcome: str = "manual_review") -> Column:
    """struct(outcome, reason) of a use of bounded surface forms."""
    said = lambda outcome, reason: F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason"))
    rules = [(exact, "reject", "exact_complete_candidate"), (latent, "reject", "latent_program_copy")]
    if one_use:
        rules.append((neutral, "reject", "legacy_number_neutral_one_use"))
    if capped:
        rules += [(plan_use > plan_cap, "reject", "sentence_plan_cap_exceeded"), (neutral_use > neutral_cap, "reject", "number_neutral_cap_exceeded")]
    rules.append((paraphrase & ~same_plan, paraphrase_outcome, "cross_plan_close_paraphrase"))
    return F.coalesce(*[F.when(c, said(o, r)) for c, o, r in rules], said("pass", "bounded_distinct_example"))


def update_outcome(variance: Column, advantages: Column, rates: Column, gradient: Column, gradient_tensors: Column, delta: Column, delta_tensors: Column, complete: Column) -> Column:
    """The class of an attempted update; anything missing, not finite or
    contradictory is invalid."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    filled = lambda a: a.isNotNull() & (F.size(a) > 0) & F.forall(a, finite)
    still = F.forall(advantages, lambda x: x == 0)
    ok = complete & filled(advantages) & filled(rates) & F.forall(rates, lambda x: x >= 0)
    for x in (variance, gradient, delta):
        ok = ok & finite(x) & (x >= 0)
    ok = ok & (gradient_tensors >= 0) & (delta_tensors >= 0) & ((gradient == 0) == (gradient_tensors == 0)) & ((delta == 0) == (delta_tensors == 0)) & ((variance == 0) == still)
    flat, fixed, idle = gradient == 0, delta == 0, F.forall(rates, lambda x: x == 0)
    return (F.when(~F.coalesce(ok, F.lit(False)), "invalid_or_ambiguous").when(~still & flat, "unexpected_zero_gradient").when(still & flat & fixed, "expected_zero_advantage_noop")
            .when(~still & ~flat & idle & fixed, "expected_zero_lr_warmup_noop").when(~idle & ~flat & fixed, "unexpected_positive_lr_no_update").when(~idle & ~flat & ~fixed, "nonzero_policy_update").otherwise("invalid_or_ambiguous"))


def calibration(fixtures: DataFrame, due: str, policies: list[str]) -> DataFrame:
    """(policy, exact, escapes, false_rejections) of flags that let a fixture pass."""
    one = fixtures.agg(*[x for p in policies for x in (F.count_if(F.col(p) == F.col(due)).alias(f"e_{p}"), F.count_if(F.col(p) & ~F.col(due)).alias(f"x_{p}"), F.count_if(~F.col(p) & F.col(due)).alias(f"f_{p}"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(f"e_{p}").alias("exact"), F.col(f"x_{p}").alias("escapes"), F.col(f"f_{p}").alias("false_rejections")) for p in policies])).alias("x")).select("x.*")


def audit_bounds(classified: DataFrame) -> DataFrame:
    """One row from flags (intended, false, ambiguous): counts, the accuracy that is
    sure and the one that is possible, and the decision."""
    n, i, f, a = F.count(F.lit(1)), F.count_if("intended"), F.count_if("false"), F.count_if("ambiguous")
    decision = F.when(f + a == 0, "trusted").when(a == 0, "usable_with_adjustment").otherwise("reconsider")
    return classified.agg(i.alias("intended"), f.alias("false_acceptances"), a.alias("ambiguous"), (i / n).alias("lower_accuracy"), ((i + a) / n).alias("upper_accuracy"), decision.alias("decision"))


def trajectories(metrics: DataFrame, arm: str, suite: str, step: str, value: str) -> DataFrame:
    """(suite, risen, fallen, largest_gap): arms whose last step is over or under
    their first, and the largest difference between arms at one step."""
    ends = metrics.groupBy(arm, suite).agg(F.min_by(value, step).alias("_a"), F.max_by(value, step).alias("_z"))
    moved = ends.groupBy(suite).agg(F.count_if(F.col("_z") > F.col("_a")).alias("risen"), F.count_if(F.col("_z") < F.col("_a")).alias("fallen"))
    gaps = metrics.groupBy(suite, step).agg((F.max(value) - F.min(value)).alias("_g")).groupBy(suite).agg(F.max("_g").alias("largest_gap"))
    return moved.join(gaps, suite)


def closest_across(values: DataFrame, arm: str, value: str) -> DataFrame:
    """One row ``gap``: the least difference of values of different arms. In the
    order of values the closest pair are neighbours; the last of a range meets the
    next range through its bounds."""
    from siltstone.operators.ranks import ordinal

    placed = ordinal(values, [], [value, arm], "_n").select("_n", F.col(arm).alias("_a"), F.col(value).alias("_v"))
    after = placed.select((F.col("_n") - 1).alias("_n"), F.col("_a").alias("_b"), F.col("_v").alias("_w"))
    return placed.join(after, "_n").filter("_a <> _b").agg(F.min(F.col("_w") - F.col("_v")).alias("gap"))
