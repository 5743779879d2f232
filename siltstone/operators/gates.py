"""Pass or fail decisions as frames of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def retention_gate(records: DataFrame, section: str, correct: str, least_section: float, least_overall: float) -> DataFrame:
    """One row: whether every section, and all together, reach their accuracy."""
    s = records.groupBy(section).agg(F.count(F.lit(1)).alias("_n"), F.count_if(correct).alias("_c"))
    each = F.bool_and(F.col("_c") / F.col("_n") >= least_section - TOLERANCE)
    whole = F.sum("_c") / F.sum("_n") >= least_overall - TOLERANCE
    return s.agg(F.count(F.lit(1)).cast("int").alias("sections"), each.alias("sections_pass"), whole.alias("overall_pass")).withColumn("passed", F.col("sections_pass") & F.col("overall_pass"))


def parity_gate(rows: DataFrame, arm: str, one, two, tokens: str, tolerance: float) -> DataFrame:
    """One row: equal row counts, and token sums within the tolerance."""
    n = lambda a: F.count_if(F.col(arm) == a)
    s = lambda a: F.sum(F.when(F.col(arm) == a, F.col(tokens)))
    out = rows.agg(n(one).alias("first_n"), n(two).alias("second_n"), s(one).alias("_a"), s(two).alias("_b"))
    return out.select("first_n", "second_n", (F.abs(F.col("_a") - F.col("_b")) <= tolerance * F.greatest("_a", "_b")).alias("tokens_match"), (F.col("first_n") == F.col("second_n")).alias("counts_match"))


def passing(rows: DataFrame, arm: str, checkpoint: str, passes: Column) -> DataFrame:
    """The latest and the first checkpoint of each arm that passes."""
    kept = F.when(passes, F.col(checkpoint))
    return rows.groupBy(arm).agg(F.max(kept).alias("latest_passing"), F.min(kept).alias("first_passing"))


def checks_row(checks: dict[str, Column]) -> list[Column]:
    """Columns of every check (null counts as failed), the sorted names of those
    that failed, and whether all passed."""
    sure = {n: F.coalesce(c, F.lit(False)) for n, c in checks.items()}
    failed = F.array_compact(F.array(*[F.when(~sure[n], F.lit(n)) for n in sorted(sure)]))
    return [*[c.alias(n) for n, c in sure.items()], F.array_join(failed, ",").alias("failed_checks"), (F.size(failed) == 0).alias("passed")]


def absolute_retention(base_arithmetic: Column, arithmetic: Column, form: Column, instruction: Column, extractability: Column, echo_rate: Column, questions: Column, failures: Column, losses_finite: Column, validation_loss: Column, tokens_match: Column, drop: float = 0.10, least: float = 0.90, echo: float = 0.05) -> list[Column]:
    """The ten checks of a trained arm against its base."""
    return checks_row({
        "arithmetic_retention": arithmetic + TOLERANCE >= base_arithmetic - drop, "format_following": form + TOLERANCE >= least, "instruction_following": instruction + TOLERANCE >= least, "extractability": extractability + TOLERANCE >= least,
        "prompt_echo": echo_rate <= echo + TOLERANCE, "question_generation": questions == 0, "backend_failures": failures == 0, "finite_training_losses": losses_finite,
        "finite_validation_loss": ~F.isnan(validation_loss) & (F.abs(validation_loss) < float("inf")), "token_count_matches_schedule": tokens_match})


def run_parity(runs: DataFrame, arm: str, one, two, fields: list[str], tokens: str, flags: dict[str, str], tolerance: float = 0.005) -> DataFrame:
    """One row: equal metadata, token sums within the tolerance, and for each of
    ``flags`` (check: column) that it holds for both runs. ``runs`` has a row an arm."""
    side = lambda a, c: F.first(F.when(F.col(arm) == a, F.col(c)), ignorenulls=True)
    kept = runs.filter(F.col(arm).isin(one, two))
    x, y = side(one, tokens), side(two, tokens)
    checks = {"metadata_parity": reduce_and([side(one, c).eqNullSafe(side(two, c)) for c in fields]), "token_parity": F.abs(x - y) <= tolerance * F.greatest(x, y) + TOLERANCE, **{n: side(one, c) & side(two, c) for n, c in flags.items()}}
    return kept.agg(*checks_row(checks))


def reduce_and(flags: list[Column]) -> Column:
    out = F.lit(True)
    for f in flags:
        out = out & f
    return out


def usable_instrument(items: DataFrame, section: str, self_correct: str, base_correct: str, least: dict[str, int]) -> DataFrame:
    """One row: every item's own expected answer scores as right, and each section
    has its least number of items that the base has right."""
    n = items.agg(F.bool_and(self_correct).alias("_s"), *[F.count_if(F.col(base_correct) & (F.col(section) == k)).alias(f"_n_{i}") for i, k in enumerate(least)])
    return n.select(*checks_row({"references_self_score": F.col("_s"), **{f"{k}_has_{m}": F.col(f"_n_{i}") >= m for i, (k, m) in enumerate(least.items())}}))


def base_correct_subset(items: DataFrame, key: str, section: str, correct: str) -> DataFrame:
    """(key, section, section_items): items the base had right, with their section's count."""
    kept = items.filter(F.col(correct)).select(key, section)
    return kept.join(kept.groupBy(section).agg(F.count(F.lit(1)).alias("section_items")), section)


def preservation(records: DataFrame, section: str, correct: str, family: str, echoes: str, questions: str, failures: str, least: float = 0.90, bound: float = 0.85, echo: float = 0.02, most: int = 3) -> DataFrame:
    """One row, over items that the base had right: overall and section rates,
    Wilson's lower bound, echoes, questions, failures, and wrong ones of any family."""
    from siltstone.operators.stats import wilson_lower

    by = records.groupBy(section, family).agg(F.count(F.lit(1)).alias("_n"), F.count_if(correct).alias("_c"), F.count_if(echoes).alias("_e"), F.count_if(questions).alias("_q"), F.count_if(failures).alias("_f"))
    by = by.groupBy(section).agg(*[F.sum(c).alias(c) for c in ("_n", "_c", "_e", "_q", "_f")], F.max(F.col("_n") - F.col("_c")).alias("_w"))
    one = by.agg(*[F.sum(c).alias(c) for c in ("_n", "_c", "_e", "_q", "_f")], F.max("_w").alias("_w"), F.bool_and(F.col("_c") / F.col("_n") >= least - TOLERANCE).alias("_s"))
    return one.select(*checks_row({"overall": F.col("_c") / F.col("_n") >= least - TOLERANCE, "sections": F.col("_s"), "wilson": wilson_lower(F.col("_c"), F.col("_n")) >= bound, "prompt_echo": F.col("_e") / F.col("_n") <= echo, "question_generation": F.col("_q") == 0, "backend_failures": F.col("_f") == 0, "family_failures": F.col("_w") <= most}))


def balance_gate(rows: DataFrame, arm: str, one, two, numbers: list[str], categories: list[str], source: str, smd: float = 0.10, gap: float = 0.05) -> DataFrame:
    """One row: standardized differences, category gaps and the exact source mix."""
    from siltstone.operators.stats import largest_gap, moments

    a, b = (rows.filter(F.col(arm) == x) for x in (one, two))
    m = moments(a, numbers, "a").crossJoin(F.broadcast(moments(b, numbers, "b")))  # one row each
    gaps = [largest_gap(F.col("a_n"), F.col(f"a_s_{v}"), F.col(f"a_q_{v}"), F.col("b_n"), F.col(f"b_s_{v}"), F.col(f"b_q_{v}")) for v in numbers]
    long = rows.select(arm, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("level")) for c in categories])).alias("x")).groupBy("x.field", "x.level").agg(F.count_if(F.col(arm) == one).alias("_a"), F.count_if(F.col(arm) == two).alias("_b"))
    whole = m.crossJoin(F.broadcast(long.join(F.broadcast(m.select("a_n", "b_n"))).agg(F.max(F.abs(F.col("_a") / F.col("a_n") - F.col("_b") / F.col("b_n"))).alias("_gap"), F.bool_and((F.col("field") != source) | (F.col("_a") == F.col("_b"))).alias("_mix"))))
    worst = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return whole.select(F.round(worst, 8).alias("largest_smd"), F.round("_gap", 8).alias("largest_gap"), *checks_row({"numerical": worst <= smd, "categorical": F.col("_gap") <= gap, "source_mix": F.col("_mix")}))


def promotion(development: Column, holdout: Column, correct: Column, extractability: Column, failures: Column, untargeted: Column, reload: Column, unchanged: Column, identities: Column, least: int, base: int, start: int | Column, extractable: float) -> list[Column]:
    """The eleven conditions of a promotion."""
    return checks_row({
        "development_retention": development, "holdout_retention": holdout, "candidate_least": correct >= least, "candidate_over_base": correct > base, "candidate_over_start": correct > start, "extractability": extractability >= extractable,
        "zero_backend_failures": failures == 0, "untargeted_decline": untargeted, "offline_reload": reload, "base_unchanged": unchanged, "identities": identities})


def readiness(reasons: dict[str, Column]) -> Column:
    """Names of the reasons that hold, in their order, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in reasons.items()])), ",")


def first_passing(rows: DataFrame, arm: str, order: Column, value: str, passes: Column) -> DataFrame:
    """(arm, value): of each arm the first in a fixed order that passes; null
    where none does."""
    return rows.groupBy(arm).agg(F.min_by(F.when(passes, F.col(value)), F.when(passes, order)).alias(value))


def common_passing(rows: DataFrame, arm: str, value: str, passes: Column) -> DataFrame:
    """One row: the least value that passes in every arm."""
    arms = rows.agg(F.count_distinct(arm).alias("_n"))
    by = rows.filter(passes).groupBy(value).agg(F.count_distinct(arm).alias("_k"))
    return by.crossJoin(F.broadcast(arms)).filter("_k = _n").agg(F.min(value).alias(value))  # one row
