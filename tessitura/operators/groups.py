"""Group statistics of rollouts and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.functions import text
from tessitura.functions.alignment import token_edits
from tessitura.operators.numbering import numbered, prefix_maps


def group_advantages(rows: DataFrame, group: str, reward: str, normalize: bool = False, epsilon: float = 1e-4) -> DataFrame:
    """``advantage``: the reward less its group's mean, with ``normalize`` over the population deviation if that exceeds
    ``epsilon``. Groups of one row have none: the advantage is null."""
    return both_advantages(rows, group, reward, epsilon).withColumn("advantage", F.col("scaled" if normalize else "centred")).drop("centred", "scaled")


def both_advantages(rows: DataFrame, group: str, reward: str, epsilon: float = 1e-4) -> DataFrame:
    """``centred`` (less the group's mean) and ``scaled`` (also over its deviation), from one aggregate that
    meets the rows again by join, so a group is never gathered."""
    stats = rows.groupBy(F.col(group).alias("_g")).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_sd"), F.count(reward).alias("_n"))
    gap = F.col(reward) - F.col("_mean")
    some = F.col("_n") >= 2
    out = rows.join(stats, F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumns({"centred": F.when(some, gap), "scaled": F.when(some, F.when(F.col("_sd") > epsilon, gap / F.col("_sd")).otherwise(gap))}).drop("_g", "_mean", "_sd", "_n")


def moving_baseline(steps: DataFrame, step: str, mean: str, momentum: float = 0.9, run: Sequence[str] = ()) -> DataFrame:
    """For (step, mean of its group) of each ``run``: the baseline before the step's update.

    The baseline starts at the first mean and moves by (1 - momentum) of the difference. A step is an affine
    map of the baseline, and the first one a constant, so the baselines are a scan of maps: runs of any length are
    spread over tasks. Steps with a null mean take no part.
    """
    rows = numbered(steps.where(F.col(mean).isNotNull()).select(*run, step, F.col(mean).cast("double").alias(mean)), step, by=run, name="_at")
    first = F.col("_at") == 0
    rows = rows.withColumns({"_mul": F.when(first, 0.0).otherwise(momentum), "_add": F.when(first, F.col(mean)).otherwise((1 - momentum) * F.col(mean))})
    out = prefix_maps(rows, "_at", "_mul", "_add", by=run)
    return out.select(*run, step, mean, F.when(first, F.col(mean)).otherwise(F.col("prefix_add")).alias("baseline"))


def rollout_log(rows: DataFrame, step: str, reward: str, advantage: str, components: list[str]) -> DataFrame:
    return rows.groupBy(step).agg(F.avg(reward).alias("reward_mean"), F.min(reward).alias("reward_min"), F.max(reward).alias("reward_max"), F.stddev_pop(advantage).alias("advantage_std"), *(F.avg(c).alias(f"{c}_mean") for c in components))


def require_valid(rows: DataFrame, group: str, valid: Column) -> DataFrame:
    """Groups with whether any rollout is valid; ``strict`` callers stop where none is."""
    return rows.groupBy(group).agg(F.bool_or(valid).alias("any_valid"), F.count_if(valid).alias("n_valid"), F.count("*").alias("n"))


def window_means(rows: DataFrame, split: str, step: str, every: int, metrics: list[str]) -> DataFrame:
    """Means of batch means by split and window of ``every`` steps."""
    return rows.groupBy(split, F.floor(F.col(step) / every).alias("window")).agg(*(F.avg(m).alias(m) for m in metrics))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(weight * value), F.sum(weight))


def error_rates(rows: DataFrame, edits: str, reference_words: str) -> DataFrame:
    """Macro rate (mean over utterances) and corpus rate (all edits over all words)."""
    return rows.agg(F.avg(F.col(edits) / F.greatest(F.col(reference_words), F.lit(1))).alias("macro"), F.try_divide(F.sum(edits), F.sum(reference_words)).alias("corpus"), F.count("*").alias("n"))


def evaluation(rows: DataFrame, reference: str, hypothesis: str, usable: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Word errors of a test set, by the columns ``by``: ``n`` utterances, how many were ``scored`` and their
    share ``coverage``; ``words`` of their references, ``substitutions``, ``deletions``, ``insertions`` and their
    sum ``edits``; the ``macro`` rate, a mean over utterances, and the ``corpus`` rate, all edits over all words.

    An utterance is scored if its hypothesis is not null and ``usable`` holds (a failed or cut-off
    generation is not). Rates are null where nothing is scored; a reference without words counts as one.
    """
    scored = F.col(hypothesis).isNotNull() if usable is None else F.col(hypothesis).isNotNull() & F.coalesce(usable, F.lit(False))
    rows = rows.select(*by, scored.alias("_scored"), F.when(scored, text.words(F.coalesce(F.col(reference), F.lit("")))).alias("_r"), F.when(scored, text.words(F.col(hypothesis))).alias("_h"))
    rows = rows.withColumn("_e", token_edits(F.col("_r"), F.col("_h"))).withColumn("_words", F.when(F.col("_scored"), F.size("_r")))
    kinds = ("substitutions", "deletions", "insertions")
    edits = F.col("_e.substitutions") + F.col("_e.deletions") + F.col("_e.insertions")
    total = [F.coalesce(F.sum(f"_e.{k}"), F.lit(0)).cast("long").alias(k) for k in kinds]
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if("_scored").alias("scored"),
        (F.count_if("_scored") / F.count("*")).alias("coverage"),
        F.coalesce(F.sum("_words"), F.lit(0)).cast("long").alias("words"),
        *total,
        F.coalesce(F.sum(edits), F.lit(0)).cast("long").alias("edits"),
        F.avg(edits / F.greatest(F.col("_words"), F.lit(1))).alias("macro"),
        F.try_divide(F.sum(edits), F.sum("_words")).alias("corpus"),
    )


def longest_in_batch(rows: DataFrame, batch: str, column: str) -> DataFrame:
    return rows.withColumn("longest", F.max(F.size(column)).over(Window.partitionBy(batch)))
