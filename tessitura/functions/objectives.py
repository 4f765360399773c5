"""Preference and policy objectives as column arithmetic on log-probabilities in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_sigmoid(z: Column) -> Column:
    """Without overflow at either end."""
    return -(F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def completion_log_probs(logps: Column, mask: Column, selected: Column | None = None) -> Column:
    """Sums, means and counts of token log-probabilities under a mask, and under a selection in it."""
    masked = lambda m: F.filter(F.transform(logps, lambda v, i: F.when(F.get(m, i), v)), lambda v: v.isNotNull())
    own = masked(mask)
    chosen = own if selected is None else masked(F.zip_with(mask, selected, lambda a, b: a & b))
    return F.struct(_sum(own).alias("total"), F.try_divide(_sum(own), F.size(own)).alias("mean"), F.size(own).alias("tokens"), _sum(chosen).alias("selected_total"), F.try_divide(_sum(chosen), F.size(chosen)).alias("selected_mean"), F.size(chosen).alias("selected_tokens"))


def preference_logit(pc: Column, pr: Column, rc: Column, rr: Column, beta: float = 0.1) -> Column:
    return beta * ((pc - pr) - (rc - rr))


def smoothed_loss(z: Column, smoothing: float = 0.0) -> Column:
    return -((1 - smoothing) * log_sigmoid(z) + smoothing * log_sigmoid(-z))


def direct_preference(pc: Column, pr: Column, rc: Column, rr: Column, beta: float = 0.1, smoothing: float = 0.0) -> Column:
    """Loss, logit, the two implied rewards, their margin and whether the chosen one is higher."""
    z = preference_logit(pc, pr, rc, rr, beta)
    chosen, rejected = beta * (pc - rc), beta * (pr - rr)
    return F.struct(smoothed_loss(z, smoothing).alias("loss"), z.alias("logit"), chosen.alias("chosen_reward"), rejected.alias("rejected_reward"), (chosen - rejected).alias("margin"), (chosen > rejected).cast("double").alias("accuracy"))


def self_preference(mc: Column, mr: Column, beta: float = 2.5, gamma: float = 0.8) -> Column:
    """SiLU of the negated margin of mean log-probabilities."""
    z = -(beta * (mc - mr) - gamma)
    return z / (1 + F.exp(-z))


def combine_masks(chosen: Column, rejected: Column, how: str = "union") -> Column:
    """Of packed masks, cut to the shorter one's length."""
    n = F.least(F.size(chosen), F.size(rejected))
    a, b = F.slice(chosen, F.lit(1), n), F.slice(rejected, F.lit(1), n)
    if how in ("chosen", "rejected"):
        return a if how == "chosen" else b
    if how not in ("union", "intersection"):
        raise ValueError(f"unknown combination {how!r}")
    return F.zip_with(a, b, (lambda x, y: x | y) if how == "union" else (lambda x, y: x & y))


def fine_grained(pc: Column, pr: Column, rc: Column, rr: Column, selected: Column, valid: Column | None = None, beta: float = 0.1, smoothing: float = 0.0, reduction: str = "sum") -> Column:
    """Preference loss at the selected tokens of aligned arrays; null if none is selected."""
    places = selected if valid is None else F.zip_with(selected, valid, lambda s, v: s & v)
    z = F.transform(pc, lambda p, i: beta * ((p - F.get(rc, i)) - (F.get(pr, i) - F.get(rr, i))))
    z = F.filter(F.transform(z, lambda v, i: F.when(F.get(places, i), v)), lambda v: v.isNotNull())
    total = F.aggregate(z, F.lit(0.0), lambda a, v: a + smoothed_loss(v, smoothing))
    n = F.size(z)
    every = F.size(pc) if valid is None else F.size(F.filter(valid, lambda v: v))
    return F.when(n > 0, F.struct((total / n if reduction == "mean" else total).alias("loss"), (_sum(z) / n).alias("logit"), n.alias("selected"), (n / F.greatest(every, F.lit(1))).alias("fraction")))


def sampled_kl(policy: Column, reference: Column) -> Column:
    d = F.greatest(F.least(reference - policy, F.lit(20.0)), F.lit(-20.0))
    return F.exp(d) - d - 1


def clipped_policy(policy: Column, old: Column, mask: Column, advantage: Column, clip: float = 0.2, reference: Column | None = None) -> Column:
    """For one rollout: its length-normalized clipped loss, mean KL, and how many of how many tokens
    were clipped, with the sum of their ratios; null without a token."""
    one = F.filter(F.transform(policy, lambda p, i: F.struct(p.alias("p"), F.get(old, i).alias("o"), F.get(mask, i).alias("m"), (F.get(reference, i) if reference is not None else F.lit(None).cast("double")).alias("r"))), lambda t: t["m"])
    ratio = lambda t: F.exp(F.greatest(F.least(t["p"] - t["o"], F.lit(20.0)), F.lit(-20.0)))

    def gain(t: Column) -> Column:
        r = ratio(t)
        return F.least(r * advantage, F.least(F.greatest(r, F.lit(1 - clip)), F.lit(1 + clip)) * advantage) if clip > 0 else r * advantage

    n = F.size(one)
    kl = F.aggregate(one, F.lit(0.0), lambda a, t: a + F.coalesce(sampled_kl(t["p"], t["r"]), F.lit(0.0))) / n
    clipped = F.size(F.filter(one, lambda t: F.abs(ratio(t) - 1) > clip)) if clip > 0 else F.lit(0)
    return F.when(n > 0, F.struct((-F.aggregate(one, F.lit(0.0), lambda a, t: a + gain(t)) / n).alias("loss"), kl.alias("kl"), n.alias("tokens"), clipped.alias("clipped"), F.aggregate(one, F.lit(0.0), lambda a, t: a + ratio(t)).alias("ratios")))


def weighted_cross_entropy(losses: Column, weights: Column) -> Column:
    """Token losses by weight, over the sum of the weights or 1 if that is less."""
    top = F.aggregate(F.zip_with(losses, weights, lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)
    return top / F.greatest(_sum(weights), F.lit(1.0))
