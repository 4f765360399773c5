"""Rewards as columns, and the composite reward with its gates and Pareto rules.

Numbers that a reward can't take (not finite, of the wrong sign) give null; ``strict(column,
what)`` turns such a null into an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.arrays import bound_to

Metric = Callable[[str], Column]


def strict(value: Column, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"{what} is out of range")).cast("double"))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x.cast("double"))


def nonnegative(x: Column) -> Column:
    return F.when(finite(x) >= 0, x.cast("double"))


def positive(x: Column) -> Column:
    return F.when(finite(x) > 0, x.cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def wer_exponential(wer: Column, k: float = 2.5) -> Column:
    return F.exp(-k * nonnegative(wer))


def cer_tanh(cer: Column, alpha: float = 3.0) -> Column:
    return 1 - F.tanh(alpha * nonnegative(cer))


def asr_nll(nll: Column, alpha: float = 3.0) -> Column:
    return F.exp(-nonnegative(nll) / alpha)


def weighted_harmonic_mean(values: Column, weights: Column) -> Column:
    """Of two arrays; places with weight 0 are left out, and a value 0 gives 0."""
    pairs = F.filter(F.zip_with(values, weights, lambda v, w: F.struct(v.cast("double").alias("v"), w.cast("double").alias("w"))), lambda p: p["w"] > 0)
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"])
    below = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.try_divide(p["w"], p["v"]))
    bad = (F.size(values) != F.size(weights)) | F.exists(values, lambda v: v.isNull() | (v < 0)) | F.exists(weights, lambda w: w.isNull() | (w < 0)) | (F.size(pairs) == 0)
    return F.when(bad, None).when(F.exists(pairs, lambda p: p["v"] == 0), 0.0).otherwise(total / below)


def weighted_harmonic(cer_reward: Column, nll_reward: Column, cer_weight: float = 0.6, nll_weight: float = 0.4) -> Column:
    return weighted_harmonic_mean(F.array(cer_reward, nll_reward), F.array(F.lit(cer_weight), F.lit(nll_weight)))


def intelligibility(cer: Column, nll: Column, cer_alpha: float = 3.0, nll_alpha: float = 3.0, cer_weight: float = 0.6, nll_weight: float = 0.4) -> Column:
    return weighted_harmonic(cer_tanh(cer, cer_alpha), asr_nll(nll, nll_alpha), cer_weight, nll_weight)


def piecewise(value: Column, worst: float, baseline: float, best: float, higher: bool = True, clamped: bool = True) -> Column:
    """The worst value to 0, the baseline to a half, the best to 1, straight between."""
    sign = 1.0 if higher else -1.0
    low, mid, high = sign * worst, sign * baseline, sign * best
    if not low < mid < high:
        raise ValueError("worst, baseline and best must be in order")
    x = sign * finite(value)
    out = F.when(x <= mid, 0.5 * ((x - low) / (mid - low))).when(x > mid, 0.5 + 0.5 * ((x - mid) / (high - mid)))
    return clamp(out, 0.0, 1.0) if clamped else out


def speaker_cosine(similarity: Column, clamped: bool = True) -> Column:
    x = finite(similarity)
    return ((clamp(x, -1.0, 1.0) if clamped else F.when(F.abs(x) <= 1, x)) + 1) / 2


def duration(seconds: Column, target: Column) -> Column:
    return -F.abs(nonnegative(seconds) - positive(target)) / positive(target)


def duration_similarity(seconds: Column, target: Column, alpha: float = 1.0) -> Column:
    return F.exp(alpha * duration(seconds, target))


def duration_tolerance(seconds: Column, target: Column, low: float = 0.8, high: float = 1.2) -> Column:
    return (nonnegative(seconds) / positive(target)).between(low, high).cast("double")


def variation(values: Column, positive_only: bool = False) -> Column:
    """Population standard deviation over the size of the mean; null where that is undefined."""
    good = F.filter(values, lambda v: v > 0) if positive_only else values
    total = F.aggregate(good, F.lit(0.0), lambda a, v: a + v)

    def spread(s: Column) -> Column:
        sd = F.sqrt(F.try_divide(F.aggregate(s["good"], F.lit(0.0), lambda a, v: a + (v - s["mean"]) * (v - s["mean"])), F.size(s["good"])))
        return F.when(F.abs(s["mean"]) > 1e-12, sd / F.abs(s["mean"])).when(sd <= 1e-12, 0.0)

    made = bound_to(F.struct(good.alias("good"), F.try_divide(total, F.size(good)).alias("mean")), spread)
    return F.when(~F.exists(values, lambda v: finite(v).isNull()), made)


def variation_similarity(values: Column, target: Column, alpha: float = 1.0, positive_only: bool = False) -> Column:
    seen = variation(values, positive_only)
    return F.when(target == 0, (seen == 0).cast("double")).when(target > 0, F.exp(-alpha * F.abs(seen - target) / target))


def f0_variation(values: Column, target: Column, alpha: float = 1.0) -> Column:
    return variation_similarity(values, target, alpha, positive_only=True)


def energy_variation(values: Column, target: Column, alpha: float = 1.0) -> Column:
    return F.when(~F.exists(values, lambda v: v < 0), variation_similarity(values, target, alpha))


def prosody(f0: Column, f0_target: Column, energy: Column, energy_target: Column, f0_weight: float = 0.5, energy_weight: float = 0.5, alpha: float = 1.0) -> Column:
    """The weighted mean of the parts that are there. A part with values and no target, or a target
    and no values, gives null, as no part at all does."""
    parts = ((f0, f0_target, f0_weight, f0_variation), (energy, energy_target, energy_weight, energy_variation))
    there = [(v.isNotNull() & t.isNotNull(), w, f(v, t, alpha)) for v, t, w, f in parts]
    halves = reduce(lambda a, b: a | b, (v.isNull() != t.isNull() for v, t, _, _ in parts))
    total = reduce(lambda a, b: a + b, (F.when(on, float(w)).otherwise(0.0) for on, w, _ in there))
    return F.when(~halves, F.try_divide(reduce(lambda a, b: a + b, (F.when(on, w * r).otherwise(0.0) for on, w, r in there)), total))


def quality(pesq: Column) -> Column:
    return clamp(finite(pesq) / 4.5, 0.0, 1.0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# -- composite reward ---------------------------------------------------------------------------
#: Metrics that are better when lower, and those that can't be weights as they are.
LOWER_IS_BETTER = ("wer", "cer", "nll", "duration_error")
RAW_ERRORS = ("wer", "cer", "nll")
_DIRECTIONS = {True: True, "max": True, "maximize": True, "higher": True, False: False, "min": False, "minimize": False, "lower": False}
#: Which scorer gives which weighted rewards.
SCORERS = {
    "asr": ("wer_reward", "cer_reward", "nll_reward", "intelligibility_reward"),
    "speaker": ("speaker_cosine", "speaker_reward"),
    "quality": ("stoi", "pesq", "si_sdr", "quality_reward"),
}
TOTAL = "total"


@dataclass(frozen=True)
class CompositeReward:
    """Weighted metrics with absolute gates, protected metrics and Pareto metrics.

    A metric is looked up by a function from its name to a column, such as
    ``lambda name: F.col("metrics")[name]``; null stands for a metric that is missing. What forbids a
    score is told by ``fault``: everything else here takes metrics without fault.
    """

    weights: Mapping[str, float]
    maximize: Mapping[str, object] = field(default_factory=dict)
    pareto: tuple[str, ...] = ()
    protected: tuple[str, ...] = ()
    thresholds: Mapping[str, float] = field(default_factory=dict)
    tolerances: Mapping[str, float] = field(default_factory=dict)
    normalize: bool = False
    allow_missing: bool = False

    def __post_init__(self) -> None:
        numbers = [*self.weights.values(), *self.thresholds.values(), *self.tolerances.values()]
        if not all(math.isfinite(x) for x in numbers):
            raise ValueError("weights, thresholds and tolerances must be finite")
        if not any(w > 0 for w in self.weights.values()) or any(w < 0 for w in self.weights.values()):
            raise ValueError("weights must not be negative and one must be positive")
        unknown = [d for d in self.maximize.values() if d not in _DIRECTIONS]
        if unknown:
            raise ValueError(f"unknown directions {unknown}")
        if set(self.tolerances) - set(self.protected):
            raise ValueError("tolerances are for protected metrics only")
        if any(t < 0 for t in self.tolerances.values()):
            raise ValueError("tolerances must not be negative")

    @property
    def names(self) -> list[str]:
        """All metrics that anything here looks at, sorted."""
        return sorted({*self.weights, *self.thresholds, *self.pareto, *self.protected})

    def higher(self, name: str) -> bool:
        return _DIRECTIONS[self.maximize.get(name, True)]

    def fault(self, metric: Metric) -> Column:
        """``missing NAME`` for a metric that must be there, ``not finite NAME``, ``nothing active``
        where no metric of positive weight is there; else null."""
        needed = sorted({*self.thresholds, *self.pareto, *self.protected} | (set() if self.allow_missing else set(self.weights)))
        out = F.lit(None).cast("string")
        for n in reversed(self.names):
            out = F.when(metric(n).isNotNull() & finite(metric(n)).isNull(), F.lit(f"not finite {n}")).otherwise(out)
        for n in reversed(needed):
            out = F.when(metric(n).isNull(), F.lit(f"missing {n}")).otherwise(out)
        active = reduce(lambda a, b: a | b, (metric(n).isNotNull() for n, w in self.weights.items() if w > 0))
        return F.coalesce(out, F.when(~active, "nothing active"))

    def aggregate(self, metric: Metric) -> Column:
        """The weighted sum, in the order of the weights. A missing metric gives null, or is left
        out with ``allow_missing``; ``normalize`` divides by the weights that took part. A metric
        that is not finite, or none of positive weight, gives null."""
        total, active, sound = F.lit(0.0), F.lit(0.0), F.lit(True)
        for n, w in self.weights.items():
            value = finite(metric(n))
            sound = sound & (metric(n).isNull() | value.isNotNull())
            there = value.isNotNull()
            total = total + (F.when(there, w * value).otherwise(0.0) if self.allow_missing else w * value)
            active = active + (F.when(there, F.lit(float(w))).otherwise(0.0) if self.allow_missing else F.lit(float(w)))
        return F.when(sound & (active > 0), total / active if self.normalize else total)

    def breakdown(self, scores: list[Column], extra: Column | None = None) -> tuple[Column, Column]:
        """One row's scores put together: a map of all metrics with ``total``, and what forbids it.

        ``scores`` are maps from names to texts or numbers, of one scorer each, later ones before
        earlier ones; what is no number there, such as a transcript, is left out, as is a total.
        ``extra`` goes before all of them and must not hold a total. A null map holds nothing.
        With a fault the map is null.
        """
        empty = F.create_map().cast("map<string,double>")

        def over(low: Column, high: Column) -> Column:
            return bound_to(high, lambda h: F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(h, k)), h))

        merged = empty
        for m in scores:
            numbers = F.transform_values(F.map_filter(m.cast("map<string,string>"), lambda k, v: v.isNotNull()), lambda _, v: v.try_cast("double"))
            merged = over(merged, F.coalesce(F.map_filter(numbers, lambda k, v: v.isNotNull() & (k != TOTAL)), empty))
        if extra is not None:
            merged = over(merged, F.coalesce(extra.cast("map<string,double>"), empty))

        def finish(m: Column) -> Column:
            fault = self.fault(lambda n: F.element_at(m, n))
            bad = F.exists(F.map_values(m), lambda v: finite(v).isNull())
            fault = F.when(F.lit(False) if extra is None else F.coalesce(F.map_contains_key(extra, TOTAL), F.lit(False)), "reserved name").otherwise(F.coalesce(fault, F.when(bad, "not finite")))
            made = F.map_concat(m, F.create_map(F.lit(TOTAL), self.aggregate(lambda n: F.element_at(m, n))))
            return F.struct(F.when(fault.isNull(), made).alias("metrics"), fault.alias("fault"))

        both = bound_to(merged, finish)
        return both["metrics"], both["fault"]

    def passes(self, metric: Metric) -> Column:
        tests = [metric(n) >= t if self.higher(n) else metric(n) <= t for n, t in self.thresholds.items()]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def _no_worse(self, names: tuple[str, ...], a: Metric, b: Metric, slack: Callable[[str], float]) -> Column:
        tests = [a(n) >= b(n) - slack(n) if self.higher(n) else a(n) <= b(n) + slack(n) for n in names]
        return reduce(lambda x, y: x & y, tests, F.lit(True))

    def preserves(self, a: Metric, b: Metric) -> Column:
        return self._no_worse(self.protected, a, b, lambda n: self.tolerances.get(n, 0.0))

    def not_worse(self, a: Metric, b: Metric, tolerance: float = 0.0) -> Column:
        return self._no_worse(self.pareto, a, b, lambda n: tolerance)

    def dominates(self, a: Metric, b: Metric, tolerance: float = 0.0) -> Column:
        if not self.pareto:
            raise ValueError("there are no Pareto metrics")
        better = [a(n) > b(n) + tolerance if self.higher(n) else a(n) < b(n) - tolerance for n in self.pareto]
        return self.not_worse(a, b, tolerance) & reduce(lambda x, y: x | y, better)

    def preferred(self, a: Metric, b: Metric, tolerance: float = 0.0) -> Column:
        return self.passes(a) & self.preserves(a, b) & self.not_worse(a, b) & (self.aggregate(a) > self.aggregate(b) + tolerance)

    def compare(self, a: Metric, b: Metric, tolerance: float = 0.0) -> Column:
        left, right = self.preferred(a, b, tolerance), self.preferred(b, a, tolerance)
        return F.when(left == right, 0).when(left, 1).otherwise(-1)


def scorers_needed(config: Mapping) -> list[str]:
    """The scorers that a configuration needs: those it names, and by default those whose rewards have
    a weight; ``False`` or ``{"enabled": False}`` turns one off."""
    weighted = set(config.get("weights") or {})
    out = []
    for name, rewards in SCORERS.items():
        given = config.get(f"{name}_scorer", config.get(name, bool(weighted & set(rewards))))
        if given and not (isinstance(given, Mapping) and given.get("enabled") is False):
            out.append(name)
    return out


def build_composite(config: Mapping) -> CompositeReward:
    """From a configuration mapping; raw error rates must come as rewards, not as weights."""
    weights = dict(config.get("weights") or {})
    raw = sorted(set(weights) & set(RAW_ERRORS))
    if raw:
        raise ValueError(f"{raw} are errors, not rewards")
    names = {*weights, *(config.get("pareto_metrics") or ()), *(config.get("protected_metrics") or ()), *(config.get("protected_thresholds") or {})}
    directions = {n: "min" for n in names if n in LOWER_IS_BETTER} | dict(config.get("maximize") or {})
    return CompositeReward(weights, directions, tuple(config.get("pareto_metrics") or ()), tuple(config.get("protected_metrics") or ()), dict(config.get("protected_thresholds") or {}), dict(config.get("protected_tolerances") or {}), bool(config.get("normalize_weights")), bool(config.get("allow_missing")))
