"""Preference pairs: the best candidate of a group and the worst that it safely beats."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.functions import arrays
from tessitura.functions.rewards import CompositeReward

CANDIDATES = "array<struct<completion_input_ids:array<int>,metrics:map<string,double>,error_spans:array<struct<start_frame:int,end_frame:int,type:string>>,selection_mask:array<boolean>>>"


def pairs_from_rows(rows: DataFrame, group: str, index: str, reward: CompositeReward, gap: float = 0.3, decimals: int | None = None) -> DataFrame:
    """For candidates as rows with a column for each metric: the chosen and rejected ``index`` of
    each group, and the gap of their rewards.

    Chosen: highest reward, then lowest index, among those that pass the gates. Rejected: lowest
    reward, then highest index, among those at least ``gap`` below that the chosen one is
    preferred to. Aggregations by group only, partial before the shuffle, so a large group
    is never gathered. Groups without a pair are left out, as are groups with a metric that is not
    finite or a candidate without any; a metric that is missing stops the job.
    """
    own = lambda n: F.col(n)
    names = reward.names
    score = reward.aggregate(own)
    fault = stopping(reward.fault(own))
    rows = rows.select(F.col(group).alias("g"), F.col(index).alias("i"), *names, (F.round(score, decimals) if decimals is not None else score).alias("score"), fault.alias("fault"), reward.passes(own).alias("passes"))
    kept = F.struct("score", *names, "i")
    best = rows.groupBy("g").agg(F.max_by(kept, F.when(F.col("passes"), F.struct("score", (-F.col("i")).alias("i")))).alias("best"), F.count_if("passes").alias("n"), F.max("fault").alias("group_fault")).where("n >= 2 AND group_fault IS NULL")
    met = rows.where("passes").join(best, "g").where(F.col("i") != F.col("best.i"))
    chosen = lambda n: F.col("best")[n]
    test = (F.col("best.score") - F.col("score") >= gap) & (F.col("best.score") > F.col("score")) & reward.preserves(chosen, own) & reward.not_worse(chosen, own)
    worst = met.where(test).groupBy("g").agg(F.min_by(F.struct("i", "score", F.col("best.i").alias("chosen"), F.col("best.score").alias("top")), F.struct("score", (-F.col("i")).alias("i"))).alias("w"))
    return worst.select(F.col("g").alias(group), F.col("w.chosen").alias("chosen"), F.col("w.i").alias("rejected"), (F.col("w.top") - F.col("w.score")).alias("reward_gap"))


def stopping(fault: Column) -> Column:
    """The fault, but an error where a metric is missing: that is a fault of the data, not of a group."""
    return F.when(fault.startswith("missing"), F.raise_error(F.concat(F.lit("a candidate lacks a metric: "), fault)).cast("string")).otherwise(fault)


def pairs_from_groups(groups: DataFrame, reward: CompositeReward, gap: float = 0.3, group_codes: int | None = None, audio_start: int = 2, weight_by_gap: bool = False) -> DataFrame:
    """For a row a prompt with its array of candidates: the pair, or ``reject_reason``.

    All within the row, by array functions: no shuffle. A missing metric stops the job, as a
    fault of the data; groups without a safe pair, or with a metric that is not finite, get a reason.
    """
    metric = lambda c: lambda n: F.element_at(c["metrics"], n)
    prepared = F.transform("candidates", lambda c, i: F.struct(reward.aggregate(metric(c)).alias("score"), (-i).alias("back"), reward.passes(metric(c)).alias("passes"), stopping(reward.fault(metric(c))).alias("fault"), c.alias("c")))
    df = groups.withColumn("_all", prepared).withColumn("_ok", F.filter("_all", lambda p: p["passes"]))
    fault = F.get(F.filter(F.transform("_all", lambda p: p["fault"]), lambda f: f.isNotNull()), F.lit(0))
    slim = lambda p: F.struct(p["score"].alias("score"), p["back"].alias("back"))
    df = df.withColumn("_best", F.array_max(F.transform("_ok", slim)))
    df = df.withColumn("_chosen", F.get(F.filter("_ok", lambda p: p["back"] == F.col("_best.back")), F.lit(0)))
    safe = F.filter("_ok", lambda p: (p["back"] != F.col("_best.back")) & (F.col("_best.score") - p["score"] >= gap) & reward.preferred(metric(F.col("_chosen.c")), metric(p["c"])))
    df = df.withColumn("_worst", F.array_min(F.transform(safe, slim)))
    df = df.withColumn("_rejected", F.get(F.filter("_ok", lambda p: p["back"] == F.col("_worst.back")), F.lit(0)))

    def mask(c: str) -> tuple[Column, Column]:
        ids, given, spans = F.col(f"{c}.c.completion_input_ids"), F.col(f"{c}.c.selection_mask"), F.col(f"{c}.c.error_spans")
        n = F.size(ids)
        fault = F.when(given.isNotNull(), F.when(F.size(given) != n, "mask length")).when(spans.isNotNull(), F.lit("no frame size") if group_codes is None else arrays.span_fault(n, spans, group_codes, audio_start))
        made = F.when(given.isNotNull(), given).when(spans.isNotNull(), F.lit(None).cast("array<boolean>") if group_codes is None else arrays.span_mask(n, spans, group_codes, audio_start)).otherwise(F.transform(ids, lambda t: F.lit(False)))
        return made, fault

    (cm, cf), (rm, rf) = mask("_chosen"), mask("_rejected")
    bad_tokens = F.exists("_ok", lambda p: arrays.tokens_fault(p["c"]["completion_input_ids"]).isNotNull())
    reason = (
        F.when(arrays.tokens_fault(F.col("prompt_input_ids")).isNotNull(), "bad prompt")
        .when(F.size("candidates") < 2, "fewer than two candidates")
        .when(fault.isNotNull(), fault)
        .when(bad_tokens, "bad tokens")
        .when(F.size("_ok") < 2, "fewer than two pass the thresholds")
        .when(F.col("_rejected").isNull(), "no safe pair meets the gap")
    )
    reason = F.coalesce(reason, cf, rf)
    margin = F.col("_best.score") - F.col("_worst.score")
    out = df.withColumn("reject_reason", reason)
    ok = F.col("reject_reason").isNull()
    return out.select(
        *(c for c in groups.columns if c != "candidates"),
        F.when(ok, F.col("_chosen.c.completion_input_ids")).alias("chosen_input_ids"),
        F.when(ok, F.col("_rejected.c.completion_input_ids")).alias("rejected_input_ids"),
        F.when(ok, cm).alias("chosen_selection_mask"),
        F.when(ok, rm).alias("rejected_selection_mask"),
        F.when(ok, margin if weight_by_gap else F.lit(1.0)).alias("sample_weight"),
        F.when(ok, margin).alias("reward_gap"),
        F.when(ok, F.col("_chosen.c.metrics")).alias("chosen_metrics"),
        F.when(ok, F.col("_rejected.c.metrics")).alias("rejected_metrics"),
        "reject_reason",
    )


def skyline(rows: DataFrame, group: str, index: str, reward: CompositeReward, buckets: int = 256) -> DataFrame:
    """Rows of each group that no other row of it dominates on the Pareto metrics.

    A group is dealt to buckets of its points' hashes, whose own maximal points are found first; what meets in the
    next, fewer buckets is the maximal points of those before, down to one. With one or two metrics
    window functions do it. With more, a bucket's points come in an order in which none is dominated by a later
    one, and each is compared with the maximal ones before it: by a staircase of the second and third of three
    metrics, in n log n steps, and by blocks of points with four and more. A row without one of the metrics, or
    with one that is no number, is dominated by none and dominates none.
    """
    names = list(reward.pareto)
    if not names:
        raise ValueError("there are no Pareto metrics")
    signed = [F.col(n) if reward.higher(n) else -F.col(n) for n in names]
    whole = reduce(lambda x, y: x & y, (F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) for n in names))
    orders = [f"o_{n}" for n in names]
    points = rows.where(whole).select(F.col(group).alias("g2"), *(x.alias(o) for x, o in zip(signed, orders, strict=True))).distinct()
    if len(names) == 1:
        best = points.groupBy("g2").agg(F.max(orders[0]).alias(orders[0]))
    elif len(names) == 2:
        best = _staircases(_staircases(points.withColumn("bucket", _bucket(orders, buckets)), orders, "g2", "bucket"), orders, "g2")
    else:
        best = points.select("g2", *(F.col(o).cast("double").alias(o) for o in orders))
        for many in (buckets, max(1, buckets // 16), 1):
            best = _maximal(best.withColumn("bucket", _bucket(orders, many)), orders)
    same = F.col(group).eqNullSafe(F.col("g2")) & reduce(lambda x, y: x & y, (x.cast(best.schema[o].dataType) == F.col(o) for x, o in zip(signed, orders, strict=True)))
    return rows.where(whole).join(best, same, "left_semi").unionByName(rows.where(~whole))


def _bucket(orders: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*orders), F.lit(buckets)).cast("int")


def _staircases(points: DataFrame, orders: list[str], *by: str) -> DataFrame:
    """Maximal points by two metrics: sorted by the first, best first, those that exceed the second so far."""
    first, last = orders
    tops = points.groupBy(*by, first).agg(F.max(last).alias("top"))
    before = Window.partitionBy(*by).orderBy(F.desc(first)).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("above", F.max("top").over(before))
    return tops.where(F.col("above").isNull() | (F.col("top") > F.col("above"))).select(*by, first, F.col("top").alias(last))


def _maximal(points: DataFrame, orders: list[str]) -> DataFrame:
    """The maximal points of each group and bucket, which come sorted and pass through in batches."""
    score = reduce(lambda x, y: x + y, (F.col(o) for o in orders))
    # equal sums stand by the metrics, so that a point is always after those that dominate it
    keys = [F.desc(o) for o in orders] if len(orders) == 3 else [score.desc(), *(F.desc(o) for o in orders)]
    dealt = points.repartition("g2", "bucket").sortWithinPartitions("g2", "bucket", *keys)
    schema = points.drop("bucket").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, None
        for batch in batches:
            if not len(batch):
                continue
            cell = [batch.column(0), batch.column(batch.num_columns - 1)]
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:-1]], axis=1)
            new = np.ones(len(batch), bool)
            if len(batch) > 1:
                new[1:] = pc.invert(_equal(cell[0][1:], cell[0][:-1])).to_numpy(zero_copy_only=False) | (np.diff(cell[1].to_numpy()) != 0)
            starts = np.flatnonzero(new)
            kept = np.zeros(len(batch), bool)
            for start, stop in zip(starts, [*starts[1:], len(batch)], strict=True):
                here = (cell[0][int(start)].as_py(), cell[1][int(start)].as_py())
                if seen is None or here != last:
                    last, seen = here, Staircase() if len(orders) == 3 else Front(len(orders))
                kept[start:stop] = seen.add(values[start:stop])
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept)) for c in batch.columns[:-1]], names=batch.schema.names[:-1])

    return dealt.select("g2", *orders, "bucket").mapInArrow(run, schema)


def _equal(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.if_else(pc.and_(pc.is_null(a), pc.is_null(b)), True, pc.fill_null(pc.equal(a, b), False))


class Staircase:
    """Maximal points by three metrics that come with the first one falling: what counts then is whether one
    before reaches the second and the third."""

    def __init__(self):
        self.second: list[float] = []  # rising, with the third falling
        self.third: list[float] = []

    def add(self, points: np.ndarray) -> np.ndarray:
        kept = np.zeros(len(points), bool)
        for i, (_, b, c) in enumerate(points.tolist()):
            k = bisect_left(self.second, b)
            if k < len(self.second) and self.third[k] >= c:
                continue
            kept[i] = True
            if k < len(self.second) and self.second[k] == b:
                k += 1
            low = k
            while low and self.third[low - 1] <= c:
                low -= 1
            self.second[low:k] = [b]
            self.third[low:k] = [c]
        return kept


class Front:
    """Maximal points by any number of metrics that come in an order in which none is dominated by a later one."""

    BLOCK = 512

    def __init__(self, metrics: int):
        self.points = np.zeros((0, metrics))

    def add(self, points: np.ndarray) -> np.ndarray:
        kept = np.zeros(len(points), bool)
        for start in range(0, len(points), self.BLOCK):
            left = np.arange(start, min(start + self.BLOCK, len(points)))
            for k in range(0, len(self.points), 8 * self.BLOCK):
                left = left[~self.reached(points[left], self.points[k : k + 8 * self.BLOCK])]
            inside = np.triu(np.ones((len(left), len(left)), bool), 1)  # row before column
            beaten = (inside & (points[left][:, None, :] >= points[left][None, :, :]).all(axis=2)).any(axis=0)
            left = left[~beaten]  # what a beaten point beats, the one that beats it beats too
            kept[left] = True
            self.points = np.concatenate([self.points, points[left]])
        return kept

    def reached(self, points: np.ndarray, by: np.ndarray) -> np.ndarray:
        over = np.ones((len(points), len(by)), bool)
        for m in range(points.shape[1]):
            over &= by[None, :, m] >= points[:, None, m]
        return over.any(axis=1)


def build_pairs(spark: SparkSession, candidates: str, out: str, reward: CompositeReward, **options) -> tuple[int, int]:
    """Candidate lines in, pairs with their ``source_line`` out, in one pass; how many lines were
    accepted and rejected. ``options`` are those of ``pairs_from_groups``."""
    from tessitura.sources import readers, writers

    return writers.write_pairs(pairs_from_groups(readers.read_candidates(spark, candidates), reward, **options), out)


def rank_in_group(rows: DataFrame, group: str, score: str, index: str) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(index))
    return rows.withColumn("rank", F.row_number().over(order))
