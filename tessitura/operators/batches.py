"""Mixing two sources by ratio, block shuffling, and padding batches."""

from __future__ import annotations

import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators.numbering import prefix_maps
from tessitura.plans.layout import IGNORE


def parse_ratio(value: str | float) -> float:
    parts = [float(p) for p in str(value).split(":")] if isinstance(value, str) else [float(value)]
    if len(parts) > 2 or (len(parts) == 2 and parts[1] <= 0):
        raise ValueError(f"bad ratio {value!r}")
    ratio = parts[0] / parts[1] if len(parts) == 2 else parts[0]
    if not (math.isfinite(ratio) and ratio > 0):
        raise ValueError("a ratio is a positive number")
    return ratio


def ratio_at(step: Column, initial: float, final: float, total_steps: int) -> Column:
    """The ratio of a step, on a straight line that ends at the last step."""
    if total_steps <= 1:
        return F.when(step > 0, F.lit(float(final))).otherwise(F.lit(float(initial)))
    progress = F.least(F.greatest(step, F.lit(0)).cast("double") / (total_steps - 1), F.lit(1.0))
    return initial + (final - initial) * progress


def batch_counts(ratio: float) -> tuple[int, int]:
    """Batches of the first and of the second source in a cycle."""
    f = Fraction(ratio).limit_denominator(16)
    return f.numerator, f.denominator


def total_steps(rows: int, per_device: int, devices: int, accumulation: int, epochs: float, max_steps: int = -1, drop_last: bool = False) -> int:
    if max_steps > 0:
        return max_steps
    size = per_device * devices
    micro = rows // size if drop_last else -(-rows // size)
    if not micro:
        raise ValueError("there are fewer rows than one batch has")
    return max(1, math.ceil(max(1, -(-micro // max(1, accumulation))) * epochs))


def mixture_length(n1: int, n2: int, batch: int, initial: float, final: float) -> int:
    """Places in the mixture: whole cycles that both sources can fill at the steeper ratio."""
    most1, most2 = batch_counts(max(initial, final))
    cycles = min(n1 // (batch * most1), n2 // (batch * most2))
    if not cycles:
        raise ValueError("a source is too small for one cycle")
    return cycles * sum(batch_counts(initial)) * batch


def mixture(spark: SparkSession, n1: int, n2: int, batch: int, initial: float, final: float, step: int = 0, steps: int | None = None) -> DataFrame:
    """The schedule: for each place ``index``, its ``source`` (1 or 2) and ``row`` there.

    Plain arithmetic on a range, so it is as parallel as its partitions; rows then join by number.
    """
    length = mixture_length(n1, n2, batch, initial, final)
    now = initial if not steps else (final if step > 0 else initial) if steps <= 1 else initial + (final - initial) * min(max(step, 0) / (steps - 1), 1.0)
    a, b = batch_counts(now)
    df = spark.range(length).withColumnRenamed("id", "index")
    number, inside = F.floor(F.col("index") / batch), F.col("index") % batch
    cycle, place = F.floor(number / (a + b)), number % (a + b)
    first = place < a
    row = F.when(first, (cycle * a + place) * batch + inside).otherwise((cycle * b + place - a) * batch + inside)
    return df.select("index", F.when(first, 1).otherwise(2).alias("source"), F.when(first, row % n1).otherwise(row % n2).cast("long").alias("row"))


def _cycles(ratios: pa.Array) -> pa.Array:
    return pa.array([None if r is None else dict(zip(("first", "second"), batch_counts(r), strict=True)) for r in ratios.to_pylist()], pa.struct([("first", pa.int64()), ("second", pa.int64())]))


def cycle(ratio: Column) -> Column:
    """``batch_counts`` of a column: a struct of ``first`` and ``second``."""
    return F.arrow_udf(_cycles, "struct<first:bigint,second:bigint>")(ratio)


def schedule(spark: SparkSession, n1: int, n2: int, batch: int, initial: float, final: float, steps: int, accumulation: int = 1) -> DataFrame:
    """A whole run while its ratio moves: for each of the ``accumulation`` batches of each ``step`` and each place ``inside``
    it, the ``source`` and the ``row`` there.

    A batch is of one source. Its place in the cycle, and ``row``, follow from its number and from the ratio of its
    own step, as if that had held from the start; so rows can come again or be passed over when the ratio
    moves. ``next_row`` goes on where the source's last batch ended instead: the batches of a source before
    each are a prefix sum over the run, worked out by blocks.
    """
    if min(n1, n2, batch, accumulation) <= 0:
        raise ValueError("sources, batches and accumulation are positive")
    runs = spark.range(steps * accumulation).withColumnRenamed("id", "number").withColumn("step", F.floor(F.col("number") / accumulation))
    runs = runs.withColumn("c", cycle(ratio_at(F.col("step"), initial, final, steps)))
    a, b = F.col("c.first"), F.col("c.second")
    place, whole = F.col("number") % (a + b), F.floor(F.col("number") / (a + b))
    runs = runs.select("number", "step", (place < a).alias("is_first"), F.when(place < a, whole * a + place).otherwise(whole * b + place - a).alias("own"))
    runs = runs.withColumns({"_mul": F.lit(1.0), "_add": F.col("is_first").cast("double")})
    runs = prefix_maps(runs, "number", "_mul", "_add")
    following = F.when(F.col("is_first"), F.col("prefix_add")).otherwise(F.col("number") - F.col("prefix_add")).cast("long")
    rows = runs.select("number", "step", "is_first", "own", following.alias("following"), F.explode(F.sequence(F.lit(0), F.lit(batch - 1))).alias("inside"))
    size = F.when(F.col("is_first"), F.lit(n1)).otherwise(F.lit(n2))
    at = lambda c: ((F.col(c) * batch + F.col("inside")) % size).cast("long")
    return rows.select("step", (F.col("number") % accumulation).alias("micro"), "inside", F.when(F.col("is_first"), 1).otherwise(2).alias("source"), at("own").alias("row"), at("following").alias("next_row"))


def shuffle_blocks(df: DataFrame, index: str, block: int, seed: int, epoch: int = 0) -> DataFrame:
    """Sort keys that permute whole blocks by seed and epoch and keep rows inside them in order."""
    number = F.floor(F.col(index) / block)
    return df.withColumns({"block": number, "block_key": F.xxhash64(F.lit(seed + epoch), number), "in_block": F.col(index) % block})


def filled(array: Column, width: Column, value: Column, left: bool = False) -> Column:
    rest = F.array_repeat(value, F.greatest(width - F.size(array), F.lit(0)).cast("int"))
    return F.concat(rest, array) if left else F.concat(array, rest)


def collate(rows: DataFrame, batch: str, pad: int, left: bool = False, ignore: int = IGNORE) -> DataFrame:
    """Pads ``input_ids``, ``attention_mask`` and ``labels`` to their batch's longest row; a missing
    mask is ones, missing labels are the ids. Only lengths are aggregated; rows meet them by join."""
    ids = F.col("input_ids")
    mask = F.col("attention_mask") if "attention_mask" in rows.columns else F.transform(ids, lambda t: F.lit(1))
    labels = F.col("labels") if "labels" in rows.columns else ids
    rows = rows.withColumns({"attention_mask": mask, "labels": labels})
    uneven = (F.size("attention_mask") != F.size("input_ids")) | (F.size("labels") != F.size("input_ids"))
    longest = rows.groupBy(F.col(batch).alias("_b")).agg(F.max(F.size("input_ids")).alias("_w"))
    width = F.when(uneven, F.raise_error(F.lit("mask and labels must be as long as the ids")).cast("int")).otherwise(F.col("_w"))
    fill = lambda c, v: filled(F.col(c), width, F.lit(v), left)
    return rows.join(longest, F.col(batch).eqNullSafe(F.col("_b"))).withColumns({"input_ids": fill("input_ids", pad), "attention_mask": fill("attention_mask", 0), "labels": fill("labels", ignore)}).drop("_b", "_w")


def collate_completions(rows: DataFrame, batch: str, pad: int, marker: int, trust_labels: bool = False) -> DataFrame:
    """Like ``collate``, with completion-only labels, and a mask that also leaves out real paddings."""
    from tessitura.functions.arrays import completion_labels

    if not trust_labels:
        made = completion_labels(F.col("input_ids"), marker)
        rows = rows.withColumn("labels", F.coalesce(made, F.raise_error(F.lit("no completion after the marker")).cast("array<int>")))
    out = collate(rows.drop("attention_mask"), batch, pad)
    return out.withColumn("attention_mask", F.transform("input_ids", lambda t: (t != pad).cast("int")))


def collate_pairs(rows: DataFrame, batch: str, pad: int, max_length: int | None = None, left: bool = False, require_selection: bool = False) -> DataFrame:
    """Prompt with chosen and prompt with rejected, both to the batch's longest, with attention,
    completion and selection masks.

    A branch's own mask is ``chosen_selection_mask`` or ``rejected_selection_mask``; without it
    ``selection_mask`` holds for both if they are of equal length, else all is selected.
    """
    def branch(name: str) -> Column:
        ids = F.col(f"{name}_input_ids")
        whole = F.transform(ids, lambda t: F.lit(True))
        shared = F.lit(None).cast("array<boolean>")
        if "selection_mask" in rows.columns:
            equal = F.size("chosen_input_ids") == F.size("rejected_input_ids")
            shared = F.when(F.col("selection_mask").isNotNull() & ~equal, F.raise_error(F.lit("a shared mask needs completions of equal length")).cast("array<boolean>")).otherwise(F.col("selection_mask"))
        own = F.col(f"{name}_selection_mask") if f"{name}_selection_mask" in rows.columns else F.lit(None).cast("array<boolean>")
        mask = F.coalesce(own, shared, whole)
        return F.when(F.size(mask) != F.size(ids), F.raise_error(F.lit("a selection mask must be as long as its completion")).cast("array<boolean>")).otherwise(mask)

    n = F.size("prompt_input_ids")
    rows = rows.withColumns({"_cs": branch("chosen"), "_rs": branch("rejected"), "_n": n + F.greatest(F.size("chosen_input_ids"), F.size("rejected_input_ids"))})
    longest = rows.groupBy(F.col(batch).alias("_b")).agg(F.max("_n").alias("_w"))
    checks = F.lit(False)
    if max_length is not None:
        checks = checks | (F.col("_n") > max_length)
    if require_selection:
        checks = checks | ~(F.exists("_cs", lambda m: m) | F.exists("_rs", lambda m: m))
    width = F.when(checks, F.raise_error(F.lit("a pair is too long or selects nothing")).cast("int")).otherwise(F.col("_w"))
    rows = rows.join(longest, F.col(batch).eqNullSafe(F.col("_b")))
    out = {}
    for name, mask in (("chosen", "_cs"), ("rejected", "_rs")):
        ids = F.concat("prompt_input_ids", f"{name}_input_ids")
        blank = F.transform("prompt_input_ids", lambda t: F.lit(False))
        out[f"{name}_ids"] = filled(ids, width, F.lit(pad), left)
        out[f"{name}_attention"] = filled(F.transform(ids, lambda t: F.lit(1)), width, F.lit(0), left)
        out[f"{name}_completion"] = filled(F.concat(blank, F.transform(f"{name}_input_ids", lambda t: F.lit(True))), width, F.lit(False), left)
        out[f"{name}_selection"] = filled(F.concat(blank, F.col(mask)), width, F.lit(False), left)
    return rows.withColumns(out).drop("_cs", "_rs", "_n", "_b", "_w")
