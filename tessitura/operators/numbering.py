"""Gapless numbers in order of any columns, and scans of affine maps, without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.sources import shared

#: Maps that are composed one after the other in a row.
BLOCK = 256


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool = False) -> DataFrame:
    """``left`` with the other columns of the row of ``right`` that has the same keys, nulls included."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(F.broadcast(right) if small else right, same).drop(*(f"_r_{k}" for k in keys))


def _saved(df: DataFrame, name: str) -> DataFrame:
    folder = shared.shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(df: DataFrame, *order: str, by: Sequence[str] = (), name: str = "row") -> DataFrame:
    """Adds ``name``, a gapless number from 0 in order of the columns ``order``, for each ``by`` or for all rows.

    Rows are dealt to ranges at quantiles of the keys' own values, so neither a far outlier nor one large
    group fills a task, and written once with their places; the sizes of the ranges, a number for each
    and each group in it, are summed up and meet the rows again. Nulls come first. Rows with equal keys are
    numbered in no fixed order.
    """
    spark, keys = df.sparkSession, [*by, *order]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    dealt = _saved(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    sizes = dealt.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    joined = _meet(dealt, sizes, [*by, "_part"], small=not by)  # without groups, a row for each range
    return joined.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def prefix_maps(rows: DataFrame, at: str, mul: str, add: str, by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Adds ``prefix_mul`` and ``prefix_add``: the maps ``v -> mul v + add`` of all rows before, in order of the
    gapless number ``at`` in the group ``by``, composed into one.

    Maps compose in any grouping: blocks of ``block`` rows fold by themselves, the blocks' own maps are
    scanned in the same way, level by level, and each block goes on from what comes before it. A task
    holds blocks, however long a group is.
    """
    inside = F.array_sort(F.collect_list(F.struct(at, *(c for c in rows.columns if c not in (at, *by)))))
    blocks = rows.withColumn("_block", F.floor(F.col(at) / block)).groupBy(*by, "_block").agg(inside.alias("_rows"))
    pair = lambda m, a: F.struct(m.cast("double").alias("m"), a.cast("double").alias("a"))
    one = pair(F.lit(1.0), F.lit(0.0))
    start = F.struct(one.alias("now"), F.array().cast("array<struct<m:double,a:double>>").alias("out"))
    then = lambda s, r: F.struct(pair(s["now"]["m"] * r[mul], r[mul] * s["now"]["a"] + r[add]).alias("now"), F.array_append(s["out"], s["now"]).alias("out"))
    blocks = _saved(blocks.withColumn("_fold", F.aggregate("_rows", start, then)), "blocks")
    if blocks.agg(F.max("_block")).first()[0]:
        upper = blocks.select(*by, F.col("_block").alias("_place"), F.col("_fold.now.m").alias("_m"), F.col("_fold.now.a").alias("_a"))
        upper = prefix_maps(upper, "_place", "_m", "_a", by, block).withColumnRenamed("_place", "_block")
        joined = _meet(blocks, upper.select(*by, "_block", "prefix_mul", "prefix_add"), [*by, "_block"])
    else:
        joined = blocks.withColumns({"prefix_mul": F.lit(1.0), "prefix_add": F.lit(0.0)})
    names = [c for c in rows.columns if c not in by]
    both = F.zip_with("_rows", "_fold.out", lambda r, p: F.struct(*(r[c].alias(c) for c in names), (p["m"] * F.col("prefix_mul")).alias("prefix_mul"), (p["m"] * F.col("prefix_add") + p["a"]).alias("prefix_add")))
    return joined.select(*by, F.inline(both)).select(*rows.columns, "prefix_mul", "prefix_add")
