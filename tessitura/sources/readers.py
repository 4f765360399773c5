"""Readers: utterance shards, candidate lines, datasets by suffix, speaker folders."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.functions.text import is_blank, strip
from tessitura.operators.preferences import CANDIDATES


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Parquet utterances as (audio bytes, text, speaker, duration, dnsmos): the audio column is
    ``mp3`` or ``audio``, bytes or a struct with bytes; rows without bytes or text are left out.
    Only the columns named here are read."""
    df = spark.read.parquet(path)
    name = "mp3" if has(df, "mp3") else "audio"
    if not has(df, name) or not has(df, "text"):
        raise ValueError("shards need text and an mp3 or audio column")
    kind = dict(df.dtypes)[name]
    audio = F.col(name)["bytes"] if kind.startswith("struct") else F.col(name)
    optional = lambda c, t: (F.col(c) if has(df, c) else F.lit(None)).cast(t).alias(c)
    out = df.select(audio.alias("audio"), F.col("text"), optional("speaker", "string"), optional("duration", "double"), optional("dnsmos", "double"))
    return out.where(F.col("audio").isNotNull() & ~is_blank(F.col("text"))).withColumn("text", strip(F.col("text")))


def read_dataset(spark: SparkSession, path: str, split: str | None = None, schema: str | None = None) -> DataFrame:
    """By suffix: json and jsonl, parquet, csv; a folder is a saved dataset, with a folder for each
    split or a ``split`` column if a split is asked for."""
    reader = spark.read.schema(schema) if schema else spark.read
    low = path.rstrip("/").lower()
    if low.endswith((".json", ".jsonl")):
        return reader.json(path)
    if low.endswith(".parquet"):
        return reader.parquet(path)
    if low.endswith(".csv"):
        return reader.option("header", True).csv(path)
    if "." in low.rsplit("/", 1)[-1]:
        raise ValueError(f"unknown kind of file {path!r}")
    if split is None:
        return reader.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/{split}")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return reader.parquet(f"{path}/{split}")
    df = reader.parquet(path)
    if has(df, "split"):
        chosen = df.where(F.col("split") == split)
        if not chosen.isEmpty():
            return chosen.drop("split")
    raise KeyError(split)


def read_pairs(spark: SparkSession, path: str, fine_grained: bool = False, split: str | None = None) -> DataFrame:
    """Preference pairs, with the columns checked and at least one row."""
    df = read_dataset(spark, path, split)
    missing = [c for c in ("prompt_input_ids", "chosen_input_ids", "rejected_input_ids") if not has(df, c)]
    masks = ("selection_mask", "chosen_selection_mask", "rejected_selection_mask")
    if missing or (fine_grained and not any(has(df, c) for c in masks)):
        raise ValueError(f"missing columns {missing or 'of selection masks'}")
    if df.isEmpty():
        raise ValueError("there are no pairs")
    return df


def numbered_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(source_file, source_line, value) of text files. With ``parts``, a folder is one file, whose lines are numbered
    through its parts: by name, shorter names first, as Spark numbers what it writes; ``source_file`` is then the folder.

    Lines are numbered within the block of the file that a task reads; how many lines come before a block is a sum
    over the blocks of its file. There is a row for each block, so these are sent to the lines, which stay where they are read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("part", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    blocks = blocks.withColumn("source_file", F.regexp_replace("part", "/[^/]*$", "") if parts else F.col("part"))
    before = Window.partitionBy("source_file").orderBy(F.length("part"), "part", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("part", "block", "source_file", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lines.join(F.broadcast(blocks), ["part", "block"]).select("source_file", (F.col("at") + F.col("shift")).alias("source_line"), "value")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of (prompt_input_ids, candidates) with their file, ``source_file``, and ``source_line``, from 1 in each
    file; blank lines are left out but counted. A line that is no such object stops the job."""
    lines = numbered_lines(spark, path)
    parsed = F.from_json("value", f"prompt_input_ids array<int>, candidates {CANDIDATES}", {"mode": "FAILFAST"})
    return lines.where(~is_blank(F.col("value"))).select("source_file", "source_line", parsed.alias("r")).select("source_file", "source_line", "r.prompt_input_ids", "r.candidates")


def read_speakers(spark: SparkSession, root: str) -> DataFrame:
    """For each folder with ``t.txt``: the transcript and its first ``.wav`` by name."""
    files = lambda pattern: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")
    said = files("t.txt").select(folder, strip(F.decode("content", "UTF-8")).alias("transcript"))
    waves = files("*.[wW][aA][vV]").select(folder, "path").groupBy("folder").agg(F.min("path").alias("audio_path"))  # contents are not read
    return waves.join(said, "folder").select(F.regexp_extract("folder", r"([^/]*)$", 1).alias("speaker"), "audio_path", "transcript")


#: Glob patterns of the known subsets.
SUBSETS = {"parquet": ("data/*.parquet",), "emilia": ("Emilia/EN/*.tar",), "emilia-yodas": ("Emilia-YODAS/EN/*.tar",)}


def prune(paths: list[str], subsets: list[str]) -> list[str]:
    """The paths that the subsets' patterns allow, sorted."""
    unknown = [s for s in subsets if s not in SUBSETS]
    if unknown:
        raise ValueError(f"unknown subsets {unknown}")
    patterns = [p for s in subsets for p in SUBSETS[s]]
    return sorted(p for p in paths if any(fnmatch.fnmatch(p, q) for q in patterns))


def audio_kind(audio: Column) -> Column:
    """Which part of an audio struct is used: array, else bytes, else path."""
    return F.when(audio["array"].isNotNull(), "array").when(audio["bytes"].isNotNull(), "bytes").when(audio["path"].isNotNull(), "path")
