"""Domain views over the star-schema test tables: utterances, codec frames, candidates, rollouts.

They have the shapes of speech data; none of it is real audio, codec output or a measured score.
Each view has the SQL that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UTTERANCES = "SELECT d.doc_id AS id, d.text, d.source AS speaker, d.n_chars / 15.0::DOUBLE AS duration, 1.0::DOUBLE + 3 * l.quality - l.toxic AS dnsmos FROM documents d LEFT JOIN labels l USING (doc_id)"
_CODE = "CAST(least(greatest(floor((x::DOUBLE + 1) * {half}), 0), {top}) AS INTEGER)"
FRAMES = f"SELECT vec_id AS id, label, list_transform(embedding, lambda x, i: {_CODE.format(half=1024, top=2047)} + CAST((i - 1) % 8 * 2048 AS INTEGER)) AS codes FROM embeddings"
SNAC = f"SELECT vec_id AS id, list_transform(embedding || embedding[1:6], lambda x, i: {_CODE.format(half=2048, top=4095)} + CAST((i - 1) % 7 * 4096 AS INTEGER)) AS codes FROM embeddings"
LAYERS = f"SELECT vec_id AS id, v[1:10] AS coarse, v[11:30] AS middle, v[31:70] AS fine FROM (SELECT vec_id, list_transform(embedding || embedding[1:6], lambda x, i: {_CODE.format(half=2048, top=4095)}) AS v FROM embeddings)"
REPEATS = "SELECT user_id, list(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE length(event_type) END::INTEGER ORDER BY ts, event_id) AS codes FROM events GROUP BY user_id"
CANDIDATES = "SELECT user_id AS g, event_id AS i, round(exp(-value / 100), 6) AS clear, CAST(props->>'$.k' AS DOUBLE) / 99 AS speaker, (event_id % 11) / 10.0::DOUBLE AS quality, value FROM events"
PAIRS = """SELECT a.conv_id AS id, a.turn, a.text AS ref, b.text AS hyp
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("speaker"), (F.col("n_chars") / F.lit(15.0)).alias("duration"), (F.lit(1.0) + 3 * F.col("quality") - F.col("toxic")).alias("dnsmos"))


def _quantized(vector, half: int, top: int):  # noqa: ANN001, ANN202
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * half), F.lit(0)), F.lit(top)).cast("int"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("id"), "label", F.transform(_quantized("embedding", 1024, 2047), lambda c, i: c + i % 8 * 2048).alias("codes"))


def _whole_frames():  # noqa: ANN202
    """All 64 components and the first six again, which makes ten frames of seven codes."""
    return F.concat("embedding", F.slice("embedding", 1, 6))


def snac(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("id"), F.transform(_quantized(_whole_frames(), 2048, 4095), lambda c, i: c + i % 7 * 4096).alias("codes"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), _quantized(_whole_frames(), 2048, 4095).alias("v"))
    return df.select("id", F.slice("v", 1, 10).alias("coarse"), F.slice("v", 11, 20).alias("middle"), F.slice("v", 31, 40).alias("fine"))


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(F.length("event_type"))
    return df.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", code.alias("c")))), lambda s: s["c"]).alias("codes"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select(F.col("user_id").alias("g"), F.col("event_id").alias("i"), F.round(F.exp(-F.col("value") / 100), 6).alias("clear"), (F.get_json_object("props", "$.k").cast("double") / 99).alias("speaker"), ((F.col("event_id") % 11) / F.lit(10.0)).alias("quality"), "value")


def asr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user said and what the assistant answered, whole."""
    df = table(spark, sf_dir, "conversations")
    said = df.where("role = 'user'").select(F.col("conv_id").alias("id"), "turn", F.col("text").alias("ref"))
    heard = df.where("role = 'assistant'").select(F.col("conv_id").alias("id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return said.join(heard, ["id", "turn"]).select("id", "turn", "ref", "hyp")
