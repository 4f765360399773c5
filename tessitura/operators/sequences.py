"""Training sequences and prompts from utterances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions import arrays, text
from tessitura.operators.filters import reject_reason
from tessitura.plans.layout import TokenLayout


def _ids(*tokens: int) -> Column:
    return F.array(*(F.lit(t) for t in tokens))


def prompt_tokens(text_ids: Column, lay: TokenLayout) -> Column:
    return F.concat(_ids(lay.start_of_human), text_ids, _ids(lay.end_of_text, lay.end_of_human))


def answer_tokens(codes: Column, lay: TokenLayout) -> Column:
    return F.concat(_ids(lay.start_of_ai, lay.start_of_speech), codes, _ids(lay.end_of_speech, lay.end_of_ai))


def assemble(df: DataFrame, lay: TokenLayout, text_ids: Column, completion_only: bool = True, deduplicate: bool = False, min_quality: float | None = None, min_duration: float | None = None, max_duration: float | None = None) -> DataFrame:
    """Training rows from (text, speaker, codes, duration, dnsmos): filtered, framed, labelled.

    ``text_ids`` are the ids of the prompt text; codes already have the layout's offset. One
    narrow projection: no shuffle.
    """
    codes = F.col("codes")
    fault = arrays.frames_fault(codes, lay.codec.group) if deduplicate else None
    df = df.where(reject_reason(df, min_quality, min_duration, max_duration, fault).isNull())
    if deduplicate:
        df = df.withColumn("codes", arrays.drop_repeated_frames(codes, lay.codec.group))
    df = df.withColumn("_text", text_ids).withColumn("input_ids", F.concat(prompt_tokens(F.col("_text"), lay), answer_tokens(codes, lay)))
    masked = F.size("_text") + 2
    labels = arrays.prefix_labels(F.col("input_ids"), masked) if completion_only else F.col("input_ids")
    optional = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("duration", "dnsmos") if c in df.columns]
    keys = [c for c in df.columns if c == "id"]
    return df.select(*keys, "input_ids", labels.alias("labels"), arrays.attention(F.col("input_ids")).alias("attention_mask"), F.col("text").alias("reference_text"), F.col("speaker").alias("speaker_id"), *optional)


def prompts(df: DataFrame, lay: TokenLayout, voice: str | None = None, voices: tuple[str, ...] = (), seed: int = 0, tokenizer: Callable[[Column], Column] = text.code_points) -> DataFrame:
    """Inference prompts from ``text``, and the column named ``voice``, in the ids of ``tokenizer`` (see ``plugins.tokenize_with``). With ``voices``, rows without a
    voice get one of these, drawn by the seed and the row's own values, so that reruns agree."""
    speaker = F.col(voice) if voice else None
    if voices:
        drawn = F.element_at(F.array(*map(F.lit, voices)), (F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(len(voices))) + 1).cast("int"))
        speaker = drawn if speaker is None else F.coalesce(speaker, drawn)
    said = text.prompt_text(F.col("text"), speaker, "voice")
    return df.withColumn("prompt", prompt_tokens(tokenizer(said), lay))


def clone_prompts(references: DataFrame, targets: DataFrame, lay: TokenLayout, key: str, tokenizer: Callable[[Column], Column] = text.code_points) -> DataFrame:
    """For each target (key, text) and the references (key, ref_text, ref_codes) with its key: the
    reference's whole turn, then the target's opened turn."""
    both = targets.join(references, key)
    turn = F.concat(prompt_tokens(tokenizer(F.col("ref_text")), lay), answer_tokens(arrays.offset(F.col("ref_codes"), lay.audio_start), lay))
    return both.withColumn("prompt", F.concat(turn, prompt_tokens(tokenizer(F.col("text")), lay)))
