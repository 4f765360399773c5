"""Row filters over utterances, with the reason for each rejected row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.text import is_blank


def _zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def reject_reason(df: DataFrame, min_quality: float | None = None, min_duration: float | None = None, max_duration: float | None = None, codes_fault: Column | None = None) -> Column:
    """The first that applies: ``empty codes``, ``quality``, ``short``, ``long``, then any fault
    of the codes. Missing quality and duration count as 0; NaN passes every bound."""
    quality, duration = _zero(df, "dnsmos"), _zero(df, "duration")
    number = lambda x: ~F.isnan(x)
    out = F.when(F.col("codes").isNull() | (F.size("codes") <= 0), "empty codes")
    if min_quality is not None:
        out = out.when(number(quality) & (quality < min_quality), "quality")
    if min_duration is not None:
        out = out.when(number(duration) & (duration < min_duration), "short")
    if max_duration is not None:
        out = out.when(number(duration) & (duration > max_duration), "long")
    return out if codes_fault is None else out.otherwise(codes_fault)


def filter_utterances(df: DataFrame, **bounds) -> DataFrame:
    return df.where(reject_reason(df, **bounds).isNull())


def count_reasons(df: DataFrame, reason: Column) -> DataFrame:
    """Rows by reason, ``accepted`` among them."""
    return df.groupBy(F.coalesce(reason, F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def with_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(text)))


def with_codes(df: DataFrame, codes: str = "codes") -> DataFrame:
    return df.where(F.col(codes).isNotNull() & (F.size(codes) > 0))


def require_no_fault(df: DataFrame, fault: Column, what: str) -> DataFrame:
    """All rows, or an error that names the first fault that is met."""
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit(f"{what}: "), fault))).otherwise(F.lit(True))
    return df.where(checked.cast("boolean"))
