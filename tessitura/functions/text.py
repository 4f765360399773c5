"""Text as columns: stripping, prompts, normalizing, and edit distance by words and characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.alignment import token_distance

_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip(text: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def prompt_text(text: Column, speaker: Column | None, mode: str = "sharded") -> Column:
    """``speaker: text``. ``generic``: whenever there is a speaker column, text as it is;
    ``sharded``: if the speaker is not null or empty, text stripped; ``always``: even for a null
    speaker, as ``None``; ``voice``: if the speaker is not null, text as it is."""
    if mode not in ("generic", "sharded", "always", "voice"):
        raise ValueError(f"unknown mode {mode!r}")
    body = strip(text) if mode in ("sharded", "always") else text
    if speaker is None:
        return body
    if mode in ("generic", "always"):
        return F.concat(F.coalesce(speaker, F.lit("None")), F.lit(": "), body)
    there = speaker.isNotNull() if mode == "voice" else F.coalesce(speaker, F.lit("")) != ""
    return F.when(there, F.concat(speaker, F.lit(": "), body)).otherwise(body)


def code_points(text: Column) -> Column:
    """A stand-in for a tokenizer: a text's code points. It is no subword tokenizer."""
    chars = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    # UTF-32 gives each character in four bytes, so the number is exact beyond the basic plane
    return F.transform(chars, lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))


def normalize_ascii(text: Column) -> Column:
    """Lower case, punctuation to spaces, runs of spaces to one: exact for ASCII text."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\p{P}\p{Z}]", " "), r"\s+", " "))


def basic_normalize(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join("".join(" " if unicodedata.category(c)[0] in "PZ" else c for c in folded).split())


def _normalized(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else basic_normalize(t) for t in texts.to_pylist()], pa.string())


def normalize(text: str | Column) -> Column:
    """NFKC, case folding, punctuation and separators to single spaces, for any language. SQL has the
    classes of ASCII text, which is done there; only what else there is goes to a function."""
    text = F.col(text) if isinstance(text, str) else text
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, normalize_ascii(text)).otherwise(F.arrow_udf(_normalized, "string")(F.when(~plain, text)))


def normalizer(name: str | None) -> Callable[[Column], Column]:
    if name in (None, "none", "raw"):
        return lambda text: text
    if name in ("basic", "multilingual"):
        return normalize
    if name == "ascii":
        return normalize_ascii
    raise ValueError(f"unknown normalizer {name!r}")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{_SPACE}+"), lambda w: w != "")


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Word edits over the reference's words, or over 1 if it has none."""
    r = words(reference)
    return token_distance(r, words(hypothesis)) / F.greatest(F.size(r), F.lit(1))


def character_error_rate(reference: Column, hypothesis: Column, keep_space: bool = False) -> Column:
    if not keep_space:
        reference, hypothesis = (F.regexp_replace(x, _SPACE, "") for x in (reference, hypothesis))
    return F.levenshtein(reference, hypothesis) / F.greatest(F.length(reference), F.lit(1))
