"""Boundaries for what needs a trained model or a vocabulary: codecs, recognizers, scorers, tokenizers.

A plug-in is a factory called once in each worker process; its object then maps batches. The
engine brings no models. ``ToyCodec`` is a stand-in that makes ids from samples by rule; it
encodes no sound and is for tests only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.plans.layout import Codec

#: Rows and bytes of text that go to a tokenizer at once.
AT_ONCE, BYTES_AT_ONCE = 256, 1 << 20


class CodecModel(Protocol):
    codec: Codec

    def encode(self, samples) -> list[int]: ...  # noqa: ANN001

    def decode(self, codes: list[int]) -> list[float]: ...


class Scorer(Protocol):
    def score(self, samples, text: str | None) -> float: ...  # noqa: ANN001


class Tokenizer(Protocol):
    def encode_batch(self, texts: list[str]) -> list[list[int]]: ...


class LibraryTokenizer:
    """A vocabulary file of the ``tokenizers`` library, read once in each worker from a path that all have."""

    def __init__(self, path: str, special_tokens: bool = True):
        import tokenizers

        self.special = special_tokens
        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=self.special)]


def tokenize_with(factory: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """A function from a text column to its ids, for ``prompts``, ``clone_prompts`` and training rows. A null text
    has null ids. Texts go to the tokenizer, and their ids back to Spark, in pieces of up to ``AT_ONCE`` rows and
    ``BYTES_AT_ONCE`` of text, or one longer text, so a worker's memory depends on neither the input nor Spark's batches."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for batch in batches:
            if not len(batch):
                yield pa.array([], pa.list_(pa.int32()))
            for part in _pieces(batch):
                texts = part.to_pylist()
                made = iter(model.encode_batch([t for t in texts if t is not None]))
                yield pa.array([None if t is None else next(made) for t in texts], pa.list_(pa.int32()))

    return run


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        upto = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BYTES_AT_ONCE, side="right"))
        stop = min(max(start + 1, upto), start + AT_ONCE)
        yield texts[start:stop]
        start = stop


def encode_with(factory: Callable[[], CodecModel], wave: Column) -> Column:
    """Codes of each waveform; null where the codec raises, so that a filter can count the row."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()

        def one(w):  # noqa: ANN001, ANN202
            try:
                return None if w is None else model.encode(w)
            except Exception:  # noqa: BLE001 - any failure drops the row, as documented
                return None

        for batch in batches:
            yield batch.map(one)

    return run(wave)


def score_with(factory: Callable[[], Scorer], wave: Column, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for waves, texts in batches:
            yield pd.Series([model.score(w, t) for w, t in zip(waves, texts, strict=True)], dtype="float64")

    return run(wave, text)


class ToyCodec:
    def __init__(self, codec: Codec):
        self.codec = codec

    def encode(self, samples) -> list[int]:  # noqa: ANN001
        n = len(samples) // self.codec.group * self.codec.group
        return [int((float(x) + 1) / 2 * (self.codec.size - 1)) + i % self.codec.group * self.codec.size for i, x in enumerate(samples[:n])]

    def decode(self, codes: list[int]) -> list[float]:
        return [(c - i % self.codec.group * self.codec.size) / (self.codec.size - 1) * 2 - 1 for i, c in enumerate(codes)]
