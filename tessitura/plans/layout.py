"""Token layouts and codec shapes: the constants that token sequences are built from."""

from __future__ import annotations

from dataclasses import dataclass

IGNORE = -100

#: Tokenizer length, start and end of text, codec of the known layouts.
LAYOUTS = {
    "lfm2": (64400, 1, 7, "snac"),
    "lfm2_5": (64400, 1, 7, "mimi"),
    "llama3": (128256, 128000, 128009, "snac"),
    "qwen3": (151669, 151643, 151645, "snac"),
}


@dataclass(frozen=True)
class Codec:
    """A frame has ``group`` codes; the code at place k of a frame lies in [k * size, (k + 1) * size)."""

    name: str
    group: int
    size: int

    @property
    def capacity(self) -> int:
        return self.group * self.size


def codec(name: str, codebooks: int | None = None) -> Codec:
    if name == "snac":
        return Codec(name, 7, 4096)
    if name == "mimi":
        n = 8 if codebooks is None else codebooks
        if not 1 <= n <= 32:
            raise ValueError("mimi has 1 to 32 codebooks")
        return Codec(name, n, 2048)
    raise ValueError(f"unknown codec {name!r}")


@dataclass(frozen=True)
class TokenLayout:
    """Control tokens stand at fixed distances from the tokenizer's length."""

    length: int
    start_of_text: int
    end_of_text: int
    codec: Codec

    def _after(self, n: int) -> int:
        return self.length + n

    start_of_speech = property(lambda self: self._after(1))
    end_of_speech = property(lambda self: self._after(2))
    start_of_human = property(lambda self: self._after(3))
    end_of_human = property(lambda self: self._after(4))
    start_of_ai = property(lambda self: self._after(5))
    end_of_ai = property(lambda self: self._after(6))
    pad = property(lambda self: self._after(7))
    audio_start = property(lambda self: self._after(10))


def layout(name: str, codebooks: int | None = None) -> TokenLayout:
    if name not in LAYOUTS:
        raise ValueError(f"unknown layout {name!r}")
    length, start, end, kind = LAYOUTS[name]
    return TokenLayout(length, start, end, codec(kind, codebooks if kind == "mimi" else None))


def check_extension(layout: TokenLayout, first_custom: int) -> list[str]:
    """Names of the custom tokens, whose seventh is the padding and tenth the first code."""
    if layout.pad != first_custom + 7 or layout.audio_start != first_custom + 10:
        raise ValueError("padding must be custom token 7 and codes must start at custom token 10")
    return [f"<custom_token_{i}>" for i in range(layout.codec.capacity + 11)]
