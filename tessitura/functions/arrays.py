"""Token arrays as columns: codec frames, grammar, labels and masks.

Arguments are columns of ``array<int>`` unless stated. A null array gives null. Functions that
can find fault have a ``*_fault`` companion, null where there is none, so that a caller can drop,
count or stop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.plans.layout import IGNORE, Codec

#: Error kinds that run on to the end of a completion.
TAIL_ERRORS = ("repetition", "truncation", "early_stop", "omission", "global")

#: The seven places of a SNAC frame: layer, and which of its codes for a frame.
SNAC_PLACES = ((0, 0), (1, 0), (2, 0), (2, 1), (1, 1), (2, 2), (2, 3))
SNAC_SIZE = 4096
MIMI_SIZE = 2048


def numbers(n: Column) -> Column:
    """0 to below n."""
    n = n.cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n.isNotNull(), F.array().cast("array<int>"))


def bound_to(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def lit_array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def whole_frames(codes: Column, group: int) -> Column:
    """An array of frames; a partial one at the end is left out."""
    return F.transform(numbers(F.floor(F.size(codes) / group)), lambda i: F.slice(codes, i * group + 1, group))


# -- interleaving -------------------------------------------------------------------------------
def snac_interleave(coarse: Column, middle: Column, fine: Column) -> Column:
    """Layers with n, 2n and 4n codes to n frames of 7; the code at place k is raised by 4096 k."""
    layers = (coarse, middle, fine)
    frame = lambda i: F.array(*(F.get(layers[layer], i * 2**layer + j) + k * SNAC_SIZE for k, (layer, j) in enumerate(SNAC_PLACES)))
    return F.flatten(F.transform(numbers(F.size(coarse)), frame))


def snac_deinterleave(codes: Column) -> Column:
    """A struct of the three layers, codes brought into 0 to 4095; null if there is no whole frame."""
    frames = whole_frames(codes, len(SNAC_PLACES))

    def layer(n: int) -> Column:
        places = [k for k, (own, _) in enumerate(SNAC_PLACES) if own == n]
        return F.flatten(F.transform(frames, lambda f: F.array(*(bound(f[k] - k * SNAC_SIZE, SNAC_SIZE) for k in places))))

    made = F.struct(layer(0).alias("coarse"), layer(1).alias("middle"), layer(2).alias("fine"))
    return F.when(F.size(codes) >= len(SNAC_PLACES), made)


def bound(code: Column, size: int) -> Column:
    return F.least(F.greatest(code, F.lit(0)), F.lit(size - 1))


def mimi_interleave(codebooks: Column) -> Column:
    """An array of codebooks, each an array over time, to frames; codebook k is raised by 2048 k."""
    return F.flatten(F.transform(numbers(F.size(F.get(codebooks, F.lit(0)))), lambda t: F.transform(codebooks, lambda book, k: F.get(book, t) + k * MIMI_SIZE)))


def mimi_deinterleave(codes: Column, codebooks: int) -> Column:
    """Codebooks over time, codes brought into 0 to 2047; null if there is no whole frame."""
    n = F.floor(F.size(codes) / codebooks).cast("int")
    books = F.transform(F.sequence(F.lit(0), F.lit(codebooks - 1)), lambda k: F.transform(numbers(n), lambda t: bound(F.get(codes, t * codebooks + k) - k * MIMI_SIZE, MIMI_SIZE)))
    return F.when(F.size(codes) >= codebooks, books)


def offset(codes: Column, start: int) -> Column:
    return F.transform(codes, lambda c: c + start)


# -- frames -------------------------------------------------------------------------------------
def frames_fault(codes: Column, group: int) -> Column:
    return F.when(F.size(codes) % group != 0, F.lit("partial frame"))


def drop_repeated_frames(codes: Column, group: int, by_first: bool = False) -> Column:
    """Without frames that equal the one before (``by_first``: whose first code does). Null for a
    length that is no multiple of ``group``. The last kept frame always equals the one before, so
    neighbours alone decide."""
    frames = whole_frames(codes, group)

    def kept(f: Column) -> Column:
        # each frame beside the one before it; the first has null there
        pairs = F.zip_with(f, F.concat(F.array(F.lit(None).cast("array<int>")), f), lambda own, last: F.struct(own.alias("own"), last.alias("last")))
        changed = lambda p: p["own"][0] != p["last"][0] if by_first else p["own"] != p["last"]
        return F.transform(F.filter(pairs, lambda p: p["own"].isNotNull() & (p["last"].isNull() | changed(p))), lambda p: p["own"])

    return F.when(F.size(codes) % group == 0, F.flatten(bound_to(frames, kept)))


def in_phase(token: Column, place: Column, group: int, size: int, start: int = 0) -> Column:
    low = F.lit(start) + (place % group) * size
    return (token >= low) & (token < low + size)


def validity(tokens: Column, group: int, size: int, start: int = 0, partial: bool = False, strict: bool = False) -> Column:
    """The share of tokens in their place's range; those after the last whole frame count only
    with ``partial``. Empty arrays have 0. ``strict``: 1 if all are valid, else 0."""
    whole = F.size(tokens) - F.size(tokens) % group
    good = F.size(F.filter(F.transform(tokens, lambda t, i: in_phase(t, i, group, size, start) & (F.lit(partial) | (i < whole))), lambda ok: ok))
    share = F.when(F.size(tokens) > 0, good.cast("double") / F.size(tokens)).otherwise(0.0)
    return F.when(tokens.isNotNull(), (share == 1.0).cast("double") if strict else share)


# -- extraction and grammar ---------------------------------------------------------------------
def _speech(tokens: Column, start: int, end: int) -> tuple[Column, Column, Column]:
    """Whether there is a start, whether an end follows the last one, and what is between."""
    from_last = F.array_position(F.reverse(tokens), start)
    rest = F.slice(tokens, F.size(tokens) - from_last + 2, F.greatest(from_last - 1, F.lit(0)).cast("int"))
    stop = F.array_position(rest, end)
    return from_last > 0, stop > 0, F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest)


def extract_fault(tokens: Column, start: int, end: int, audio_start: int, codec: Codec) -> Column:
    """What forbids a strict extraction: ``missing start``, ``missing end``, ``empty``,
    ``partial frame`` or ``phase``."""
    started, ended, audio = _speech(tokens, start, end)
    right = F.forall(F.transform(audio, lambda t, i: in_phase(t, i, codec.group, codec.size, audio_start)), lambda ok: ok)
    return F.when(~started, "missing start").when(~ended, "missing end").when(F.size(audio) == 0, "empty").when(F.size(audio) % codec.group != 0, "partial frame").when(~right, "phase")


def extract_codes(tokens: Column, start: int, end: int, audio_start: int, codec: Codec, strict: bool = True) -> Column:
    """Codes after the last start, up to the first end behind it. Strict: null with any fault.
    Lenient: a missing end is the end of the row, a partial frame is cut, other faults give none."""
    started, _, audio = _speech(tokens, start, end)
    if not strict:
        audio = F.slice(audio, F.lit(1), F.size(audio) - F.size(audio) % codec.group)
    right = F.forall(F.transform(audio, lambda t, i: in_phase(t, i, codec.group, codec.size, audio_start)), lambda ok: ok)
    codes = F.transform(audio, lambda t: t - audio_start)
    if strict:
        return F.when(extract_fault(tokens, start, end, audio_start, codec).isNull(), codes)
    return F.when(started & right, codes).when(tokens.isNotNull(), F.array().cast("array<int>"))


def restore_end(tokens: Column, end: int, reason: Column, matched: Column | None = None) -> Column:
    """Appends the end token where the backend stopped there but left it out."""
    stopped = F.coalesce(F.lower(reason).isin("stop", "eos", "eos_token"), F.lit(False))
    if matched is not None:
        stopped = stopped & (matched.isNull() | (matched == end))
    return F.when(~F.array_contains(tokens, end) & stopped, F.array_append(tokens, F.lit(end))).otherwise(tokens)


def next_tokens(suffix: Column, start_of_ai: int, start: int, end: int, audio_start: int, codec: Codec, pad: int | None = None, min_frames: int = 1) -> Column:
    """What the grammar lets follow a generated suffix: a struct of ``forced`` (the only token),
    or ``low`` and ``high`` (codes from low to below high) with ``end_ok``, or ``fault``."""
    n, least = F.size(suffix), min_frames * codec.group
    head = F.get(suffix, F.lit(0)), F.get(suffix, F.lit(1))
    stop = F.array_position(suffix, end)
    before = stop - 3  # codes before the end
    audio = F.slice(suffix, F.lit(3), F.greatest(n - 2, F.lit(0)))
    right = F.forall(F.transform(audio, lambda t, i: in_phase(t, i, codec.group, codec.size, audio_start)), lambda ok: ok)
    fault = (
        F.when((n > 0) & (head[0] != start_of_ai), "no start of answer")
        .when((n > 1) & (head[1] != start), "no start of speech")
        .when((stop > 0) & ((before < least) | (before % codec.group != 0)), "early end")
        .when((stop == 0) & (n > 2) & ~right, "phase")
    )
    forced = F.when(stop > 0, F.lit(end if pad is None else pad)).when(n == 0, F.lit(start_of_ai)).when(n == 1, F.lit(start))
    phase = F.size(audio) % codec.group
    low = F.when(fault.isNull() & forced.isNull(), audio_start + phase * codec.size)
    return F.struct(F.when(fault.isNull(), forced).alias("forced"), low.cast("int").alias("low"), (low + codec.size).cast("int").alias("high"), F.when(low.isNotNull(), (F.size(audio) >= least) & (phase == 0)).alias("end_ok"), fault.alias("fault"))


def next_tokens_everywhere(tokens: Column, start_of_ai: int, start: int, end: int, audio_start: int, codec: Codec, pad: int | None = None, min_frames: int = 1) -> Column:
    """``next_tokens`` of every prefix of a sequence, the empty and the whole one too: an array of structs
    with ``position``, the length of the prefix, and its fields.

    Once in a fault, the grammar stays in it, and what the states before depend on are the places of the
    first end and of the first code out of phase; one pass finds them, and each position follows from them.
    """
    least = min_frames * codec.group
    out_of_phase = F.transform(tokens, lambda t, i: F.when((i > 1) & ~in_phase(t, i - 2, codec.group, codec.size, audio_start), i))
    seen = F.struct(F.array_position(tokens, end).alias("stop"), F.array_min(out_of_phase).alias("wrong"), F.get(tokens, F.lit(0)).alias("first"), F.get(tokens, F.lit(1)).alias("second"))

    def at(n: Column, s: Column) -> Column:
        stopped = (s["stop"] > 0) & (s["stop"] <= n)
        codes = s["stop"] - 3
        fault = (
            F.when((n > 0) & (s["first"] != start_of_ai), "no start of answer")
            .when((n > 1) & (s["second"] != start), "no start of speech")
            .when(stopped & ((codes < least) | (codes % codec.group != 0)), "early end")
            .when(~stopped & (s["wrong"] < n), "phase")
        )
        right = fault.isNull()
        phase = F.pmod(n - 2, F.lit(codec.group))
        forced = F.when(right, F.when(stopped, F.lit(end if pad is None else pad)).when(n == 0, F.lit(start_of_ai)).when(n == 1, F.lit(start)))
        low = F.when(right & ~stopped & (n > 1), audio_start + phase * codec.size).cast("int")
        return F.struct(n.alias("position"), forced.alias("forced"), low.alias("low"), (low + codec.size).cast("int").alias("high"), F.when(low.isNotNull(), (n - 2 >= least) & (phase == 0)).alias("end_ok"), fault.alias("fault"))

    return bound_to(seen, lambda s: F.transform(F.sequence(F.lit(0), F.size(tokens)), lambda n: at(n, s)))


# -- labels and masks ---------------------------------------------------------------------------
def completion_fault(tokens: Column, marker: int) -> Column:
    at = F.array_position(tokens, marker)
    return F.when(at == 0, "missing marker").when(at == F.size(tokens), "empty completion")


def completion_labels(tokens: Column, marker: int, ignore: int = IGNORE) -> Column:
    """The tokens after the first marker; up to it, the ignored label. Null with a fault."""
    at = F.array_position(tokens, marker).cast("int")
    return F.when(completion_fault(tokens, marker).isNull(), F.concat(F.array_repeat(F.lit(ignore), at), F.slice(tokens, at + 1, F.size(tokens))))


def prefix_labels(tokens: Column, masked: Column, ignore: int = IGNORE) -> Column:
    return F.transform(tokens, lambda t, i: F.when(i < masked, F.lit(ignore)).otherwise(t))


def attention(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lit(1))


def span_fault(length: Column, spans: Column, group: int, start: int = 2) -> Column:
    bad = F.exists(spans, lambda s: s["start_frame"].isNull() | (s["start_frame"] < 0) | (F.coalesce(s["end_frame"], s["start_frame"] + 1) <= s["start_frame"]))
    return F.when((length <= 0) | (length <= start), "bad length").when(bad, "bad span").when(~F.exists(_spanned(length, spans, group, start), lambda x: x), "no token selected")


def _spanned(length: Column, spans: Column, group: int, start: int) -> Column:
    def inside(i: Column, s: Column) -> Column:
        tail = F.coalesce(F.lower(F.trim(s["type"])), F.lit("local")).isin(*TAIL_ERRORS)
        last = F.when(tail, length).otherwise(start + F.coalesce(s["end_frame"], s["start_frame"] + 1) * group)
        return (i >= start + s["start_frame"] * group) & (i < last)

    return F.transform(numbers(length), lambda i: F.exists(spans, lambda s: inside(i, s)))


def span_mask(length: Column, spans: Column, group: int, start: int = 2) -> Column:
    """True at the tokens of spans of frames, ends excluded; the kinds in ``TAIL_ERRORS`` run to the
    end of the completion. Null with a fault, such as spans that select nothing."""
    return F.when(span_fault(length, spans, group, start).isNull(), _spanned(length, spans, group, start))


def pack(values: Column, mask: Column, selected: Column, width: Column) -> Column:
    """The values under a mask moved to the left, with whether each place is valid and selected,
    filled up to ``width``."""
    fill = F.array_repeat(F.struct(F.lit(0.0).alias("value"), F.lit(False).alias("valid"), F.lit(False).alias("selected")), (width - F.size(F.filter(mask, lambda m: m))).cast("int"))
    kept = F.filter(F.transform(values, lambda v, i: F.struct(v.cast("double").alias("value"), F.get(mask, i).alias("valid"), F.get(selected, i).alias("selected"))), lambda z: z["valid"])
    return F.concat(kept, fill)


def phase_weights(labels: Column, audio_start: int, size: int, weights: list[float], boundary: dict[int, float] | None = None, ignore: int = IGNORE) -> Column:
    """A weight for each label: its codebook's, a boundary token's own, 1 for others, 0 if ignored."""
    table = lit_array([float(w) for w in weights])

    def weight(t: Column) -> Column:
        out = F.when(t == ignore, 0.0)
        for token, w in (boundary or {}).items():
            out = out.when(t == token, float(w))
        audio = (t >= audio_start) & (t < audio_start + len(weights) * size)
        return out.when(audio, F.get(table, F.floor((t - audio_start) / size).cast("int"))).otherwise(1.0)

    return F.transform(labels, weight)


def fade_out(wave: Column, rate: int, milliseconds: int = 50) -> Column:
    """The last samples brought down to 0 in a straight line."""
    n = F.least(F.lit(rate * milliseconds // 1000), F.size(wave))
    first = F.size(wave) - n
    gain = lambda i: F.when(n > 1, 1.0 - (i - first).cast("double") / (n - 1)).otherwise(1.0)
    return F.transform(wave, lambda x, i: F.when(i >= first, x * gain(i)).otherwise(x.cast("double")))


# -- checks -------------------------------------------------------------------------------------
def tokens_fault(tokens: Column, allow_empty: bool = False) -> Column:
    empty = F.lit(False) if allow_empty else F.size(tokens) == 0
    return F.when(tokens.isNull(), "null").when(empty, "empty").when(F.exists(tokens, lambda t: t.isNull() | (t < 0)), "bad token")


def mask_fault(mask: Column, length: Column) -> Column:
    return F.when(mask.isNull(), "null").when(F.size(mask) != length, "wrong length").when(F.exists(mask, lambda m: m.isNull() | ~m.isin(0, 1)), "not binary")


def weight_fault(weight: Column) -> Column:
    return F.when(weight.isNull(), "null").when(F.isnan(weight) | (F.abs(weight) == float("inf")) | (weight <= 0), "not positive")


def max_token(*arrays: Column) -> Column:
    return F.greatest(F.lit(-1), *(F.coalesce(F.array_max(a), F.lit(-1)) for a in arrays))
