"""Edit distance and alignment of token sequences of any length and alphabet, by bit vectors.

A column of the edit table is held as the signs of its vertical steps, a bit for each reference token,
so one hypothesis token costs a dozen operations on whole columns. Numbers of substitutions,
deletions and insertions come from walking back over the columns; only every root-th one is kept, and the
others are worked out again a stretch at a time, so memory grows with the reference's length times the root
of the hypothesis's and not with the table.

Alignments are not unique. The one counted here goes, from the ends of both sequences, over a pair of equal
tokens where there is one, else over a substitution, a deletion or an insertion, the first of these that
an alignment with the fewest edits can have there.
"""

from __future__ import annotations

from collections import defaultdict
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Counts = tuple[int, int, int]


def _marks(reference: list) -> dict:
    """For each token the bits of its places, from lists of places, which a hot token may fill."""
    places = defaultdict(list)
    for i, token in enumerate(reference):
        places[token].append(i)
    size = len(reference) // 8 + 1
    out = {}
    for token, at in places.items():
        bits = bytearray(size) if len(at) > 8 else None
        if bits is None:
            out[token] = sum(1 << i for i in at)
        else:
            for i in at:
                bits[i >> 3] |= 1 << (i & 7)
            out[token] = int.from_bytes(bits, "little")
    return out


def _next(marks: int, up: int, down: int, all_ones: int) -> tuple[int, int, int, int, int]:
    """The next column: bits where a cell is its upper left neighbour's equal, the signs of the vertical
    steps, and those of the horizontal ones (before they are moved by a row)."""
    same = ((((marks & up) + up) ^ up) | marks | down) & all_ones
    right = down | (all_ones & ~(same | up))
    left = up & same
    moved = ((right << 1) | 1) & all_ones
    return same, ((left << 1) & all_ones) | (all_ones & ~(same | moved)), moved & same, right, left


def distance(reference: list, hypothesis: list) -> int:
    if len(reference) < len(hypothesis):
        reference, hypothesis = hypothesis, reference  # fewer, longer steps
    if not hypothesis:
        return len(reference)
    marks, ones, last = _marks(reference), (1 << len(reference)) - 1, 1 << (len(reference) - 1)
    up, down, total = ones, 0, len(reference)
    for token in hypothesis:
        _, up, down, right, left = _next(marks.get(token, 0), up, down, ones)
        total += bool(right & last) - bool(left & last)
    return total


def edit_counts(reference: list, hypothesis: list) -> Counts:
    """Substitutions, deletions and insertions that make the reference into the hypothesis."""
    i, j = len(reference), len(hypothesis)
    marks, ones = _marks(reference), (1 << i) - 1
    stretch = isqrt(j) + 1
    kept = []
    up, down = ones, 0
    for k, token in enumerate(hypothesis):
        if k % stretch == 0:
            kept.append((up, down))
        _, up, down, _, _ = _next(marks.get(token, 0), up, down, ones)
    subs = dels = 0
    while i and j:
        first = (j - 1) // stretch * stretch
        up, down = kept[first // stretch]
        columns = []
        for token in hypothesis[first:j]:
            same, up, down, _, _ = _next(marks.get(token, 0), up, down, ones)
            columns.append((same, up))
        while i and j > first:
            same, up = columns[j - first - 1]
            bit = i - 1
            if reference[bit] == hypothesis[j - 1]:
                i, j = i - 1, j - 1
            elif not (same >> bit) & 1:
                subs, i, j = subs + 1, i - 1, j - 1
            elif (up >> bit) & 1:
                dels, i = dels + 1, i - 1
            else:
                j -= 1
    dels += i
    return subs, dels, dels + len(hypothesis) - len(reference)


def _pairs(a: pa.Array, b: pa.Array):  # noqa: ANN202
    """The pairs of a batch one by one, so that only one is held as Python objects."""
    for x, y in zip(a, b, strict=True):
        yield (None, None) if not (x.is_valid and y.is_valid) else (x.as_py(), y.as_py())


def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None else distance(x, y) for x, y in _pairs(a, b)], pa.int32())


_COUNTS = pa.struct([("substitutions", pa.int32()), ("deletions", pa.int32()), ("insertions", pa.int32())])


def _counted(a: pa.Array, b: pa.Array) -> pa.Array:
    rows = [None if x is None else dict(zip(("substitutions", "deletions", "insertions"), edit_counts(x, y), strict=True)) for x, y in _pairs(a, b)]
    return pa.array(rows, _COUNTS)


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of tokens of any kind; null if one is null. SQL has one of characters only."""
    return F.arrow_udf(_distances, "int")(a, b)


def token_edits(reference: Column, hypothesis: Column) -> Column:
    """``substitutions``, ``deletions`` and ``insertions``, whose sum is the distance; null if one is null."""
    return F.arrow_udf(_counted, "struct<substitutions:int,deletions:int,insertions:int>")(reference, hypothesis)
