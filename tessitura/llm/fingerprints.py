"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

A paragraph's digest is that of its text; paragraphs hash to their section, sections to the root, and equal
roots mean equal texts. A section ends after a paragraph whose digest says so (one in eight), so an edit
moves no boundary but its own.

Below the paragraphs stand leaves, cut where the text itself says: a rolling hash of the last four code points
gives every place a height, one more for each zero bit at its end, a line feed the greatest, and at level h the
text is cut after every place of that height or more. So leaves of one level are joined by those of the next, and
an insertion moves only the edges beside it, whatever the script and whether or not there are marks. A leaf's digest
is a polynomial of its code points, from which those of joined leaves follow.

A fingerprint is the root and the leaves, with their lengths and heights, of the highest level that has about the square
root of the text's length in leaves (``level_of``): a few for a short text, hundreds for a long one, runs of equal
ones written once.
Likeness is worked out from two fingerprints alone: the finer one's leaves are joined until both are
of one level, and equal leaves count by their code points. One rule holds for texts of any length.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import at, require
from tessitura.llm.token_files import id_ranges, range_of

#: Code points that the rolling hash sees, and the greatest height, which line feeds and the text's end have.
REACH = 4
TOP = 63
LEAST = 8
_U = np.uint64
_ODD = np.random.default_rng(10).integers(0, 2**63, REACH, dtype=np.uint64) * _U(2) + _U(1)
_LEAF = np.dtype([("digest", "<u8"), ("size", "<u4"), ("height", "u1"), ("times", "<u4")])


def _node(kind: bytes, children: list[bytes]) -> bytes:
    return hashlib.blake2b(kind + b"".join(children), digest_size=16).digest()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


class _Powers:
    """Powers of a number modulo 2^64, worked out as far as they were needed; long texts' are not kept."""

    KEPT = 1 << 20

    def __init__(self, base: int):
        self.base, self.table = _U(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n < len(self.table):
            return self.table
        table = np.full(max(n + 1, min(2 * n, self.KEPT)), self.base, np.uint64)
        table[0] = 1
        np.cumprod(table, out=table)
        if len(table) <= self.KEPT:
            self.table = table
        return table


_POWERS, _INVERSES = _Powers(0x9E3779B97F4A7C15), _Powers(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _sizes(ends: np.ndarray) -> np.ndarray:
    """Lengths of runs that end before these places."""
    out = ends.copy()
    out[1:] -= ends[:-1]
    return out


def heights(codes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each place's height: zero bits at the end of the hash of it and the three before. ``seen`` are the
    code points' own hashes."""
    rolling = np.zeros(len(codes), np.uint64)
    for k in range(REACH):
        rolling[k:] += seen[: len(seen) - k] * _ODD[k]
    rolling = _mixed(rolling)
    lowest = (rolling & (~rolling + _U(1))) | (rolling == 0)  # the lowest bit that is set, whose number is a float's exponent
    out = ((lowest.astype(np.float64).view(np.int64) >> 52) - 1023).astype(np.uint8)
    out[codes == 10] = TOP
    out[-1:] = TOP
    return out


def level_of(height: np.ndarray) -> int:
    """The highest level with enough leaves: half the square root of the length, or ``LEAST`` (of a
    shorter text, all its code points), each weighed by its length, so that one long leaf is not made up by
    many short ones."""
    n = len(height)
    enough = max(isqrt(n) // 2, min(n, LEAST))
    many = np.cumsum(np.bincount(height, minlength=TOP + 1)[::-1])[::-1]
    for level in range(int(np.flatnonzero(many >= enough)[-1]) if n else 0, 0, -1):
        size = _sizes(np.flatnonzero(height >= level) + 1)
        if n * n >= enough * int(np.dot(size, size)):
            return level
    return 0


def joined(digest: np.ndarray, size: np.ndarray, height: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, lengths and heights of the leaves at ``level``, made of those of a lower one."""
    last = np.flatnonzero(height >= level)
    if not len(last):
        return digest[:0], size[:0], height[:0]
    ends = np.cumsum(size, dtype=np.int64)
    sums = np.cumsum(digest * _INVERSES.upto(int(ends[-1]))[ends], dtype=np.uint64)[last]
    sums[1:] -= sums[:-1].copy()
    stop = ends[last]
    return sums * _POWERS.upto(int(stop[-1]))[stop], _sizes(stop), height[last]


class Leaves:
    """The leaves of a text, as a fingerprint holds them: ``root``, ``level``, ``digest``, ``size`` and ``height``."""

    def __init__(self, root: str, level: int, digest: np.ndarray, size: np.ndarray, height: np.ndarray):
        self.root, self.level, self.digest, self.size, self.height = root, level, digest, size, height

    @classmethod
    def of(cls, root: str, text: str) -> Leaves:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = _mixed(codes.astype(np.uint64) + _U(1))
        height = heights(codes, seen)
        level = level_of(height)
        return cls(root, level, *joined(seen, np.ones(len(codes), np.int64), height, level))

    @classmethod
    def parse(cls, fingerprint: str) -> Leaves:
        root, level, data = fingerprint.split(":")
        leaves = np.frombuffer(base64.b64decode(data), _LEAF)
        return cls(root, int(level), *(np.repeat(leaves[n].astype(t), leaves["times"]) for n, t in (("digest", np.uint64), ("size", np.int64), ("height", np.uint8))))

    def __str__(self) -> str:
        new = np.ones(len(self.digest), bool)
        new[1:] = (self.digest[1:] != self.digest[:-1]) | (self.size[1:] != self.size[:-1]) | (self.height[1:] != self.height[:-1])
        first = np.flatnonzero(new)
        leaves = np.zeros(len(first), _LEAF)
        leaves["digest"], leaves["size"], leaves["height"] = self.digest[first], self.size[first], self.height[first]
        leaves["times"] = np.diff(np.append(first, len(new)))
        return f"{self.root}:{self.level}:{base64.b64encode(leaves.tobytes()).decode()}"

    def at(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        digest, size, _ = (self.digest, self.size, None) if level == self.level else joined(self.digest, self.size, self.height, level)
        return digest ^ _mixed(size.astype(np.uint64)), size


def likeness(a: str, b: str) -> float:
    """The share of code points in leaves that two fingerprints have in common: 1 for those of equal texts,
    0 for those of texts that share no leaf."""
    return _likeness(Leaves.parse(a), Leaves.parse(b))


def _likeness(a: Leaves, b: Leaves) -> float:
    if a.root == b.root:
        return 1.0
    level = max(a.level, b.level)
    (d, size), (e, other) = a.at(level), b.at(level)
    order = np.argsort(np.concatenate([d, e]), kind="stable")  # equal ones together, the first text's before the second's
    every, weight = np.concatenate([d, e])[order], np.concatenate([size, other])[order]
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else order
    own = np.add.reduceat((order < len(d)).astype(np.int64), starts) if len(starts) else starts
    many = _sizes(np.append(starts[1:], len(every)))
    common = int((np.minimum(own, many - own) * weight[starts]).sum())
    return min(1.0, 2 * common / max(1, int(weight.sum())))


class Tree:
    """The Merkle tree of a text: ``leaves``, ``paragraphs`` (digests), ``sections`` (digest, first, last) and ``root``."""

    def __init__(self, text: str):
        self.text = text
        self.paragraphs = [hashlib.blake2b(b"P" + line.encode("utf-8", "surrogatepass"), digest_size=16).digest() for line in text.split("\n")]
        self.sections: list[tuple[bytes, int, int]] = []
        start = 0
        for i, digest in enumerate(self.paragraphs, 1):
            if digest[0] < 32 or i == len(self.paragraphs):
                self.sections.append((_node(b"S", self.paragraphs[start:i]), start, i))
                start = i
        self.root = _node(b"R", [s[0] for s in self.sections])

    @cached_property
    def leaves(self) -> Leaves:
        return Leaves.of(self.root.hex(), self.text)

    @property
    def fingerprint(self) -> str:
        return str(self.leaves)

    def paragraph(self, ends: np.ndarray) -> np.ndarray:
        """The numbers of the paragraphs that hold the code points before these places, line feeds at their ends."""
        sizes = np.fromiter(map(len, self.text.split("\n")), np.int64) + 1
        return np.searchsorted(np.cumsum(sizes), ends, side="left")

    def beside(self, other: Tree) -> np.ndarray:
        """Which paragraphs stand in branches that ``other`` lacks."""
        sections, paragraphs = Counter(s[0] for s in other.sections), Counter(other.paragraphs)
        alone = np.zeros(len(self.paragraphs), bool)
        rest: list[int] = []
        for digest, first, last in self.sections:
            if sections[digest] > 0:
                sections[digest] -= 1
                paragraphs.subtract(self.paragraphs[first:last])
            else:
                rest += range(first, last)
        for k in rest:
            if paragraphs[self.paragraphs[k]] > 0:
                paragraphs[self.paragraphs[k]] -= 1
            else:
                alone[k] = True
        return alone


def edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Spans of code points of ``a`` whose leaves stand in no differing branch of ``b``, in order."""
    if a.root == b.root:
        return []
    level = max(a.leaves.level, b.leaves.level)
    (digest, size), (other, other_size) = a.leaves.at(level), b.leaves.at(level)

    last = np.cumsum(size)
    first = last - size
    new = a.beside(b)[a.paragraph(last)]
    if new.any():
        new &= ~np.isin(digest, other[b.beside(a)[b.paragraph(np.cumsum(other_size))]])
    first, last = first[new], last[new]
    if not len(first):
        return []
    gaps = first[1:] > last[:-1]
    return list(zip(first[np.concatenate([[True], gaps])].tolist(), last[np.concatenate([gaps, [True]])].tolist(), strict=True))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns the id, ``n_chars`` and ``fingerprint`` of every whole text, a row for each row.

    A null text counts as empty; null and repeated ids are passed on. Other columns take no part. A long
    text takes memory for a few numbers a code point, and an empty table gives an empty table.
    """
    require(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([Tree(t).fingerprint for t in texts], pa.string())], names=["id", "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(at(docs, id_col).alias("id"), at(docs, text_col).alias("text")).mapInArrow(run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints every text and its edited text, whose last quarter (rounded down) is replaced
    by the first as many code points of the next document by id; the last is followed by the first.

    Returns the id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next`` (likeness of its fingerprint to the edited text's and to the next document's) and
    ``first_edit`` (code point where the first differing piece begins; null where none differs).
    A null text counts as empty. Ids are integers; null ids come first, equal ids stand in order of
    their texts, nulls first. Other columns take no part. An empty table gives an empty table.

    Rows are dealt to ranges of ids whose ends come from quantiles of the id column; the first
    document of each range also goes to the range before it. The driver sees a few numbers a range.
    """
    require(docs, id_col, text_col)
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(at(docs, id_col).cast("long").alias("id"), at(docs, text_col).alias("text"))
    ends = id_ranges(rows, "id", ranges)
    rows = rows.withColumn("range", range_of(F.col("id"), ends))
    firsts = sorted((r["range"], None if r["nulls"] else r["first"]) for r in rows.groupBy("range").agg(F.min("id").alias("first"), F.count_if(F.col("id").isNull()).alias("nulls")).collect())
    own = F.struct(F.col("range"), F.lit(False).alias("guard"))
    if firsts:
        before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
        targets = F.create_map(*(F.lit(x) for b, p in before.items() for x in (b, p)))
        marks = F.create_map(*(F.lit(x) if x is not None else F.lit(None).cast("long") for b, f in firsts for x in (b, f)))
        is_first = F.col("id").eqNullSafe(F.element_at(marks, F.col("range")))
        copies = F.when(is_first, F.array(own, F.struct(F.element_at(targets, F.col("range")).alias("range"), F.lit(True).alias("guard")))).otherwise(F.array(own))
    else:
        copies = F.array(own)
    dealt = rows.select("id", "text", F.explode(copies).alias("c")).select("id", "text", "c.range", "c.guard")
    dealt = dealt.repartitionById(len(ends) + 1, F.col("range")).sortWithinPartitions("range", "guard", F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "first_edit"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # (id, text, tree, range)

        def row(text: str, following: str, doc_id: int | None, tree: Tree, after: Tree) -> tuple:
            k = len(text) // 4
            edited = text[: len(text) - k] + following[:k]
            other = Tree(edited)
            spans = edits(tree, other)
            return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), tree.fingerprint, other.fingerprint, _likeness(tree.leaves, other.leaves), _likeness(tree.leaves, after.leaves), spans[0][0] if spans else None)

        for batch in batches:
            out = []
            for doc_id, text, where, guard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if guard and (waiting is None or waiting[3] != where):
                    continue
                text = text or ""
                tree = Tree(text)
                if waiting is not None:
                    out.append(row(waiting[1], text, waiting[0], waiting[2], tree))
                waiting = None if guard else (doc_id, text, tree, where)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first_edit long"
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)
