"""Phrase collocation mining with depth-limited count tries.

A task counts the phrases of its texts in tries of ``LONGEST`` words' depth, one a language and block of
tokens: a path is the words from one place on, up to the end of its piece, and a node's count the number of
paths through it. A trie is serialised in the order of its paths, each with the number of words that
it shares with the one before, and cut at the ends of prefix ranges, which all tasks know. The task
of a range merges the runs of all tries, counts the nodes and keeps those that are frequent; of nodes
that may go on in the next range it keeps the part it saw, and an aggregate adds the parts. Ranges
end at whole paths, not at words, so the phrases that begin with one frequent word, or pair of words, are spread
over as many tasks as they fill. Their ends are quantiles of a bounded sample, which changes how
evenly the work is dealt and no result.

The nodes left are a table of phrases and counts. The first part of a phrase is an ancestor of its node
and the rest is a node on its chain of suffix links, so both are found by joins with the table on
the words of the walk, as is each longer phrase that holds a shorter one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.llm.common import Scratch, at, require
from tessitura.llm.tokenization import pieces

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
#: A shorter phrase goes if a longer one has this share of its count, in percent.
COVERED = 80
#: Tokens of a trie, and of the texts whose paths make a range.
BLOCK_TOKENS = 1 << 21
RANGE_TOKENS = 1 << 21
#: Sampled documents, one path in so many of theirs, paths sent to the driver, bytes of their words.
SAMPLE_DOCS, SAMPLE_EVERY, SAMPLE_PATHS, SAMPLE_BYTES = 20_000, 64, 50_000, 32
UNKNOWN = "und"
#: Parts of a language whose best phrases are found first.
BUCKETS = 64

# lower case for A-Z, a line feed for the marks at which pieces end, a space for a tab
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_BREAK = b"\xff"  # stands in no UTF-8 text
_SLICE = 1 << 20

Path = tuple[bytes, ...]
End = tuple[str, Path]


class Words:
    """Token ids in order of appearance; 0 is the end of a piece."""

    def __init__(self):
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[_BREAK]
        self.runs: list[np.ndarray] = []
        self.tokens = 0

    def add(self, text: str) -> None:
        data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
        start = 0
        while start < len(data):  # long texts in parts that end before a space or a mark
            stop = start + _SLICE
            if stop < len(data):
                ends = [p for p in (data.find(b" ", stop), data.find(b"\n", stop)) if p >= 0]
                stop = min(ends, default=len(data))
            found = data[start:stop].replace(b"\n", b" \xff ").split()
            self.runs.append(np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found)))
            self.tokens += len(found)
            start = stop
        self.runs.append(np.zeros(1, np.int32))

    def ranked(self) -> tuple[list[bytes], np.ndarray]:
        """The words in order (the first stands for the end of a piece) and the tokens as places in it."""
        words = list(self.ids)
        order = sorted(range(1, len(words)), key=words.__getitem__)
        rank = np.zeros(len(words), np.uint64)
        rank[order] = np.arange(1, len(words), dtype=np.uint64)
        return [b"", *(words[i] for i in order)], rank[np.concatenate(self.runs)] if self.runs else np.zeros(0, np.uint64)


def paths_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token that is a word, the path that begins there: two words in each of two numbers."""
    words = [tokens]
    for j in range(1, LONGEST):
        words.append(np.append(tokens[j:], np.zeros(min(j, len(tokens)), np.uint64)))
    for j in range(1, LONGEST):
        words[j] = np.where(words[j - 1] == 0, np.uint64(0), words[j])
    real = tokens > 0
    a, b, c, d = (w[real] for w in words)
    return (a << np.uint64(32)) | b, (c << np.uint64(32)) | d


def merged(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths in order, each once, with the sum of its counts (1 each without ``counts``)."""
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])) if len(high) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    if counts is None:
        total = np.diff(np.append(first, len(high)))
    else:
        total = np.add.reduceat(counts[order], first) if len(first) else counts
    return high[first], low[first], total.astype(np.int64)


def columns_of(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Paths as an array with a column for each depth."""
    mask = np.uint64(0xFFFFFFFF)
    return np.stack([high >> np.uint64(32), high & mask, low >> np.uint64(32), low & mask], axis=1).astype(np.uint32)


def packed(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = paths.astype(np.uint64)
    return (wide[:, 0] << np.uint64(32)) | wide[:, 1], (wide[:, 2] << np.uint64(32)) | wide[:, 3]


def serialised(paths: np.ndarray, counts: np.ndarray) -> bytes:
    """A trie's paths in order: how many words each shares with the one before, the words that are
    new, and the counts."""
    same = np.zeros(paths.shape, bool)
    same[1:] = paths[1:] == paths[:-1]
    shared = np.logical_and.accumulate(same, axis=1).sum(axis=1).astype(np.uint8)
    new = paths[np.arange(LONGEST) >= shared[:, None]]
    data = b"".join((len(paths).to_bytes(8, "little"), len(new).to_bytes(8, "little"), shared.tobytes(), new.astype("<u4").tobytes(), counts.astype("<i8").tobytes()))
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def deserialised(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    n, m = (int.from_bytes(data[i : i + 8], "little") for i in (0, 8))
    shared = np.frombuffer(data, np.uint8, n, 16)
    new = np.frombuffer(data, "<u4", m, 16 + n)
    counts = np.frombuffer(data, "<i8", n, 16 + n + 4 * m)
    paths = np.zeros((n, LONGEST), np.uint32)
    fresh = np.arange(LONGEST) >= shared[:, None]
    paths[fresh] = new
    for j in range(LONGEST):  # a shared word is that of the last path that had a new one there
        paths[:, j] = paths[np.maximum.accumulate(np.where(fresh[:, j], np.arange(n), 0)), j]
    return paths, counts


def place(words: list[bytes], high: np.ndarray, low: np.ndarray, end: Path) -> int:
    """Where in the ordered paths a range that begins with the path ``end`` begins."""
    key = []
    for word in end:
        k = bisect_left(words, word)
        key.append(k)
        if k == len(words) or words[k] != word:
            break
    a, b, c, d = key + [0] * (LONGEST - len(key))
    first, last = (int(np.searchsorted(high, np.uint64(a << 32 | b), side)) for side in ("left", "right"))
    return first + int(np.searchsorted(low[first:last], np.uint64(c << 32 | d)))


def trie_rows(lang: str, words: Words, ends: list[End]) -> Iterator[tuple[int, str, bytes, bytes]]:
    """(range, language, words, paths) for each range that the trie of ``words`` reaches into."""
    names, tokens = words.ranked()
    high, low, counts = merged(*paths_of(tokens))
    before = bisect_left(ends, (lang, ()))
    own = [e for l, e in ends[before : bisect_left(ends, (lang + "\0", ()))] if l == lang]
    cuts = [0, *(place(names, high, low, e) for e in own), len(high)]
    for k, (start, stop) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if start < stop:
            paths = columns_of(high[start:stop], low[start:stop])
            used = np.unique(paths)
            used = used[used > 0]
            local = np.where(paths > 0, np.searchsorted(used, paths) + 1, 0)
            yield before + k, lang, b"\n".join(names[i] for i in used), serialised(local, counts[start:stop])


class Range:
    """The merge of the runs of one range and language."""

    def __init__(self):
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[b""]
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.least = 0

    def add(self, words: bytes, blob: bytes) -> None:
        names = words.split(b"\n")
        paths, counts = deserialised(blob)
        own = np.concatenate([[0], np.fromiter(map(self.ids.__getitem__, names), np.uint32, len(names))]).astype(np.uint32)
        self.runs.append((*packed(own[paths]), counts))
        self.held += len(counts)
        if self.held > 2 * self.least + BLOCK_TOKENS:
            self.close()

    def close(self) -> None:
        self.runs = [merged(*(np.concatenate(x) for x in zip(*self.runs, strict=True)))]
        self.held = self.least = len(self.runs[0][0])

    def nodes(self, min_count: int) -> Iterator[tuple[str, int]]:
        """(phrase, count) of the nodes with ``min_count``, and of those on the first and the last path,
        which other ranges may have parts of. The root, an empty phrase, counts all paths."""
        names = list(self.ids)
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.zeros(len(names), np.uint32)
        rank[order] = np.arange(len(names), dtype=np.uint32)
        self.close()
        high, low, counts = self.runs[0]
        self.runs = []
        high, low, counts = merged(*packed(rank[columns_of(high, low)]), counts)
        paths = columns_of(high, low)
        yield "", int(counts.sum())
        new = np.zeros(len(paths), bool)
        new[0] = True
        for depth in range(1, LONGEST + 1):
            column = paths[:, depth - 1]
            new[1:] |= column[1:] != column[:-1]
            first = np.flatnonzero(new)
            total = np.add.reduceat(counts, first)
            kept = total >= min_count
            kept[[0, -1]] = True
            kept &= column[first] > 0
            for row, n in zip(paths[first[kept], :depth].tolist(), total[kept].tolist(), strict=True):
                yield b" ".join(names[order[i]] for i in row).decode("utf-8", "surrogatepass"), n


def _ends(rows: DataFrame, scratch: Scratch) -> list[End]:
    """The first paths of all ranges but the first, in order; fewer where the sample has few paths."""
    total = rows.count()
    fraction = min(1.0, SAMPLE_DOCS / max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch.column(1)):
                out = []
                for k, (lang, text) in enumerate(zip(batch.column(0)[part].to_pylist(), batch.column(1)[part].to_pylist(), strict=True)):
                    words = Words()
                    words.add(text or "")
                    names, tokens = words.ranked()
                    paths = columns_of(*paths_of(tokens))[k % SAMPLE_EVERY :: SAMPLE_EVERY]
                    out += [(lang, [names[i][:SAMPLE_BYTES] for i in row if i]) for row in paths.tolist()]
                if out:
                    langs, found = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.list_(pa.binary()))], names=["lang", "path"])

    sampled = scratch.save(rows.sample(fraction, 11).mapInArrow(run, "lang string, path array<binary>"), "sample")
    n = sampled.count()
    tokens = n * SAMPLE_EVERY / fraction
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(tokens / RANGE_TOKENS) + 1)
    found = sampled if n <= SAMPLE_PATHS else sampled.orderBy(F.rand(11)).limit(SAMPLE_PATHS)
    paths = sorted((r["lang"], tuple(bytes(w) for w in r["path"])) for r in found.collect())
    ranges = min(ranges, max(1, len(paths) // 4))
    return sorted({paths[len(paths) * i // ranges] for i in range(1, ranges)})


def phrases(docs: DataFrame, scratch: Scratch, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, f): the phrases of up to ``LONGEST`` words that stand ``min_count`` times at least,
    and an empty phrase for each language that has words, with the number of all of them."""
    rows = docs.select(F.coalesce(at(docs, lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), at(docs, text_col).alias("text"))
    ends = _ends(rows, scratch)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, Words] = defaultdict(Words)

        def out(langs: list[str]) -> Iterator[pa.RecordBatch]:
            for lang in langs:
                made = list(trie_rows(lang, held.pop(lang), ends))
                if made:
                    numbers, names, words, blobs = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(names, pa.string()), pa.array(words, pa.binary()), pa.array(blobs, pa.binary())], names=["range", "lang", "words", "paths"])

        for batch in batches:
            for part in pieces(batch.column(1)):
                for lang, text in zip(batch.column(0)[part].to_pylist(), batch.column(1)[part].to_pylist(), strict=True):
                    if text:
                        held[lang].add(text)
                if sum(w.tokens for w in held.values()) >= BLOCK_TOKENS:
                    most = max(w.tokens for w in held.values())
                    yield from out([lang for lang, w in held.items() if 2 * w.tokens >= most])
        yield from out(list(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: defaultdict[tuple[int, str], Range] = defaultdict(Range)
        for batch in batches:
            for number, lang, words, paths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ranges[number, lang].add(words, paths)
        for number, lang in list(ranges):
            found, counts = zip(*ranges.pop((number, lang)).nodes(min_count), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])

    tries = rows.mapInArrow(count, "range int, lang string, words binary, paths binary")
    parts = tries.repartitionById(len(ends) + 1, F.col("range")).mapInArrow(merge, "lang string, phrase string, f long")
    whole = parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("phrase") == ""))
    return scratch.save(whole, "phrases")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """Returns each language's first ``top`` collocations: ``lang``, ``rank`` (from 1), ``phrase``, ``a`` (its
    count), ``l`` and ``r`` (those of its parts at the weakest cut), ``n`` (all words of the language) and ``score``.

    Texts are cut into pieces at marks and line ends and pieces into words at spaces and tabs, A-Z in lower
    case. Candidates have two to four words and ``min_count`` occurrences. The score is the floor of
    2,000,000 a / (l + r) at the cut where that is lowest, the first of equal ones. A candidate goes if a
    longer one that holds its words has ``covered`` percent of its count. Order: score and count from
    the highest, phrases by their bytes.

    A null language is ``und``; null and empty texts have no words, and repeated rows count as often as they stand. Other columns take
    no part. An empty table, or one without frequent phrases, gives an empty table.
    """
    require(docs, lang_col, text_col)
    scratch = Scratch(docs.sparkSession, "collocations")
    table = phrases(docs, scratch, lang_col, text_col, min_count)
    words = F.split("phrase", " ", -1)
    nodes = table.where("phrase <> ''")
    candidates = nodes.withColumn("words", words).withColumn("size", F.size("words")).where("size > 1")
    joined = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(nodes.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(nodes.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731 - the product may pass 64 bits
    cuts = cuts.select("lang", "phrase", "a", F.struct(F.expr("2000000BD * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))").alias("score"), "k", "l", "r").alias("cut"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longer = candidates.where("size > 2").select("lang", "f", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest").cast("decimal(19,0)") < covered * wide("a")))
    # the best of each of 64 parts of a language first, so that one task sees those and not every task's best
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    best = left.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    best = best.withColumn("rank", rank("lang", "bucket")).where(F.col("rank") <= top)
    best = best.withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    totals = table.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
